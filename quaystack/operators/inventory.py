"""Inventory views over the yard state: search, exact search, block
drill-down and user-chosen sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystack.functions.location import format_location
from quaystack.operators.yard import PILE

SORTABLE = {"weight": "double", "size": "double", "departure_time": "timestamp"}


def containers(occ: DataFrame) -> DataFrame:
    """Flat list of placed containers with their location text."""
    return occ.withColumn("location", format_location("block_id", "bay", "row", "tier"))


def search(inv: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring match on id, location or type."""
    q = F.lit(text.lower())
    return inv.filter(F.lower("id").contains(q) | F.lower("location").contains(q)
                      | F.lower(F.coalesce("type", F.lit(""))).contains(q))


def exact(inv: DataFrame, text: str) -> DataFrame:
    return inv.filter((F.col("id") == text) | (F.col("location") == text))


def drilldown(inv: DataFrame, block: str, row: int | None, text: str | None) -> DataFrame:
    """One block; one row of it (or all rows), keeping every pile that
    holds a search hit. The hit flag spreads over a pile (at most
    max_height rows) with a window."""
    b = inv.filter(F.col("block_id") == block)
    hit = (F.col("id") == text) | (F.col("location") == text) if text else F.lit(False)
    b = b.withColumn("_hit", F.max(hit.cast("int")).over(Window.partitionBy(*PILE)))
    keep = F.lit(True) if row is None else (F.col("row") == row)
    return b.filter(keep | (F.col("_hit") == 1)).drop("_hit")


def sort(inv: DataFrame, field: str, descending: bool = False) -> DataFrame:
    """Sort by a user-chosen field with a typed comparison (numbers as
    numbers, times as times, text case-insensitively); ties by id. A global
    sort is range-partitioned by Spark, not gathered in one task."""
    if field in SORTABLE:
        key = F.coalesce(F.col(field).cast(SORTABLE[field]), F.lit(0).cast(SORTABLE[field])) \
            if field != "departure_time" else F.col(field)
    else:
        key = F.lower(F.coalesce(F.col(field).cast("string"), F.lit("")))
    return inv.orderBy(key.desc() if descending else key.asc(), F.col("id"))
