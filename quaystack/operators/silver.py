"""Silver layer: typing, quarantine labels, dedup, domain rules, sinks.

One labelled frame carries every raw row with ``anomaly_reason`` null for
clean rows, so the clean table, the anomaly history and the quality report
are three projections of one plan instead of five counting jobs.

Dedup is "first row per id in an explicit order": a rank over ``id``, which
shuffles and sorts each row once. A hot id would land in a single task, so
rows are counted first: per share of the ids' hashes, then, only in shares of
more than ``HOT`` rows, per id. For the few ids of more than ``HOT`` rows the
first key is found with an aggregate, combined map-side, and broadcast to
their rows, which stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystack.functions.parse import (normalise_type, parse_departure, round_half_up,
                                       to_double, to_size)
from quaystack.schema import (ALLOWED_SIZES, ALLOWED_TYPES, CRITICAL_COLUMNS, DOMAIN_VIOLATION,
                              DUPLICATE_ID, ISO_FORMAT, NULL_CRITICAL, WEIGHT_MAX, WEIGHT_MIN)
from quaystack.session import fine_shuffles, materialise

#: Rows of one id that a task may rank. A table has at most its rows divided
#: by this of hotter ids.
HOT = 100_000
#: Shares of the hashes that rows are counted by: a small table in every task,
#: however many ids there are.
SHARES = 65_536


def typed(raw: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
    """Step 1-2: try-casts and multi-format departure parse."""
    extra = [c for c in keep if c in raw.columns]
    return raw.select(
        F.col("id").cast("string").alias("id"),
        to_double("weight").alias("weight"),
        to_size("size").alias("size"),
        parse_departure("departure_time").alias("departure_time"),
        normalise_type("type").alias("type"),
        F.col("_ingestion_time"),
        F.col("slot"),
        *extra,
    )


def null_critical() -> Column:
    cond = F.lit(False)
    for c in CRITICAL_COLUMNS:
        cond = cond | F.col(c).isNull()
    return cond


def domain_ok(default_type: bool = False) -> Column:
    """Domain rule; a null anywhere counts as a violation (never vanishes)."""
    type_ok = F.lit(True) if default_type else F.col("type").isin(ALLOWED_TYPES)
    cond = (F.col("weight").between(WEIGHT_MIN, WEIGHT_MAX)
            & F.col("size").isin(ALLOWED_SIZES) & type_ok)
    return F.coalesce(cond, F.lit(False))


def label(typed_df: DataFrame, order_cols: list[str], row_key: str = "_rk",
          default_type: bool = False, within: list[str] | tuple = (),
          counted: DataFrame | None = None) -> DataFrame:
    """Add ``anomaly_reason``: null-critical, then duplicate, then domain.
    An id may come once in each value of the columns ``within``. Rows are
    counted per id in ``counted``, if given: the same rows, less worked on."""
    # Rows without a critical value need no first row. They get a rank of
    # their own each: null ids would all meet in one task, and one pass over
    # the rows serves both.
    order = [*order_cols, row_key]
    df = typed_df.withColumn("_lane", F.when(null_critical(), F.xxhash64(*order)))
    reason = (F.when(F.col("_lane").isNotNull(), F.lit(NULL_CRITICAL))
              .when(~F.col("_first"), F.lit(DUPLICATE_ID))
              .when(~domain_ok(default_type), F.lit(DOMAIN_VIOLATION)))
    ranked = _first_rows(df, ["id", *within], order, counted)
    out = ranked.withColumn("anomaly_reason", reason).drop("_first", "_lane")
    if default_type:
        out = out.withColumn("type", F.when(F.col("type").isin(ALLOWED_TYPES), F.col("type"))
                             .otherwise(F.lit("import")))
    return out


def hot_groups(df: DataFrame, group: list[str]) -> DataFrame | None:
    """The groups of more than ``HOT`` rows, stored, or None without any;
    rows with a null in ``group`` are in none."""
    df = df.dropna(subset=group)
    share = F.pmod(F.xxhash64(*group), F.lit(SHARES)).cast("int")
    full = materialise(df.groupBy(share.alias("_share")).agg(F.count(F.lit(1)).alias("_n"))
                       .filter(F.col("_n") > HOT).select("_share"), "hot-shares")
    if full.isEmpty():
        return None
    within = df.select(*group, share.alias("_share")).join(F.broadcast(full), "_share", "left_semi")
    sizes = within.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialise(sizes.filter(F.col("_n") > HOT).select(*group), "hot-ids")
    return None if hot.isEmpty() else hot


def _first_rows(df: DataFrame, group: list[str], order: list[str], counted: DataFrame | None = None) -> DataFrame:
    """Add ``_first``: the row is the first of its group in this order, of the
    rows with a null ``_lane``; it says nothing of the others."""
    rank = F.rank().over(Window.partitionBy(*group, "_lane").orderBy(*order))
    hot = hot_groups(df if counted is None else counted, group)
    if hot is None:
        return df.withColumn("_first", rank == 1)
    key = F.struct(*order)
    # Three readers from here on: the rows are stored for them.
    df = materialise(df, "silver-typed", "zstd")
    rows = df.join(F.broadcast(hot), group, "left_semi")
    firsts = rows.filter(F.col("_lane").isNull()).groupBy(*group).agg(F.min(key).alias("_key"))
    known = rows.join(F.broadcast(firsts), group, "left").withColumn("_first", key == F.col("_key")).drop("_key")
    rest = df.join(F.broadcast(hot), group, "left_anti").withColumn("_first", rank == 1)
    return rest.unionByName(known)


def clean(labelled: DataFrame) -> DataFrame:
    """Rows that passed every rule, with the ISO text and partition date."""
    return (labelled.filter(F.col("anomaly_reason").isNull())
            .drop("anomaly_reason")
            .withColumn("departure_time_iso", F.date_format("departure_time", ISO_FORMAT))
            .withColumn("departure_date", F.to_date("departure_time")))


def anomalies(labelled: DataFrame) -> DataFrame:
    """Quarantined rows with their reason and ingestion date."""
    return (labelled.filter(F.col("anomaly_reason").isNotNull())
            .withColumn("ingestion_date", F.to_date("_ingestion_time")))


def quality_report(labelled: DataFrame) -> DataFrame:
    """One row of counts from one aggregate over the labelled frame."""
    r = F.col("anomaly_reason")
    agg = labelled.agg(
        F.count(F.lit(1)).alias("total_raw"),
        F.count_if(r == NULL_CRITICAL).alias("invalid_nulls_removed"),
        F.count_if(r == DUPLICATE_ID).alias("duplicates_removed"),
        F.count_if(r == DOMAIN_VIOLATION).alias("invalid_domain_removed"),
        F.count_if(r.isNull()).alias("total_cleaned"),
    )
    return with_scores(agg)


def with_scores(report: DataFrame) -> DataFrame:
    """Derived report columns, always from counts (never averaged scores)."""
    return (report
            .withColumn("total_anomalies", F.col("invalid_nulls_removed")
                        + F.col("duplicates_removed") + F.col("invalid_domain_removed"))
            .withColumn("quality_score",
                        F.when(F.col("total_raw") > 0,
                               round_half_up(F.col("total_cleaned") * 100.0 / F.col("total_raw"), 1))
                        .otherwise(F.lit(0.0))))


def merge_reports(*reports: DataFrame) -> DataFrame:
    """Sum the counts of several batch reports, then rescore."""
    counts = ["total_raw", "invalid_nulls_removed", "duplicates_removed",
              "invalid_domain_removed", "total_cleaned"]
    u = reports[0].select(*counts)
    for r in reports[1:]:
        u = u.unionByName(r.select(*counts))
    return with_scores(u.agg(*[F.sum(c).alias(c) for c in counts]))


@dataclass
class SilverResult:
    labelled: DataFrame

    @property
    def clean(self) -> DataFrame:
        return clean(self.labelled)

    @property
    def anomalies(self) -> DataFrame:
        return anomalies(self.labelled)

    @property
    def report(self) -> DataFrame:
        return quality_report(self.labelled)


def process(raw: DataFrame, order_cols: list[str], keep=(), row_key: str = "_rk",
            default_type: bool = False, within: list[str] | tuple = (),
            counted: DataFrame | None = None) -> SilverResult:
    """The labelled frame is lazy: store it before it is read more than once.
    Rows are counted per id before, from the ids of the raw source alone."""
    keep = list(keep) + ([row_key] if row_key not in keep else [])
    return SilverResult(label(typed(raw, keep), order_cols, row_key, default_type, within, counted))


# --- sinks ---------------------------------------------------------------------

def write_silver(clean_df: DataFrame, path: str) -> None:
    """Partitioned by type and departure date. Rebalancing on the partition
    columns gives few files a directory and splits a hot one over tasks. The
    partitions are fine, as each split of a coarse one has rows for all of
    its directories."""
    with fine_shuffles(clean_df.sparkSession):
        (clean_df.hint("rebalance", "type", "departure_date")
         .write.mode("overwrite").partitionBy("type", "departure_date").parquet(path))


def append_anomalies(anomaly_df: DataFrame, path: str) -> None:
    with fine_shuffles(anomaly_df.sparkSession):
        (anomaly_df.hint("rebalance", "ingestion_date", "anomaly_reason")
         .write.mode("append").partitionBy("ingestion_date", "anomaly_reason").parquet(path))
