"""Per-row labels and flags used by views and KPIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaystack.functions.parse import as_col, epoch_seconds
from quaystack.schema import BAND_AMBER, BAND_RED, HEAVY_T, REFERENCE_NOW, URGENT_T


def is_heavy(weight) -> Column:
    return as_col(weight) > F.lit(HEAVY_T)


def is_urgent(weight) -> Column:
    return as_col(weight) > F.lit(URGENT_T)


def status_class(container_id, ctype, weight) -> Column:
    """Status of a slot: checked in this order, first match wins."""
    return (
        F.when(as_col(container_id).isNull(), "default")
        .when(as_col(ctype) == "export", "scheduled")
        .when(as_col(weight) > F.lit(URGENT_T), "urgent")
        .when(as_col(ctype) == "empty", "empty")
        .otherwise("normal")
    )


def occupancy_band(pct) -> Column:
    return (F.when(as_col(pct) > F.lit(BAND_RED), "red")
            .when(as_col(pct) > F.lit(BAND_AMBER), "amber")
            .otherwise("green"))


def days_until(ts, reference: str = REFERENCE_NOW) -> Column:
    """Signed days between the reference clock and ``ts``."""
    ref = F.unix_timestamp(F.lit(reference).cast("timestamp"))
    return (epoch_seconds(ts) - ref) / F.lit(86400.0)
