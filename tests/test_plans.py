"""Plan shape: no cross products anywhere, pruning where the data allows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

SKIP = {"silver_partitions", "anomaly_partitions", "stream_ingest", "stream_dedup", "stream_kpis",
        "bronze_scan", "bronze_lineage", "bronze_roundtrip", "archive_partitions", "latest_kpis",
        "gold_summary_roundtrip", "store_upsert", "store_scan", "store_after_reset", "container_lookup"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in SKIP))
def test_no_cross_products(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_fixture_scan_prunes_columns(spark):
    from quaystack.sources.fixtures import arrivals_raw
    plan = _plan(arrivals_raw(spark, SF_SMALL).select("id"))
    assert "l_discount" not in plan and "l_comment" not in plan


def test_partitioned_readback_prunes(spark):
    from quaystack.operators import silver
    from quaystack.plans import context as ctx
    from quaystack.session import scratch_path
    path = scratch_path(spark, "plan-silver")
    clean = ctx.clean(spark, SF_SMALL).filter(F.col("departure_date") < F.lit("1995-03-01").cast("date"))
    silver.write_silver(clean, path)
    plan = _plan(spark.read.parquet(path).filter(F.col("type") == "export"))
    assert "PartitionFilters: [isnotnull(type" in plan
