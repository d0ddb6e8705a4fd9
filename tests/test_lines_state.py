"""Line numbers of bronze records and the KPI state kept over a stream."""

import statistics
from datetime import datetime

import pytest

from quaystack.schema import RAW_COLUMNS
from quaystack.session import scratch_path
from quaystack.sources import bronze
from quaystack.streaming import ingest


@pytest.mark.parametrize("size", ["128MB", "1500"])
def test_lines_do_not_depend_on_the_splits(spark, size):
    schema = ", ".join(f"{c} string" for c in RAW_COLUMNS)
    landing = scratch_path(spark, "landing")
    for part in ("x", "y"):
        rows = [(f"{part}{i}", "20", "9", "2026-04-08", "import" * (i % 7), None) for i in range(700)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").option(
            "header", "true").csv(f"{landing}/{part}")
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        scan = bronze.ingest(spark, f"{landing}/*")
        cuts = scan.select("_rk.f", "_rk.b").distinct().count()
        stored = bronze.write_batch(scan, scratch_path(spark, "bronze"))
        lines = {r["id"]: r["_line"] for r in bronze.with_lines(stored).select("id", "_line").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)
    assert cuts == 2 if size == "128MB" else cuts > 10
    assert lines == {f"{part}{i}": i + 1 for part in ("x", "y") for i in range(700)}


def test_lines_of_nothing(spark):
    schema = ", ".join(f"{c} string" for c in RAW_COLUMNS)
    landing = scratch_path(spark, "landing")
    spark.createDataFrame([], schema).write.option("header", "true").csv(landing)
    stored = bronze.write_batch(bronze.ingest(spark, landing), scratch_path(spark, "bronze"))
    assert bronze.with_lines(stored).count() == 0


def test_state_equals_all_rows_and_replays(spark):
    day = lambda d: datetime(2026, 4, d)
    # Large equal parts: squares that are not taken around a mean lose these digits.
    batches = [[("import", 20, 1e9 + i, day(1 + i)) for i in range(5)] + [("export", 40, 3.0, day(2))],
               [("import", 20, 1e9 + i, day(1 + i)) for i in range(5, 9)],
               [("export", 40, 5.0, day(1))]]
    out, seen = scratch_path(spark, "state"), []
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "type string, size int, weight double, departure_time timestamp")
        ingest.merge_batch(df, n, out)
        ingest.merge_batch(df, n, out)  # a replay
        seen += rows
        for r in ingest.current_kpis(spark, out).collect():
            mine = [x for x in seen if x[:2] == (r["type"], r["size"])]
            weights = [x[2] for x in mine]
            assert (r["cnt"], r["min_weight"], r["max_weight"]) == (len(mine), min(weights), max(weights))
            assert r["avg_weight"] == pytest.approx(statistics.mean(weights))
            assert r["first_departure"] == min(x[3] for x in mine)
            assert r["last_departure"] == max(x[3] for x in mine)
            if len(mine) > 1:
                assert r["stddev_weight"] == pytest.approx(statistics.stdev(weights), rel=1e-6)
            else:
                assert r["stddev_weight"] is None
