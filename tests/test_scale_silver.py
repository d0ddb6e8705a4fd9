"""Silver rows and slot texts: one pass, each text matched once."""

from pyspark.sql import functions as F

from quaystack.operators import silver, yard
from quaystack.schema import DUPLICATE_ID, NULL_CRITICAL, YardSpec

RAW = "id string, size string, weight string, departure_time string, type string, slot string, seq int"
ROWS = ([("h", "20", "10" if i % 2 else None, "2026-03-05", "import", None, i) for i in range(12)]
        + [("b", "20", None, "2026-03-05", "import", None, i) for i in range(8)]
        + [(None, "20", "10", "2026-03-05", "import", None, i) for i in range(8)]
        + [("r", "20", "10", "2026-03-05", "import", None, 1)])


def test_rows_are_labelled_in_one_pass_also_of_hot_and_broken_ids(spark, monkeypatch):
    raw = spark.createDataFrame(ROWS, RAW).withColumn("_ingestion_time", F.current_timestamp()) \
        .withColumn("_rk", F.col("seq"))
    label = lambda: silver.process(raw, ["seq"], keep=["seq"]).labelled
    cold = label()
    assert "Union" not in cold._jdf.queryExecution().executedPlan().toString()
    got = lambda df: sorted((str(r["id"]), r["seq"], str(r["anomaly_reason"])) for r in df.collect())
    want = sorted([("h", i, "None" if i == 1 else DUPLICATE_ID if i % 2 else NULL_CRITICAL) for i in range(12)]
                  + [(i, n, NULL_CRITICAL) for i in ("b", "None") for n in range(8)] + [("r", 1, "None")])
    assert got(cold) == want
    monkeypatch.setattr(silver, "HOT", 5)
    assert {r["id"] for r in silver.hot_groups(raw, ["id"]).collect()} == {"h", "b"}
    assert got(label()) == want


def test_slot_text_is_matched_once_a_row(spark):
    rows = spark.createDataFrame([("A-001-A-01",), ("s1 2 b 3",), ("A-001-A-09",), ("A-001",), (None,)], "slot string")
    located = yard.with_location(rows, YardSpec(max_height=7))
    plan = located.filter(yard.in_grid(YardSpec()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1
    assert [tuple(r)[1:] for r in located.collect()] == [
        ("A", 1, 1, 1), ("S1", 2, 2, 3), (None,) * 4, (None,) * 4, (None,) * 4]
