"""Silver labels: dedup order cases and the partition invariant."""

from pyspark.sql import functions as F

from quaystack.operators import silver
from quaystack.schema import DOMAIN_VIOLATION, DUPLICATE_ID, NULL_CRITICAL

RAW = "id string, size string, weight string, departure_time string, type string, slot string, seq int"


def _label(spark, rows):
    raw = spark.createDataFrame(rows, RAW).withColumn("_ingestion_time", F.current_timestamp()) \
        .withColumn("_rk", F.col("seq"))
    return {(r["id"], r["seq"]): r["anomaly_reason"]
            for r in silver.process(raw, ["seq"], keep=["seq"]).labelled.collect()}


def test_bad_first_copy_does_not_shadow_good_second(spark):
    got = _label(spark, [("X", "20", None, "2026-03-05", "import", None, 1),
                         ("X", "20", "10", "2026-03-05", "import", None, 2)])
    assert got == {("X", 1): NULL_CRITICAL, ("X", 2): None}


def test_out_of_domain_first_copy_discards_valid_second(spark):
    got = _label(spark, [("Y", "45", "10", "2026-03-05", "import", None, 1),
                         ("Y", "20", "10", "2026-03-05", "import", None, 2)])
    assert got == {("Y", 1): DOMAIN_VIOLATION, ("Y", 2): DUPLICATE_ID}


def test_null_type_is_quarantined(spark):
    got = _label(spark, [("Z", "20", "10", "2026-03-05", None, None, 1)])
    assert got == {("Z", 1): DOMAIN_VIOLATION}


def test_every_raw_row_in_exactly_one_output(spark):
    from quaystack.plans import context as ctx
    from tests.conftest import SF_SMALL
    s = ctx.silver(spark, SF_SMALL)
    rep = s.report.collect()[0]
    assert rep["total_raw"] == ctx.raw(spark, SF_SMALL).count()
    assert rep["total_raw"] == (rep["total_cleaned"] + rep["invalid_nulls_removed"]
                                + rep["duplicates_removed"] + rep["invalid_domain_removed"])
    assert s.clean.select("id").distinct().count() == s.clean.count()


def test_tier_risks_add_up_to_the_flagged_rows(spark):
    """Ties, gaps between tiers, collisions and rows without a slot."""
    import random

    from pyspark.sql import functions as F

    from quaystack.operators import gold
    rng = random.Random(9)
    rows = [(f"c{i}", rng.randrange(2), f"{rng.choice('AB')}-00{rng.randrange(1, 3)}-A-0{rng.choice((1, 2, 4))}"
             if rng.random() < 0.9 else None, f"2026-03-0{rng.randrange(1, 6)}") for i in range(300)]
    clean = spark.createDataFrame(rows, "id string, yard_id long, slot string, departure_time string").withColumn(
        "departure_time", F.to_timestamp("departure_time"))
    flagged = gold.rehandle_risk(clean, 4)
    by_pile = lambda df, c: {tuple(r) for r in df.groupBy(*gold.PILE, "tier").agg(
        F.sum(c).cast("long")).filter("tier is not null").collect()}
    tiers = gold.tier_risks(clean, 4)
    assert by_pile(flagged, "is_rehandle_risk") == by_pile(tiers, "risk")
    assert tiers.agg(F.sum("n")).first()[0] == 300
    kpi = gold.stacking_kpi(clean, 4).first()
    assert kpi["rehandle_risk_count"] == flagged.agg(F.sum("is_rehandle_risk")).first()[0]
    assert tuple(gold.stacking_kpi(clean.limit(0), 4).first()) == (0, 0, 0.0)


def test_rows_are_shuffled_once_and_hot_ids_stay_in_place(spark, monkeypatch):
    """Labels by rank, and by aggregate for ids of many rows, ties included."""
    rows = [(f"h{i % 3}", "20", "10", f"2026-03-0{1 + i % 5}", "import", None, i // 2) for i in range(60)]
    rows += [(f"r{i}", "20", "10", "2026-03-05", "import", None, 1) for i in range(20)]
    raw = spark.createDataFrame(rows, RAW).withColumn("_ingestion_time", F.current_timestamp()) \
        .withColumn("_rk", F.col("seq"))
    label = lambda: silver.process(raw, ["departure_time", "seq"], keep=["seq"]).labelled
    by_rank = label()
    plan = by_rank._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    want = sorted(map(str, by_rank.select("id", "seq", "departure_time", "anomaly_reason").collect()))
    assert len(want) == 80 and sum("DUPLICATE_ID" in r for r in want) == 60 - 3
    monkeypatch.setattr(silver, "HOT", 5)
    by_key = label()
    assert sorted(map(str, by_key.select("id", "seq", "departure_time", "anomaly_reason").collect())) == want
