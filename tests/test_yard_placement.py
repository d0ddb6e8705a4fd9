"""Pile folds, audits, scores and placement invariants."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quaystack.operators import gold, placement, ranking, rules, yard
from quaystack.schema import YardSpec

SPEC = YardSpec(n_blocks=4, n_bays=24, n_rows=6, max_height=7)
BASE = datetime(2026, 3, 1)


def _records(spark, piles):
    rows = []
    for p, (block, deps) in enumerate(piles):
        for tier, d in enumerate(deps, start=1):
            rows.append((f"P{p}T{tier}", 20 if block in ("A", "B", "S1") else 40, 10.0,
                         BASE + timedelta(days=d), "import", f"{block}-001-A-{tier:02d}", 0))
    return spark.createDataFrame(rows, "id string, size int, weight double, departure_time timestamp, "
                                       "type string, slot string, yard_id long")


def test_pile_fold(spark):
    recs = _records(spark, [("A", [10, 12, 11]), ("B", [9, 8])])
    out = {r["id"]: r["outcome"] for r in placement.reconcile(recs, SPEC, ["departure_time"]).collect()}
    assert out == {"P0T1": "PLACED", "P0T2": "WOULD_REHANDLE", "P0T3": "PLACED",
                   "P1T1": "PLACED", "P1T2": "PLACED"}


def test_adjacent_vs_all_below(spark):
    recs = _records(spark, [("A", [10, 9, 11])])
    risk = gold.rehandle_risk(recs, 7).agg(F.sum("is_rehandle_risk")).collect()[0][0]
    assert risk == 1
    occ = yard.occupancy(recs, SPEC, ["departure_time"])
    audits = {r["id"]: r["rehandles"] for r in yard.pile_audits(occ).collect()}
    assert audits["P0T3"] == 2


def test_scores(spark):
    recs = _records(spark, [("A", [5, 20, 10]), ("S1", [5, 20, 10])])
    occ = yard.occupancy(recs, SPEC, ["departure_time"])
    sc = {r["id"]: r["total_score"] for r in rules.slot_scores(yard.pile_audits(occ), SPEC).collect()}
    assert sc["P0T3"] == 7.0
    assert abs(sc["P1T3"] - (-6.6)) < 1e-9


def test_rank_within_matches_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5000).alias("v"))
    got = ranking.rank_within(df, ["g"], ["v"], num_partitions=7)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("v")))
    assert got.select("g", "v", "rank").exceptAll(want.select("g", "v", "rank")).count() == 0
    assert got.count() == 5000


def test_placement_invariants(spark):
    from quaystack.plans import catalog
    from tests.conftest import SF_SMALL
    occ = catalog.ctx.occupancy(spark, SF_SMALL)
    assert occ.groupBy(*yard.SLOT).count().filter("count > 1").count() == 0
    z = catalog.batch_placement(spark, SF_SMALL)
    placed = z.filter(F.col("tier").isNotNull())
    assert placed.groupBy("block_id", "bay", "row", "tier").count().count() <= placed.count()
    full = catalog._batch(spark, SF_SMALL)[0].filter(F.col("tier").isNotNull())
    assert full.groupBy(*yard.SLOT).count().filter("count > 1").count() == 0
    assert full.filter(rules.zone_of().isNull()).count() == 0
    # no placed container overlaps a slot fixed by the snapshot pass
    fixed = catalog._reconciled(spark, SF_SMALL)[1].filter(F.col("outcome") == "PLACED")
    assert full.join(fixed, yard.SLOT, "inner").count() == 0


def test_topk_is_sorted_and_bounded(spark):
    from quaystack.plans import catalog
    from tests.conftest import SF_SMALL
    t = catalog.topk_slots(spark, SF_SMALL)
    assert t.groupBy("id").count().filter("count > 10").count() == 0
    from pyspark.sql import Window
    w = Window.partitionBy("id").orderBy("rank")
    bad = t.withColumn("prev", F.lag("score").over(w)).filter(F.col("prev") > F.col("score"))
    assert bad.count() == 0


def test_lead_within_matches_window_lead(spark):
    from pyspark.sql import Window
    # one group holds most rows, as a hot pile would
    df = spark.range(0, 6000).select(F.when(F.col("id") % 10 < 8, F.lit(0)).otherwise(F.col("id") % 7)
                                     .alias("g"), (F.col("id") * 7919 % 6000).alias("v"))
    got = ranking.lead_within(df, ["g"], ["v"], "v", "nxt", num_partitions=9)
    want = df.withColumn("nxt", F.lead("v").over(Window.partitionBy("g").orderBy("v")))
    assert got.count() == 6000
    assert got.select("g", "v", "nxt").exceptAll(want.select("g", "v", "nxt")).count() == 0
