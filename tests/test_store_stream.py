"""Store, stream, KPI document and the batch run: the branches that the
derived fixture alone would not reach."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quaystack.operators import gold, placement, rules, silver, store, yard
from quaystack.plans import batch
from quaystack.schema import RAW_COLUMNS, YardSpec
from quaystack.session import scratch_path
from quaystack.streaming import ingest

SPEC = YardSpec(n_blocks=4, n_bays=2, n_rows=1, max_height=3)
GOOD = [("C1", "20", "10", "2026-03-05", "import", "A-001-A-01"),
        ("C2", "40.0", "12.5", "3/7/2026 6:05", " EXPORT ", "C001A01"),
        ("C3", "20", "9", "2026-03-06T08:00:00", "Import", None)]
BAD = [("C1", "20", "11", "2026-03-09", "import", None), (None, "20", "1", "2026-03-05", "import", None),
       ("C4", "45", "10", "2026-03-05", "import", None), ("C5", "20", "abc", "2026-03-05", "export", None)]


def upload(spark, path, rows, columns=RAW_COLUMNS):
    (spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_COLUMNS)).select(*columns)
     .coalesce(1).write.mode("overwrite").option("header", "true").csv(path))


def test_upsert_last_value_of_each_field_wins(spark):
    root = scratch_path(spark, "store")
    first = spark.createDataFrame([("a", 1.0, "S"), ("b", 2.0, None)], "id string, weight double, slot string")
    store.upsert_into(root, first, stamp="2026-01-01 00:00:00")
    again = spark.createDataFrame([("a", 5.0, None, 1), ("a", 7.0, None, 2), ("c", None, "T", 1), ("c", 3.0, None, 2)],
                                  "id string, weight double, slot string, seq int")
    store.upsert_into(root, again, stamp="2026-01-02 00:00:00", order_cols=["seq"])
    rows = {r["id"]: (r["weight"], r["slot"], str(r["imported_at"])[:10]) for r in store.read(spark, root).collect()}
    assert rows == {"a": (7.0, "S", "2026-01-02"), "b": (2.0, None, "2026-01-01"), "c": (3.0, "T", "2026-01-02")}


def test_untouched_buckets_are_not_rewritten(spark):
    root = scratch_path(spark, "store")
    rows = spark.range(500).select(F.concat(F.lit("c"), "id").alias("id"), F.lit(1.0).alias("weight"))
    store.upsert_into(root, rows)
    files = lambda: {r["f"] for r in store.read(spark, root).select(
        F.col("_metadata.file_path").alias("f")).distinct().collect()}
    before = files()
    store.upsert_into(root, rows.limit(1).withColumn("weight", F.lit(2.0)))
    assert len(before - files()) == 1 and store.read(spark, root).count() == 500


def test_full_buckets_split_and_the_others_stay(spark, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 20)
    monkeypatch.setattr(store, "FIRST_BITS", 1)
    root = scratch_path(spark, "store")
    at = lambda i, w: (f"c{i}", float(w))
    want, bits = {}, []
    for n, ids in enumerate((range(30), range(25, 120), [5], range(110, 240))):
        before = store._latest(spark, root) or (0, {})
        store.upsert_into(root, spark.createDataFrame([at(i, n) for i in ids], "id string, weight double"))
        want |= dict(at(i, n) for i in ids)
        assert dict(store.read(spark, root).select("id", "weight").collect()) == want
        live = store._latest(spark, root)[1]
        bits.append(max(b.bit_length() - 1 for b in live))
        if len(ids) == 1:  # one bucket was written, and only it
            assert [b for b in live if live[b] != before[1].get(b)] == [
                b for b, v in live.items() if v == n + 1] and list(live.values()).count(n + 1) == 1
    assert bits[0] == store.FIRST_BITS < bits[1] < bits[3]
    rows = store.read(spark, root).groupBy("bucket").count().collect()
    assert max(r["count"] for r in rows) <= 3 * 20
    # Every row lies where a later upsert looks for it.
    held = store.read(spark, root).withColumnRenamed("bucket", "stored")
    assert store._bucketed(held, live).filter("bucket <> stored").count() == 0


def test_an_upsert_that_fails_midway_is_never_seen(spark, monkeypatch):
    """Neither while its rows are written nor before its manifest row."""
    root = scratch_path(spark, "store")
    rows = spark.range(300).select(F.concat(F.lit("c"), "id").alias("id"), F.lit(1.0).alias("weight"))
    store.upsert_into(root, rows)
    state = lambda: sorted(tuple(r) for r in store.read(spark, root).select("id", "weight").collect())
    before = state()
    broken = rows.withColumn("weight", F.when(F.col("id") == "c299", F.raise_error(F.lit("lost")).cast("double"))
                             .otherwise(F.lit(2.0)))
    with pytest.raises(Exception, match="lost"):
        store.upsert_into(root, broken)
    assert state() == before
    held = store.read(spark, root)
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("no manifest")))
        with pytest.raises(OSError):
            store.upsert_into(root, rows.withColumn("weight", F.lit(3.0)))
    assert state() == before
    store.upsert_into(root, rows.limit(200).withColumn("weight", F.lit(4.0)))
    assert [w for _, w in state()].count(4.0) == 200 and len(state()) == 300
    assert held.filter("weight = 1").count() == 300  # a reader keeps the version it began with


def test_an_empty_first_batch_makes_an_empty_store(spark):
    root = scratch_path(spark, "store")
    none = spark.createDataFrame([], "id string, weight double")
    store.upsert_into(root, none)
    assert store.read(spark, root).count() == 0
    store.upsert_into(root, spark.createDataFrame([("a", 1.0)], none.schema))
    assert store.read(spark, root).count() == 1


def test_reset_is_an_epoch(spark):
    root = scratch_path(spark, "store")
    assert store.read(spark, root) is None and store.epoch(spark, root) == store.OLDEST
    one = spark.createDataFrame([("a", 1.0)], "id string, weight double")
    store.upsert_into(root, one, stamp="2026-01-01 00:00:00")
    store.reset(spark, root, "2026-02-01 00:00:00")
    assert store.fresh(store.read(spark, root), store.epoch(spark, root)).count() == 0
    store.upsert_into(root, one, stamp="2026-03-01 00:00:00")
    assert store.fresh(store.read(spark, root), store.epoch(spark, root)).count() == 1


def test_lookup_falls_back_to_the_yard(spark):
    held = store.conform(spark.createDataFrame([("a", 20, None), ("b", 20, "B-001-A-01")],
                                               "id string, size int, slot string"))
    occ = spark.createDataFrame([(0, "A", 1, 1, 1, "a", 20, 5.0, "import", None), (0, "A", 2, 1, 1, "y", 40, 6.0, "export", None)],
                                "yard_id long, block_id string, bay int, row int, tier int, id string, size int, "
                                "weight double, type string, departure_time timestamp")
    ids = spark.createDataFrame([(i,) for i in "abyz"], "id string")
    got = {r["id"]: (r["size"], r["location"], r["status"]) for r in store.lookup(held, ids, occ).collect()}
    assert got == {"a": (20, "A-001-A-01", "yard"), "b": (20, "B-001-A-01", "yard"), "y": (40, "A-002-A-01", "yard")}


def test_batch_run_and_empty_status(spark):
    for rows, status, clean in ((GOOD + BAD, "SUCCESS", 3), (BAD[1:], "EMPTY", 0)):
        landing, out = scratch_path(spark, "landing"), scratch_path(spark, "run")
        upload(spark, landing, rows)
        r = batch.run(spark, landing, out, SPEC, "2026-03-04 10:00:00").first()
        assert (r["status"], r["total_raw"], r["total_cleaned"]) == (status, len(rows), clean)
        assert r["stored"] == r["document_containers"] == clean
        assert r["occupied_slots"] == (2 if clean else 0)


def test_document_of_one_row(spark):
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "run")
    upload(spark, landing, GOOD[:1])
    batch.run(spark, landing, out, SPEC, "2026-03-04 10:00:00")
    doc = gold.latest_kpis(spark, f"{out}/kpis").first()
    assert doc["weight_stats"]["stddev_t"] == 0.0 and doc["total_containers"] == 1


def test_merged_variance_does_not_cancel(spark):
    rows = spark.range(2000).select(
        F.concat(F.lit("c"), "id").alias("id"), (F.lit(1e8) + F.col("id") % 2).alias("weight"),
        F.when(F.col("id") % 3 == 0, 20).otherwise(40).alias("size"), F.lit("import").alias("type"),
        F.lit("2026-03-05").cast("timestamp").alias("departure_time"),
        F.lit("2026-03-01").cast("timestamp").alias("_ingestion_time"), F.lit(None).cast("string").alias("slot"))
    report = silver.with_scores(spark.createDataFrame([(1, 0, 0, 0, 1)], "total_raw long, invalid_nulls_removed long, "
                                                      "duplicates_removed long, invalid_domain_removed long, total_cleaned long"))
    assert gold.kpi_document(rows, report, 7).first()["weight_stats"]["stddev_t"] == 0.5


def test_stream_equals_batch_and_writes_every_layer(spark):
    landing, out, ck = (scratch_path(spark, n) for n in ("landing", "stream", "ckpt"))
    upload(spark, f"{landing}/upload-1", GOOD + BAD)
    ingest.run_ingest(spark, f"{landing}/upload-*", out, ck)
    upload(spark, f"{landing}/upload-2", GOOD + [("C9", "20", "3", "2026-03-05", "import", None)])
    ingest.run_ingest(spark, f"{landing}/upload-*", out, ck)
    clean = {(r["id"], r["batch_id"]) for r in spark.read.parquet(f"{out}/clean").collect()}
    assert clean == {("C1", 0), ("C2", 0), ("C3", 0), ("C9", 1)}
    for layer, n in (("bronze", 11), ("archive", 11), ("anomalies", 4), ("report", 2), ("ids", 4)):
        assert spark.read.parquet(f"{out}/{layer}").count() == n, layer
    assert spark.read.parquet(f"{out}/gold").agg(F.sum("count")).first()[0] == 4


def test_stream_refuses_a_reordered_header(spark):
    landing, out, ck = (scratch_path(spark, n) for n in ("landing", "stream", "ckpt"))
    upload(spark, f"{landing}/upload-1", GOOD, ["size", "id", *RAW_COLUMNS[2:]])
    with pytest.raises(Exception, match="(?i)header|STREAM"):
        ingest.run_ingest(spark, f"{landing}/upload-*", out, ck)


def _piles(spark, rows):
    """Occupancy from (block, bay, tier, size, weight, departure day)."""
    occ = spark.createDataFrame(
        [(0, b, bay, 1, t, f"F{b}{bay}{t}", size, w, "import", f"2026-03-{d:02d}") for b, bay, t, size, w, d in rows],
        "yard_id long, block_id string, bay int, row int, tier int, id string, size int, weight double, type string, "
        "departure_time string").withColumn("departure_time", F.to_timestamp("departure_time"))
    yards = spark.createDataFrame([(0,)], "yard_id long")
    return yard.all_piles(yards, None, occ, SPEC)


def _containers(spark, rows):
    return spark.createDataFrame([(i, 0, 20, w, f"2026-03-{d:02d}", "import") for i, w, d in rows],
                                 "id string, yard_id long, size int, weight double, departure_time string, type string"
                                 ).withColumn("departure_time", F.to_timestamp("departure_time"))


def test_search_reaches_every_stage(spark):
    """Primary piles hold light, early containers; one backup pile is open."""
    full = [("S1", 1, t, 20, 5.0, 9) for t in (1, 2, 3)]
    low = [(b, bay, 1, 20, 10.0, 9) for b in "AB" for bay in (1, 2)]
    piles = _piles(spark, low + full + [("S1", 2, 1, 20, 20.0, 15)])
    asked = _containers(spark, [("strict", 9.0, 8), ("backup", 15.0, 8), ("late", 9.0, 20), ("heavy", 30.0, 20)])
    best = {r["id"]: (r["stage"], r["block_id"], r["rehandles"])
            for r in rules.top_k_slots(asked, piles, SPEC, k=20).filter("rank = 1").collect()}
    assert best == {"strict": (1, "A", 0), "backup": (2, "S1", 0), "late": (3, "A", 1), "heavy": (4, "S1", 1)}
    counts = {r["id"]: tuple(r)[1:] for r in rules.stage_counts(asked, piles, SPEC).collect()}
    assert counts == {"strict": (4, 1, 0, 0), "backup": (0, 1, 0, 0), "late": (0, 0, 4, 1), "heavy": (0, 0, 0, 1)}


def test_search_that_ends_early_equals_one_over_all_piles(spark):
    """Relaxed stages on a yard of many piles, k from 1 to more than all."""
    import random
    rng = random.Random(2)
    spec = YardSpec(n_blocks=4, n_bays=12, n_rows=4, max_height=4)
    held = [(0, b, bay, row, t, f"F{b}{bay}{row}{t}", 20, float(rng.randrange(1, 50)), "import",
             f"2026-03-{rng.randrange(1, 28):02d}") for b in ("A", "B", "S1") for bay in range(1, 13)
            for row in range(1, 5) for t in range(1, rng.randrange(2, 5))]
    occ = spark.createDataFrame(held, "yard_id long, block_id string, bay int, row int, tier int, id string, "
                                      "size int, weight double, type string, departure_time string"
                                ).withColumn("departure_time", F.to_timestamp("departure_time"))
    piles = yard.all_piles(spark.createDataFrame([(0,)], "yard_id long"), None, occ, spec)
    asked = _containers(spark, [(f"c{i}", float(rng.randrange(1, 55)), rng.randrange(1, 28)) for i in range(40)])
    whole = {}
    for r in rules.top_k_slots(asked, piles, spec, k=1000).collect():
        whole.setdefault(r["id"], []).append(tuple(r))
    for k in (1, 3, 10):
        got = {}
        for r in rules.top_k_slots(asked, piles, spec, k=k).collect():
            got.setdefault(r["id"], []).append(tuple(r))
        key = lambda rows: sorted(map(str, rows))
        rank = rules.top_k_slots(asked, piles, spec, k=k).columns.index("rank")
        assert {i: key(v) for i, v in got.items()} == {
            i: key(x for x in v if x[rank] <= k) for i, v in whole.items()}


def test_search_answers_k_however_many_piles_are_empty(spark):
    piles = _piles(spark, [("A", 1, 1, 20, 10.0, 9)])
    asked = _containers(spark, [("x", 9.0, 8)])
    for k in (1, 2, 5, 50):
        assert rules.top_k_slots(asked, piles, SPEC, k=k).count() == min(k, 4)


def test_placement_obeys_the_rules_and_loses_no_one(spark):
    import random
    rng = random.Random(3)
    asked = _containers(spark, [(f"c{i}", float(rng.randrange(1, 50)), rng.randrange(1, 28)) for i in range(40)])
    piles = _piles(spark, [("A", 1, 1, 20, 10.0, 9), ("S1", 1, 1, 20, 4.0, 2)])
    placed = placement.place_batch(asked, piles, SPEC)
    rows = placed.collect()
    assert sorted(r["id"] for r in rows) == sorted(f"c{i}" for i in range(40))
    slots = [(r["block_id"], r["bay"], r["row"], r["tier"]) for r in rows if r["tier"]]
    assert len(slots) == len(set(slots)) and {r["outcome"] for r in rows} >= {"PLACED_PRIMARY", "UNPLACED"}
    weight = {("A", 1, 1, 1): 10.0, ("S1", 1, 1, 1): 4.0} | {s: r["weight"] for r in rows for s in [
        (r["block_id"], r["bay"], r["row"], r["tier"])] if r["tier"]}
    for r in rows:
        below = (r["block_id"], r["bay"], r["row"], (r["tier"] or 1) - 1)
        if r["tier"] and r["tier"] > 1:
            assert below in weight
            if r["stage"] != 4:
                assert r["weight"] <= weight[below]


def test_nothing_to_place(spark):
    piles = _piles(spark, [("A", 1, 1, 20, 10.0, 9)])
    assert placement.place_batch(_containers(spark, [("x", 1.0, 1)]).limit(0), piles, SPEC).count() == 0


def _unplaced_with_a_slot(rows, occupied, n_piles_of):
    """Rule check by hand: UNPLACED containers that some pile admits at the end."""
    tops = {}
    for block, bay, row, tier, weight, dep in sorted(
            [*occupied, *((r["block_id"], r["bay"], r["row"], r["tier"], r["weight"], r["departure_time"])
                          for r in rows if r["tier"])], key=lambda x: x[3]):
        _, _, least = tops.get((block, bay, row), (0, 0.0, dep))
        tops[block, bay, row] = (tier, weight, min(least, dep))
    left = [r for r in rows if r["outcome"] == "UNPLACED"]
    free = {b: n_piles_of - sum(k[0] == b for k in tops) for b in ("A", "B", "S1")}
    return [r["id"] for r in left if any(free.values()) or any(
        h < SPEC.max_height and (b == "S1" or r["weight"] <= w) for (b, _, _), (h, w, _) in tops.items()
        if b in free)]


def test_no_unplaced_container_has_a_slot(spark):
    """More containers than the zone has slots, few open piles, heavy ones first."""
    import random
    rng = random.Random(7)
    # Bay 1 of the primary blocks is full, so fewer piles are open than the zone has.
    full = [(b, 1, t, 20, 5.0, 9) for b in "AB" for t in range(1, SPEC.max_height + 1)]
    asked = _containers(spark, [(f"c{i}", float(rng.randrange(20, 50) if i % 3 else rng.randrange(1, 5)),
                                 28 if i % 3 else rng.randrange(1, 20)) for i in range(60)])
    rows = placement.place_batch(asked, _piles(spark, full), SPEC).collect()
    assert len(rows) == 60 and len({r["id"] for r in rows}) == 60
    when = datetime(2026, 3, 9)
    taken = [(b, bay, 1, t, w, when) for b, bay, t, _, w, _ in full]
    assert any(r["outcome"] == "UNPLACED" for r in rows)
    assert _unplaced_with_a_slot(rows, taken, SPEC.n_bays * SPEC.n_rows) == []
    backup = [r for r in rows if r["block_id"] == "S1"]
    assert len(backup) == SPEC.n_bays * SPEC.n_rows * SPEC.max_height


def _placed(asked, piles, **how):
    return sorted(tuple(r) for r in placement.place_batch(asked, piles, SPEC, **how).collect())


def test_rounds_do_not_change_the_placement(spark):
    """A hot (yard, size) goes through many rounds, a bounded number of jobs each."""
    import random
    rng = random.Random(11)
    asked = _containers(spark, [(f"c{i}", float(rng.randrange(1, 50)), rng.randrange(1, 28)) for i in range(80)])
    piles = _piles(spark, [("A", 1, 1, 20, 10.0, 9), ("A", 1, 2, 20, 9.0, 4), ("S1", 1, 1, 20, 4.0, 2)])
    whole = _placed(asked, piles)
    assert len(whole) == 80 and any(r[-2] == "UNPLACED" for r in whole)
    for n in (16, 40, 80, 81):
        assert _placed(asked, piles, per_round=n) == whole


def _jobs(spark, run, group: str) -> int:
    spark.sparkContext.setJobGroup(group, "jobs of a placement")
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_of_a_placement_do_not_grow_with_the_containers(spark):
    piles = _piles(spark, [("A", 1, 1, 20, 10.0, 9)])
    few, many = (_containers(spark, [(f"c{i}", float(i % 50 + 1), i % 27 + 1) for i in range(n)]) for n in (5, 400))
    counts = [_jobs(spark, lambda: placement.place_batch(a, piles, SPEC), f"jobs-{a.count()}") for a in (few, many)]
    assert max(counts) <= len(placement.STAGES) * YardSpec().max_height and counts[1] <= counts[0] + 2


def test_a_container_takes_the_slot_that_the_search_ranks_first(spark):
    """Placed one after the other, each on what ``top_k_slots`` names."""
    rows = [("late", 12.0, 25), ("heavy", 40.0, 20), ("light", 3.0, 20), ("early", 8.0, 5)]
    held = [("A", 1, 1, 20, 10.0, 9), ("B", 1, 1, 20, 20.0, 22), ("S1", 1, 1, 20, 30.0, 15)]
    got = {r["id"]: (r["stage"], r["block_id"], r["bay"], r["tier"]) for r in placement.place_batch(
        _containers(spark, rows), _piles(spark, held), SPEC).collect()}
    for i, w, d in sorted(rows, key=lambda r: (-r[2], r[0])):
        best = rules.top_k_slots(_containers(spark, [(i, w, d)]), _piles(spark, held), SPEC, k=1).first()
        assert got[i] == (best["stage"], best["block_id"], best["bay"], best["tier"])
        held.append((best["block_id"], best["bay"], best["tier"], 20, w, d))


def test_piles_with_holes_or_of_the_other_size_are_not_taken(spark):
    held = [(b, bay, t, 20, 9.0, 9) for b in "AB" for bay in (1, 2) for t in (1, 3)]
    held += [("S1", 1, 1, 40, 9.0, 9), ("S1", 2, 2, 20, 9.0, 9)]
    rows = placement.place_batch(_containers(spark, [("x", 1.0, 1)]), _piles(spark, held), SPEC).collect()
    assert [r["outcome"] for r in rows] == ["UNPLACED"]


def test_no_unplaced_container_of_the_fixture_has_a_slot(spark):
    from quaystack.plans import catalog
    from tests.conftest import SF_SMALL
    yard_now, _, placed = catalog._dual(spark, SF_SMALL)
    cols = ["id", *yard.SLOT, "size", "weight", "type", "departure_time"]
    final = yard_now.select(*cols).unionByName(placed.filter("tier is not null").select(*cols))
    moved = catalog._final_yard(spark, SF_SMALL)[0]
    for z, occ in ((placed, final), (catalog._batch(spark, SF_SMALL)[0], moved)):
        piles = yard.all_piles(catalog.ctx.yards(spark, SF_SMALL), yard.blocks_dim(spark, catalog.Y), occ, catalog.Y)
        left = z.filter("outcome = 'UNPLACED'").select("id", *rules.PROBE)
        open_to = rules.stage_counts(left, piles, catalog.Y)
        assert open_to.filter("n_stage1 + n_stage2 + n_stage3 + n_stage4 > 0").count() == 0
