"""Steps of an upload that grow with it: lots of zones, one pass of claims, narrow rows."""

import random
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quaystack.functions import location
from quaystack.operators import gold, placement, store, yard
from quaystack.plans import upload
from quaystack.schema import YardSpec
from quaystack.session import materialise, scratch_path
from tests.test_upload import AT, FIRST, SECOND, SMALL, lay

SPEC = YardSpec(n_blocks=4, n_bays=2, n_rows=2, max_height=3)


def _watch(monkeypatch, module) -> list[str]:
    stored, keep = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name, *a: stored.append(name) or keep(df, name, *a))
    return stored


def test_a_lot_of_zones_is_folded_as_each_by_itself(spark):
    rng = random.Random(5)
    todo = pd.DataFrame([(y, s, f"c{rng.randrange(900)}-{i}", float(rng.randrange(1, 50)), rng.randrange(1, 12))
                         for i, (y, s) in enumerate([(None, 20), (1, 20), (1, 40), (2, 20)] * 12)],
                        columns=["yard_id", "size", "id", "weight", "_departure"])
    seats = pd.DataFrame([(y, s, b, bay, 1, b != "S1", i, 0.1 * bay, len(d), 60.0 if d else None, d)
                          for y, s in ((None, 20), (1, 20), (1, 40)) for i, b in enumerate(("A", "S1"))
                          for bay, d in ((1, []), (2, [4]), (3, [2, 7]))],
                         columns=["yard_id", "size", "block_id", "bay", "row", "primary", "block_index", "distance",
                                  "height", "top_weight", "departures"])
    cols = ["id", "block_id", "bay", "row", "tier", "outcome", "stage"]
    got = placement.settle_lot(pa.Table.from_pandas(todo.astype({"yard_id": "Int64"})),
                               pa.Table.from_pandas(seats.astype({"yard_id": "Int64"})), cols, 3).to_pylist()
    want = []
    for (y, s), group in todo.groupby(["yard_id", "size"], dropna=False):
        here = seats[(seats["size"] == s) & (seats["yard_id"].isna() if pd.isna(y) else seats["yard_id"] == y)]
        group = group.sort_values(["_departure", "id"], ascending=[False, True]).assign(_n=range(len(group)))
        want += placement.settle(group, here, cols, 3).astype(object).where(lambda x: x.notna(), None).to_dict("records")
    key = lambda r: r["id"]
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) == 48
    assert {r["stage"] for r in got} == {1, 2, 3, 4, None}


def test_one_round_of_placement_stores_its_result_alone(spark, monkeypatch):
    stored = _watch(monkeypatch, placement)
    when = F.to_timestamp(F.lit("2026-03-05")).alias("departure_time")
    todo = spark.range(90).select(F.concat(F.lit("c"), "id").alias("id"), (F.col("id") % 40).alias("yard_id"),
                                  F.lit(20).alias("size"), F.lit(5.0).alias("weight"), F.lit("import").alias("type"), when)
    empty = spark.createDataFrame([], "yard_id long, block_id string, bay int, row int, tier int, size int, "
                                      "weight double, departure_time timestamp")
    piles = yard.all_piles(todo.select("yard_id").distinct(), None, empty, SPEC)
    rows = placement.place_batch(todo, piles, SPEC).collect()
    assert stored == ["place-round"] and len({r["id"] for r in rows}) == 90
    assert {r["outcome"] for r in rows} == {"PLACED_PRIMARY"}


def _records(spark, rng, n, prefix):
    days = [None, *(f"2026-03-{d:02d}" for d in range(1, 6))]
    rows = [(f"{prefix}{i}", 20, f"{rng.choice('ABC')}-00{rng.randrange(1, 4)}-A-0{rng.randrange(1, 4)}", rng.choice(days),
             float(rng.randrange(1, 3)), rng.randrange(2)) for i in range(n)]
    return spark.createDataFrame(rows, "id string, size int, slot string, departure_time string, weight double, "
                                       "yard_id long").withColumn("departure_time", F.to_timestamp("departure_time"))


def test_claims_decided_at_once_equal_the_fold_by_tiers(spark, monkeypatch):
    rng = random.Random(2)
    records = materialise(_records(spark, rng, 150, "r").withColumn("_d", F.col("departure_time")), "claims-test")
    held = yard.occupancy(_records(spark, rng, 12, "h").withColumn("type", F.lit("import")), SPEC, ["id"])
    held = materialise(held.unionByName(held.limit(1).select(*[
        F.lit("r7").alias(c) if c == "id" else F.lit(9).alias(c) if c == "yard_id" else F.col(c) for c in held.columns])),
        "held-test")
    stored = _watch(monkeypatch, placement)
    for existing in (None, held):
        both = []
        for order in (["departure_time", "weight"], ["_d", "weight"]):  # the same order
            stored.clear()
            out = placement.reconcile(records, SPEC, order, existing, keep=["weight"])
            both.append(sorted(tuple(map(str, r)) for r in out.select("id", *yard.SLOT, "outcome", "floating",
                                                                      "weight").collect()))
            assert stored == (["holders-claims", "holders-ties"] if order[0] == "departure_time" else
                              ["holders-tier1", "holders-tier2", "holders-tier3"])
        assert both[0] == both[1] and len(both[0]) == 150
        assert {r[6] for r in both[0]} >= {"PLACED", "WOULD_REHANDLE", "SLOT_TAKEN", "WRONG_ZONE"}


def test_pile_stats_neither_sort_nor_collect(spark):
    occ = spark.createDataFrame([(0, "A", 1, 1, 1, 20, 5.0, "2026-03-09"), (0, "A", 1, 1, 3, 40, None, None),
                                 (0, "A", 1, 2, 2, None, 7.0, "2026-03-01")],
                                "yard_id long, block_id string, bay int, row int, tier int, size int, weight double, "
                                "departure_time string").withColumn("departure_time", F.to_timestamp("departure_time"))
    stats = yard.pile_stats(occ, SPEC)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    day = datetime(2026, 3, 9)
    assert {tuple(map(str, r)) for r in stats.collect()} == {tuple(map(str, r)) for r in [
        (0, "A", 1, 1, 2, 3, day, [20, 40], None, 2, [day, None]),
        (0, "A", 1, 2, 1, 2, datetime(2026, 3, 1), [], 7.0, 1, [datetime(2026, 3, 1)])]}


def test_locations_are_padded_as_the_format_string_says(spark):
    rows = [("A", 1, 1, 1), ("S1", 999, 26, 99), ("B", 1000, 2, 3), ("C", 5, 27, 100), (None, 1, 1, 1), ("D", None, 2, 3),
            ("A", 3, None, 1), ("A", 3, 1, None), ("A", -1, 1, -2), ("A", 0, 1, 0)]
    df = spark.createDataFrame(rows, "b string, bay int, row int, tier int")
    old = F.format_string("%s-%03d-%s-%02d", "b", "bay", F.chr(F.col("row") + 64), "tier")
    got = df.select(location.format_location("b", "bay", "row", "tier").alias("t"), old.alias("o")).collect()
    assert [r["t"] for r in got] == [r["o"] for r in got]
    assert "lpad" in df.select(location.format_location("b", "bay", "row", "tier"))._jdf.queryExecution().analyzed().toString()


def test_columns_of_a_location_count_as_its_text(spark):
    rows = [("A", 1, 1, 1), ("S1", 2, 26, 7), ("A", 1000, 1, 1), ("A", 1, 27, 1), ("A", 1, 1, 8), ("[", 1, 1, 1)]
    df = spark.createDataFrame(rows, "block_id string, bay int, row int, tier int").withColumn("yard_id", F.lit(3))
    text = df.withColumn("slot", location.format_location("block_id", "bay", "row", "tier"))
    cols = ["yard_id", "block_id", "bay", "row", "tier"]
    parsed = gold.with_pile(text.drop("block_id", "bay", "row", "tier"), 7)
    at = lambda p: [tuple(r) if r["tier"] else None for r in p.select(*cols).collect()]
    assert at(gold.with_pile(df, 7, None)) == at(parsed) and at(parsed).count(None) == 4


def test_a_batch_of_single_ids_is_not_reduced(spark, monkeypatch):
    stored = _watch(monkeypatch, store)
    root = scratch_path(spark, "store")
    batch = lambda *rows: spark.createDataFrame(rows, "id string, weight double, slot string")
    store.upsert_into(root, batch(("a", 1.0, "A"), ("b", 2.0, None)), "2026-03-04 10:00:00")
    assert stored == []
    store.upsert_into(root, batch(("a", None, "B"), ("c", 3.0, None), ("c", None, "C")), "2026-03-04 11:00:00")
    assert stored == ["store-last"]
    assert {(r["id"], r["weight"], r["slot"]) for r in store.read(spark, root).collect()} == {
        ("a", 1.0, "B"), ("b", 2.0, None), ("c", 3.0, "C")}


def test_upload_stores_its_records_once(spark, monkeypatch):
    landing, root = scratch_path(spark, "landing"), scratch_path(spark, "terminal")
    upload.set_up(spark, root, SMALL)
    lay(spark, landing, 0, snapshot=FIRST)
    lay(spark, landing, 1, snapshot=SECOND)
    stored = _watch(monkeypatch, upload)
    assert upload.run(spark, landing, root, AT) == [0, 1]
    assert stored == ["upload-records", "upload-yard"] * 2
    bronze = spark.read.parquet(f"{root}/bronze")
    assert {r["upload"]: r["count"] for r in bronze.groupBy("upload").count().collect()} == {0: len(FIRST), 1: len(SECOND)}
    numbered = upload._numbered(bronze)
    assert dict(numbered.dtypes)["_rk"] == "bigint"
    key = lambda df: [(r["id"], r["slot"]) for r in df.orderBy("_rk").collect()]
    assert key(numbered) == key(bronze)
