"""Later steps store only what they need, and landings have no file a yard."""

import glob

import pandas as pd
from pyspark.sql import functions as F

from quaystack.operators import placement, ranking, rules, store, yard
from quaystack.schema import YardSpec
from quaystack.session import TASK_BYTES, fine_shuffles, scratch_path, small_tasks
from quaystack.sources import bronze


def test_reconcile_stores_records_once(spark, monkeypatch):
    records = spark.createDataFrame([("a", 20, "A-001-A-01", "2026-03-05", 0), ("b", 20, None, "2026-03-05", 0),
                                     ("c", 20, "A-099-A-01", "2026-03-05", 0), ("d", 20, "A-001-A-01", "2026-03-06", 0)],
                                    "id string, size int, slot string, departure_time string, yard_id long").withColumn(
        "departure_time", F.to_timestamp("departure_time"))
    stored, keep = [], placement.materialise
    monkeypatch.setattr(placement, "materialise", lambda df, name, *a: stored.append(name) or keep(df, name, *a))
    out = placement.reconcile(records, YardSpec(), ["departure_time"])
    assert {(r["id"], r["outcome"]) for r in out.collect()} == {
        ("a", "PLACED"), ("b", "NO_SLOT"), ("c", "SLOT_TAKEN"), ("d", "SLOT_TAKEN")}
    assert all(n.startswith("holders-") for n in stored)
    assert placement.reconcile(records.limit(0), YardSpec(), ["departure_time"]).count() == 0


def test_rehandle_risk_orders_narrow_rows(spark, monkeypatch):
    from quaystack.plans import catalog
    from tests.conftest import SF_SMALL
    stored, keep = [], ranking.materialise
    monkeypatch.setattr(ranking, "materialise", lambda df, *a: stored.append(df.columns) or keep(df, *a))
    catalog.rehandle_risk(spark, SF_SMALL)
    assert len(stored) == 1 and not {"weight", "_o_price", "_rk"} & set(stored[0])


def test_landed_upload_has_no_file_a_yard(spark):
    landing = scratch_path(spark, "landing")
    rows = spark.range(60, numPartitions=2).select(*[F.col("id").cast("string").alias(c) for c in bronze.RAW_COLUMNS],
                                                   F.when(F.col("id") > 0, F.col("id")).alias("yard_id"))
    bronze.write_upload(rows, landing, 3, "snapshot")
    assert len(glob.glob(f"{landing}/**/*.csv", recursive=True)) == 2
    from quaystack.plans import upload
    back = (spark.read.schema(upload.LANDED).option("header", "true").option("enforceSchema", "false")
            .option("nullValue", "").option("basePath", landing).csv(landing))
    assert {(r["id"], r["upload"], r["kind"], r["yard_id"]) for r in back.collect()} == {
        (str(i), 3, "snapshot", i or None) for i in range(60)}


def test_fold_counts_no_rehandles_where_nothing_leaves_earlier(monkeypatch):
    cols = ["id", "weight", "block_id", "bay", "row", "tier", "outcome", "stage", "_n"]
    seats = pd.DataFrame([("A", 1, 1, True, 0, 0.0, 0, None, []), ("A", 1, 2, True, 0, 0.2, 1, 9.0, [50]),
                          ("S1", 1, 1, False, 4, 0.4, 0, None, [])],
                         columns=["block_id", "bay", "row", "primary", "block_index", "distance", "height",
                                  "top_weight", "departures"])
    todo = pd.DataFrame({"id": list("abcd"), "weight": [20.0, 25.0, 8.0, 8.0], "_departure": [90, 80, 60, 40],
                         "_n": [1, 2, 3, 4]})
    searched, search = [], placement._Piles.cheapest
    monkeypatch.setattr(placement._Piles, "cheapest",
                        lambda self, *a: searched.append(a[1]) or search(self, *a))
    out = placement.settle(todo, seats, cols, 2)
    assert list(out[["id", "block_id", "row", "tier", "stage"]].itertuples(index=False, name=None)) == [
        ("a", "A", 1, 1, 1), ("b", "S1", 1, 1, 2), ("c", "A", 1, 2, 1), ("d", "A", 2, 2, 1)]
    assert searched == []
    heavy = pd.DataFrame({"id": ["e"], "weight": [8.0], "_departure": [70], "_n": [1]})
    out = placement.settle(heavy, seats[1:2], cols, 2)  # leaves after what stands there
    assert (out["outcome"][0], out["stage"][0], searched) == ("PLACED_PRIMARY_RELAXED", 3, [70])


def test_store_orders_each_row_once(spark, monkeypatch):
    """Only ids whose last row misses a field are looked through by field."""
    rows = [("one", 5.0, None, 1), ("two", 1.0, "A", 1), ("two", 2.0, "B", 2), ("gap", 1.0, "C", 1),
            ("gap", 3.0, None, 2), (None, None, "D", 1), (None, 4.0, None, 2)]
    batch = spark.createDataFrame(rows, "id string, weight double, slot string, seq int")
    want = {("one", 5.0, None), ("two", 2.0, "B"), ("gap", 3.0, "C"), (None, 4.0, "D")}
    full = store.last_per_id(batch, ["seq"])
    assert {(r["id"], r["weight"], r["slot"]) for r in full.collect()} == want
    plain = store.last_per_id(batch.filter("id in ('one', 'two')"), ["seq"])
    assert {(r["id"], r["weight"], r["slot"]) for r in plain.collect()} == {("one", 5.0, None), ("two", 2.0, "B")}
    assert "max_by" not in plain._jdf.queryExecution().executedPlan().toString()
    assert store.last_per_id(batch.limit(0), []).count() == 0


def test_records_are_shuffled_into_many_partitions(spark):
    from quaystack.operators import silver
    raw = spark.createDataFrame([("a", "20", "10", "2026-03-05", "import", None, 1)],
                                "id string, size string, weight string, departure_time string, type string, "
                                "slot string, seq int").withColumn("_ingestion_time", F.current_timestamp())
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert spark.conf.get(key, None) is None
    with fine_shuffles(spark):
        assert int(spark.conf.get(key)) >= 1024
        labelled = silver.process(raw.withColumn("_rk", F.col("seq")), ["seq"], keep=["seq"]).labelled
        assert "1024" in labelled._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(key, None) is None


def test_partitioned_sink_has_a_file_a_folder(spark):
    """Few, split shuffle partitions would each write a file in many folders."""
    from quaystack.operators import silver
    rows = spark.range(4000, numPartitions=4).select(
        F.col("id").cast("string").alias("id"), F.lit("import").alias("type"),
        F.date_add(F.lit("2026-03-01").cast("date"), (F.col("id") % 40).cast("int")).alias("departure_date"),
        F.sha2(F.col("id").cast("string"), 512).alias("text"))
    usual = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k"}
    was = {k: spark.conf.get(k) for k in usual}
    path = scratch_path(spark, "silver")
    try:
        for k, v in usual.items():
            spark.conf.set(k, v)
        silver.write_silver(rows, path)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert spark.read.parquet(path).count() == 4000
    assert len(glob.glob(f"{path}/**/*.parquet", recursive=True)) < 60  # two folders may share a split partition


def test_small_tasks_bound_what_a_task_takes(spark):
    advisory, split = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
    hashed = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    usual = {k: spark.conf.get(k) for k in (advisory, split, hashed)}
    try:
        spark.conf.set(split, "20k")  # a smaller one stays
        with small_tasks(spark):
            assert [int(spark.conf.get(k)) for k in (advisory, hashed, split)] == [TASK_BYTES, TASK_BYTES, 20 << 10]
        assert spark.conf.get(split) == "20k" and spark.conf.get(advisory) == usual[advisory]
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)


def test_silver_step_hashes_the_small_side_of_its_join(spark, monkeypatch):
    """Whole records are not sorted to be joined."""
    from quaystack.plans import context
    from tests.conftest import SF_SMALL
    plans, keep = [], context.materialise

    def stored(df, name, *a):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return keep(df, name, *a)

    monkeypatch.setattr(context, "materialise", stored)
    monkeypatch.setattr(context, "_MATERIALISED", {})
    key = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        context.silver(spark, SF_SMALL)
    finally:
        spark.conf.set(key, usual)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def test_row_positions_are_one_number_in_the_order_of_files_and_rows(spark):
    from quaystack.sources.fixtures import positions
    path = scratch_path(spark, "rows")
    spark.range(0, 40, numPartitions=4).write.parquet(path)

    def read(at):
        return spark.read.parquet(at).select("id", F.col("_metadata.file_path").alias("f"),
                                             F.col("_metadata.row_index").alias("r"))

    for at in (path, glob.glob(f"{path}/*.parquet")[0]):
        got = positions(read(at), "f", "r", "_rk")
        assert dict(got.dtypes)["_rk"] == "bigint" and got.columns == ["id", "_rk"]
        assert [r["id"] for r in got.orderBy("_rk").collect()] == [r["id"] for r in read(at).orderBy("f", "r").collect()]
        assert got.select("_rk").distinct().count() == got.count() == read(at).count()


def test_slots_are_found_without_being_shuffled(spark, monkeypatch):
    """Only containers and the stored zones are; equal ones have equal slots."""
    stored, keep = [], rules.materialise
    monkeypatch.setattr(rules, "materialise", lambda df, name, *a: stored.append(name) or keep(df, name, *a))
    spec = YardSpec(max_height=7)
    when = F.to_timestamp("departure_time").alias("departure_time")
    occupied = spark.createDataFrame(
        [(0, "A", 1, 1, 1, "x", 20, 30.0, "import", "2026-03-09")],
        "yard_id long, block_id string, bay int, row int, tier int, id string, size int, weight double, type string, "
        "departure_time string").withColumn("departure_time", when)
    piles = yard.all_piles(spark.range(1).select(F.col("id").alias("yard_id")), None, occupied, spec)
    todo = spark.createDataFrame(
        [("a", 0, 20, 5.0, "2026-03-05"), ("b", 0, 20, 5.0, "2026-03-05"), ("late", 0, 20, 5.0, "2026-03-10"),
         ("n", 0, 20, None, "2026-03-05"), ("m", 0, 20, 5.0, None), ("o", 7, 20, 5.0, "2026-03-05")],
        "id string, yard_id long, size int, weight double, departure_time string").withColumn("departure_time", when)
    found = rules.top_k_slots(todo, piles, spec, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert stored == ["zones"]
    assert plan.count("Exchange hashpartitioning(yard_id") == plan.count("Exchange") == 2
    assert "Aggregate" not in plan and "Broadcast" not in plan
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault(r["id"], []).append((r["stage"], r["block_id"], r["bay"], r["row"], r["tier"]))
    assert set(got) == {"a", "b", "late"} and all(len(v) == 2 for v in got.values())
    assert got["a"] == got["b"] and (1, "A", 1, 1, 1) not in got["a"] + got["late"]
    assert (1, "A", 1, 1, 2) not in got["late"]
