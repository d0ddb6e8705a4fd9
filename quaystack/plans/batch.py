"""One upload end to end: CSV -> bronze -> silver -> gold -> store -> yard.

Each layer is written below ``out`` and the next one reads it back. The
result is one row of counts with the run's status: SUCCESS, or EMPTY when no
record survives the silver rules (the document then says EMPTY too).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystack.operators import gold, silver, store, yard
from quaystack.schema import YardSpec
from quaystack.session import materialise, small_tasks
from quaystack.sources import bronze
from quaystack.streaming.ingest import FILE_ORDER


def run(spark: SparkSession, landing: str, out: str, spec: YardSpec, stamp: str,
        yard_id: int = 0) -> DataFrame:
    """Ingest the files of ``landing`` for one yard; returns the run's report."""
    raw = bronze.write_batch(bronze.ingest(spark, landing), f"{out}/bronze")
    bronze.archive(raw.drop("_rk"), f"{out}/archive")
    with small_tasks(spark):
        res = silver.SilverResult(materialise(silver.process(raw, FILE_ORDER).labelled, "batch-labelled"))
    clean = res.clean.drop("_rk")
    silver.append_anomalies(res.anomalies.drop("_rk"), f"{out}/anomalies")
    gold.write_summary(clean, f"{out}/gold")
    gold.write_kpi_document(gold.kpi_document(clean, res.report, spec.max_height), f"{out}/kpis")

    slotted = F.trim(F.coalesce(F.col("slot"), F.lit(""))) != ""
    store.upsert_into(f"{out}/store", clean.withColumn(
        "status", F.when(slotted, "yard").otherwise("expected")), stamp)
    held = store.read(spark, f"{out}/store")
    occupied = yard.occupancy(store.with_slot(held).withColumn("yard_id", F.lit(yard_id).cast("long")),
                              spec, ["departure_time", "weight", "id"])
    doc = gold.latest_kpis(spark, f"{out}/kpis")
    counts = gold.one_row(
        res.report.select("total_raw", "total_cleaned", "total_anomalies"),
        held.agg(F.count(F.lit(1)).alias("stored")),
        occupied.agg(F.count(F.lit(1)).alias("occupied_slots")),
        doc.select("status", F.col("total_containers").alias("document_containers")))
    return counts.select("status", "total_raw", "total_cleaned", "total_anomalies", "stored",
                         "occupied_slots", "document_containers")
