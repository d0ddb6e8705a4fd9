"""Bronze layer: raw CSV scan with lineage columns, batch write, archive.

The CSV is read with the fixed all-text schema. ``enforceSchema=false``
makes Spark check each file's header against the schema names, so a file
with reordered columns fails instead of being silently bound by position.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystack.schema import RAW_COLUMNS, RAW_SCHEMA


#: Raw text keeps its white space; the writer would trim it otherwise.
KEEP_SPACE = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(RAW_SCHEMA)
            .option("header", "true").option("enforceSchema", "false")
            .option("nullValue", "").option("mode", "PERMISSIVE").options(**KEEP_SPACE)
            .csv(path))


def with_lineage(df: DataFrame, storage_mode: str, ingestion_time: datetime | None = None,
                 meta: str = "_metadata", keep: list[str] | tuple = ()) -> DataFrame:
    """Ingestion time, source file name and storage mode, plus ``_rk``: the
    record's position (file, split start, row order within the split), a
    deterministic first-row order for dedup once the batch is written.
    ``meta`` names the file-metadata struct (a stream selects it up front);
    ``keep`` names columns that stay beside the raw ones."""
    ts = (ingestion_time or datetime.now(timezone.utc)).strftime("%Y-%m-%d %H:%M:%S.%f")
    return df.select(
        *RAW_COLUMNS, *keep,
        F.lit(ts).cast("timestamp").alias("_ingestion_time"),
        F.col(f"{meta}.file_name").alias("_source_file"),
        F.lit(storage_mode).alias("_storage_mode"),
        F.struct(F.col(f"{meta}.file_path").alias("f"),
                 F.col(f"{meta}.file_block_start").alias("b"),
                 F.monotonically_increasing_id().alias("r")).alias("_rk"),
    )


def ingest(spark: SparkSession, path: str, storage_mode: str = "local",
           ingestion_time: datetime | None = None) -> DataFrame:
    return with_lineage(read_raw(spark, path), storage_mode, ingestion_time)


def with_lines(stored: DataFrame) -> DataFrame:
    """Add ``_line``, a record's number in its file from 1, to a stored
    bronze frame: the records of the file's splits before its own, plus its
    place in its split. It depends on the file alone, not on how Spark cut or
    numbered the tasks. Only the splits are counted, map-side, and summed up
    along a file; records are not sorted."""
    split = stored.groupBy(F.col("_rk.f").alias("_f"), F.col("_rk.b").alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_rk.r").alias("_r"))
    before = F.sum("_n").over(Window.partitionBy("_f").orderBy("_b")) - F.col("_n")
    starts = split.select("_f", "_b", (before + 1 - F.col("_r")).alias("_start"))
    on = (F.col("_rk.f") == F.col("_f")) & (F.col("_rk.b") == F.col("_b"))
    return stored.join(starts, on).withColumn("_line", F.col("_rk.r") + F.col("_start")).drop(
        "_f", "_b", "_start")


def write_batch(bronze: DataFrame, path: str) -> DataFrame:
    """Bronze batch directory (overwrite), read back for downstream use so
    the row keys are fixed by the stored copy."""
    bronze.write.mode("overwrite").parquet(path)
    return bronze.sparkSession.read.parquet(path)


def archive(bronze: DataFrame, path: str) -> None:
    """Immutable history: append, partitioned by ingestion date."""
    (bronze.withColumn("ingestion_date", F.to_date("_ingestion_time"))
     .write.mode("append").partitionBy("ingestion_date").parquet(path))


def write_landing(raw: DataFrame, path: str, key: str = "yard_id") -> None:
    """Lay raw records down as CSV files the way an upload would arrive, the
    records of one ``key`` together; adaptive execution joins small ones and
    splits a large one over files."""
    (raw.hint("rebalance", key).select(*RAW_COLUMNS)
     .write.mode("overwrite").option("header", "true").options(**KEEP_SPACE).csv(path))


def write_upload(raw: DataFrame, landing: str, upload: int, kind: str) -> None:
    """Lay records down as one side of an upload: CSV files of any yards in
    ``upload=<n>/kind=<kind>``, the yard a column behind the raw ones. Files
    are as many as the tasks that hold the records, not as the yards."""
    (raw.select(*RAW_COLUMNS, "yard_id")
     .write.mode("overwrite").option("header", "true").options(**KEEP_SPACE)
     .csv(f"{landing}/upload={upload}/kind={kind}"))
