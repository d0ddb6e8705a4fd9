"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystack.session import prepare

#: Rows in one Arrow batch. Texts may be long, so batches are kept small: a
#: Python worker holds one batch and its results at a time.
BATCH_ROWS = 256

#: The white space of the text contracts: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]"


def ready(spark: SparkSession) -> None:
    """Session settings of these operators.

    Workers import this package by name, so its folder joins their module
    path; on a cluster without that folder install the package there.
    """
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def column(name: str) -> Column:
    """A top-level column whose name may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` alone, null texts empty: other columns cannot clash."""
    return df.select(column(id_col).alias("id"),
                     F.coalesce(column(text_col), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def larger(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size`` bytes or a little more."""
    held, have = [], 0
    for batch in batches:
        held.append(batch)
        have += batch.nbytes
        if have >= size:
            yield pa.concat_batches(held)
            held, have = [], 0
    if held:
        yield pa.concat_batches(held)
