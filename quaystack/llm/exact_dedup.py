"""Exact duplicates by 128-bit content hash, bytes compared inside groups.

DataFrame functions only. Each row gets the MD5 (128 bits) of its
normalised text. Rows are grouped by that hash *and* the bytes, so two
texts that share a hash stay apart; the grouping combines on the map side,
so a group that holds a third of all rows crosses the shuffle as one row
per map task. Groups then carry hash and SHA-256 instead of the text, and
the narrow per-row index joins them by both (an equi-join that adaptive
execution can split for a hot group).

Edge cases: a null text counts as empty; empty texts are one group. Null
ids are rows like any other and sort first among ties. Of repeated rows
with one id and text exactly one is kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystack.llm.common import SPACE, column, texts
from quaystack.session import materialise


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     normalise: Callable[[Column], Column] | None = without_space,
                     prefer_longest: bool = True,
                     hash128: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha256, n_chars.

    The kept row of a group has the smallest id, or with
    ``prefer_longest`` the most code points and then the smallest id.
    ``normalise`` None compares the raw texts.
    """
    raw = texts(df, id_col, text_col)
    norm = normalise(F.col("text")) if normalise else F.col("text")
    rows = raw.select("id", F.length("text").cast("long").alias("n_chars"), norm.alias("norm"))
    keyed = rows.withColumn("h", hash128(F.col("norm")))
    rank = -F.col("n_chars") if prefer_longest else F.lit(0).cast("long")

    index = materialise(
        keyed.select("id", "n_chars", "h", F.sha2("norm", 256).alias("sha256")), "dedup-index")
    groups = (keyed.groupBy("h", "norm")
              .agg(F.count(F.lit(1)).alias("group_size"),
                   F.min(F.struct(rank.alias("r"), F.col("id"), F.col("n_chars"))).alias("keep"))
              .select("h", F.sha2("norm", 256).alias("sha256"), "group_size", "keep"))
    copies = index.groupBy("id", "n_chars", "h", "sha256").agg(F.count(F.lit(1)).alias("copies"))
    joined = copies.join(groups, ["h", "sha256"])
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return joined.withColumn("nth", nth).select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep.id"))
         & (F.col("n_chars") == F.col("keep.n_chars")) & (F.col("nth") == 1)).alias("kept"),
        "sha256", "n_chars")


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          **options) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    A kept row is found by id, text hash and length, so an id that several
    texts share loses none of them. Repeated rows become their smallest.
    """
    normalise = options.get("normalise", without_space)
    kept = (exact_duplicates(df, id_col, text_col, **options).filter("kept")
            .select(F.col(id_col).alias("__id"), F.col("sha256").alias("__sha"),
                    F.col("n_chars").alias("__n")))
    text = F.coalesce(column(text_col), F.lit(""))
    norm = normalise(text) if normalise else text
    rows = df.select(F.struct(*[column(c) for c in df.columns]).alias("__row"),
                     column(id_col).alias("__i"), F.sha2(norm, 256).alias("__sha"),
                     F.length(text).cast("long").alias("__n"))
    found = rows.join(kept, F.col("__i").eqNullSafe(kept["__id"])
                      & (rows["__sha"] == kept["__sha"]) & (rows["__n"] == kept["__n"]), "left_semi")
    return (found.groupBy("__i", "__sha").agg(F.min("__row").alias("__row"))
            .select("__row.*"))
