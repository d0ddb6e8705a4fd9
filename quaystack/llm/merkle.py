"""Merkle fingerprints of documents over sections, paragraphs and leaves.

DataFrame functions only. A text is cut into paragraphs at line feeds and a
paragraph into leaves of up to eight words with the white space around
them, so the leaves joined give the text back. Every level hashes the level
below: leaf = SHA-256 of its characters, paragraph = of its leaf hashes,
section = of a run of paragraph hashes, root = of the section hashes. A
section ends after a paragraph whose hash starts with 0 or 1 (one in
eight), so sections are found from content and an edit moves none beyond
its own. Equal roots mean equal texts; walking down the differing branch
finds the first edited section, paragraph and leaf.

Edge cases: a null text counts as empty: one empty paragraph, no leaves.
Two trees without leaves are alike 1. Texts of any length are read whole.
Null ids sort before all others; rows of one id are neighbours, ordered by
a hash of their text and the text, and an id of many rows is spread over
blocks by that hash. Other columns are left aside, whatever their names. An
empty table gives no rows. Ids are integers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystack.llm.common import texts

_S, _W = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Up to eight words with the space before each, or the space that is left.
LEAF = f"(?:{_S}*+{_W}++){{1,8}}+|{_S}++"

#: Rows that one block of neighbouring ids should hold, and the most blocks.
#: Past the latter blocks hold more rows; a block's window spills to disk.
BLOCK_ROWS, MOST_BLOCKS = 500, 65_536
_FIRST_ID = -(2**63)


def _sha(level: str, body: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{level}:"), body), 256)


def leaves_of(text: Column) -> Column:
    """array<array<string>>: the leaf hashes of every paragraph."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)),
                              lambda leaf: _sha("leaf", leaf)))


def paragraphs_of(leaves: Column) -> Column:
    return F.transform(leaves, lambda hashes: _sha("paragraph", F.array_join(hashes, "")))


def sections_of(paragraphs: Column) -> Column:
    runs = F.array_join(F.transform(
        paragraphs, lambda h: F.when(h < "2", F.concat(h, F.lit("|"))).otherwise(h)), "")
    return F.transform(F.filter(F.split(runs, r"\|"), lambda run: run != ""),
                       lambda run: _sha("section", run))


def root_of(sections: Column) -> Column:
    return _sha("root", F.array_join(sections, ""))


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the struct ``name``: root, sections, paragraphs, leaves."""
    return (df.withColumn("__l", leaves_of(F.coalesce(F.col(text), F.lit(""))))
            .withColumn("__p", paragraphs_of(F.col("__l")))
            .withColumn("__s", sections_of(F.col("__p")))
            .withColumn(name, F.struct(root_of(F.col("__s")).alias("root"),
                                       F.col("__s").alias("sections"),
                                       F.col("__p").alias("paragraphs"),
                                       F.col("__l").alias("leaves")))
            .drop("__l", "__p", "__s"))


def merkle_trees(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, tree)`` for every row."""
    return with_tree(texts(df, id_col, text_col), "text", "tree").select(
        F.col("id").alias(id_col), "tree")


def likeness(a: str, b: str) -> Column:
    """Share of leaves that two trees have in common (Dice on distinct leaves)."""
    one, two = F.array_distinct(F.flatten(f"{a}.leaves")), F.array_distinct(F.flatten(f"{b}.leaves"))
    shared = F.size(F.array_intersect(one, two)) * F.lit(2.0)
    total = F.size(one) + F.size(two)
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def first_difference(a: str, b: str) -> Column:
    """Where tree ``b`` first leaves tree ``a``: 0-based section, paragraph and
    leaf in ``a``; null where the roots are equal."""
    def at(one: Column, two: Column) -> Column:
        same = F.zip_with(one, two, lambda x, y: x.eqNullSafe(y))
        return F.array_position(same, False) - 1

    paragraph = at(F.col(f"{a}.paragraphs"), F.col(f"{b}.paragraphs"))
    leaf = at(F.get(f"{a}.leaves", paragraph.cast("int")), F.get(f"{b}.leaves", paragraph.cast("int")))
    return F.when(F.col(f"{a}.root") != F.col(f"{b}.root"), F.struct(
        at(F.col(f"{a}.sections"), F.col(f"{b}.sections")).alias("section"),
        paragraph.alias("paragraph"), leaf.alias("leaf")))


def _at_most(order: Column, edges: np.ndarray) -> Column:
    """How many of the sorted ``edges`` are at most ``order``, in two steps."""
    step = math.isqrt(len(edges)) + 1
    below = lambda arr: F.size(F.filter(arr, lambda e: e <= order))
    start = F.greatest(below(F.lit(edges[::step])) - 1, F.lit(0)) * step
    return start + below(F.slice(F.lit(edges), start + 1, F.lit(step)))


def _block(order: Column, spread: Column, edges: np.ndarray) -> Column:
    """The block of a row. An id that fills several quantiles stands in
    ``edges`` as often: its rows are dealt over as many blocks by ``spread``,
    from 0 to 2^63."""
    single, times = np.unique(edges, return_counts=True)
    first = np.concatenate([[0], np.cumsum(times)[:-1]])
    here = _at_most(order, single)
    of = lambda values: F.get(F.lit(values), F.greatest(here - 1, F.lit(0)))
    share = F.least(F.floor(spread / F.lit(2.0**63) * of(times)), of(times) - 1)
    return F.when(here == 0, F.lit(-1)).otherwise(
        of(first) + F.when(of(single) == order, share).otherwise(of(times) - 1)).cast("long")


def with_next_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(id, text, next_text)``: the text of the next row by ascending id,
    after the last row that of the first.

    Rows are cut into blocks of neighbouring ids at approximate quantiles, an
    id of more rows than a block by its texts' hashes too. Texts are shuffled
    once, by block. A block's first row also goes to the block before as a
    guest, so every row finds its successor in its own block; no window runs
    over all rows.
    """
    rows = texts(df, id_col, text_col).withColumn(
        "ord", F.coalesce(F.col("id").cast("long"), F.lit(_FIRST_ID)))
    n = rows.count()
    if not n:
        return rows.select("id", "text", F.col("text").alias("next_text"))
    blocks = min(max(1, math.ceil(n / block_rows)), MOST_BLOCKS)
    cuts = rows.agg(F.percentile_approx("ord", [i / blocks for i in range(blocks)],
                                        max(10_000, 20 * blocks)).alias("q")).first()["q"]
    edges = np.array(sorted(cuts), dtype=np.int64)
    rows = rows.withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 1)).withColumn(
        "block", _block(F.col("ord"), F.col("hash"), edges))

    # One row a block, MOST_BLOCKS + 1 at most: small enough to send everywhere.
    heads = rows.groupBy("block").agg(F.min(F.struct("ord", "hash")).alias("head"))
    line = Window.orderBy("block")
    heads = heads.select(
        "block", "head", F.coalesce(F.lag("block").over(line), F.max("block").over(
            line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    first = (rows.join(F.broadcast(heads), "block")
             .filter((F.col("ord") == F.col("head.ord")) & (F.col("hash") == F.col("head.hash")))
             .groupBy("before").agg(F.min(F.struct("ord", "hash", "text", "id")).alias("r")))
    guests = first.select("r.id", "r.text", "r.ord", "r.hash", F.col("before").alias("block"),
                          F.lit(1).alias("guest"))
    near = Window.partitionBy("block").orderBy("guest", "ord", "hash", "text")
    return (rows.withColumn("guest", F.lit(0)).unionByName(guests)
            .withColumn("next_text", F.lead("text").over(near))
            .filter("guest = 0").select("id", "text", "next_text"))
