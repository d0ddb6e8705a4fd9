"""SimHash near-duplicates through one-wildcard segment variants.

A fingerprint is cut into ``max_bits // 2 + 1`` segments, so of two
fingerprints at most ``max_bits`` apart one segment differs by at most one
bit. Every distinct fingerprint is indexed under each segment's value and
under each of the segment's one-wildcard variants; an equality join brings
candidates together and the bit distance is verified. Fingerprints equal in
a segment meet under its value only, those one bit apart under that bit's
wildcard only (from opposite sides), so no pair is made twice by a segment.

Buckets over ``PAIR_BUCKET`` members are not expanded into pairs. Their
members go through an exact way that is linear in their number: each lists
itself and its 64 one-bit neighbours; all members that share such a point
are within two bits of each other, and any two within two bits share one,
so linking members to the smallest at each point loses no component link.

Equal fingerprints are one node, so copies never meet in pairs. Components
come from ``components.py``.

Edge cases: a null text counts as empty; texts without words have the
fingerprint zero and link like any other. Null ids are grouped but never
name a component that has another id. Repeated rows give repeated results.
Very long texts are hashed in slices. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystack.llm.common import column, ready, texts
from quaystack.llm.components import connected_components
from quaystack.session import materialise

#: Pairs are made only in buckets up to this size; larger ones go the exact
#: linear way, so the value changes the plan's cost and never the result.
PAIR_BUCKET = 64
SEED = 42
BITS = 64
_SLICE = 65_536


def fingerprint(text: str, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = iter((b" ".join(words),))
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, dtype=np.int64)
    left = n
    while left:
        take = min(left, _SLICE)
        hashes = np.fromiter((digest(next(grams), SEED) for _ in range(take)), np.uint64, take)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(take, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        left -= take
    set_bits = (2 * votes > n).astype(np.uint8)
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = 3) -> DataFrame:
    """``(id, fp)`` with the fingerprint's 64 bits as a signed long."""
    ready(df.sparkSession)
    rows = texts(df, id_col, text_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            signed = pa.array(np.array(marks, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), signed], ["id", "fp"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"id {id_type}, fp long")


def _bits(value: int) -> Column:
    """A 64-bit pattern as the signed long that Spark stores."""
    return F.lit(value - 2**64 if value >= 2**63 else value).cast("long")


def _variants(max_bits: int) -> Column:
    """Index entries of ``fp``: segment, wildcard bit, value, masked bit's side.

    ``wild`` is the bit taken as the wildcard, or -1 for the plain value.
    """
    count = max_bits // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    entries = []
    for lo, hi in zip(edges, edges[1:]):
        whole = (1 << hi) - (1 << lo)
        for wild in range(lo - 1, hi) if max_bits else [lo - 1]:
            masked = whole if wild < lo else whole & ~(1 << wild)
            side = F.lit(0) if wild < lo else F.getbit("fp", F.lit(wild)).cast("int")
            entries.append(F.struct(F.lit(lo).alias("seg"),
                                    F.lit(-1 if wild < lo else wild).alias("wild"),
                                    F.col("fp").bitwiseAND(_bits(masked)).alias("value"),
                                    side.alias("side")))
    return F.array(*entries)


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Distinct ``fps(fp)`` -> edges ``(a, b)`` whose components are those of
    the graph that links fingerprints at ``max_bits`` or fewer differing bits."""
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    key = ["seg", "wild", "value"]
    # A fingerprint becomes some sixty entries: the few bytes stored are dealt
    # out as widely as the shuffle that follows.
    wide = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = fps.repartition(wide, "fp").select("fp", F.explode(_variants(max_bits)).alias("e")).select("e.*", "fp")
    buckets = materialise(
        entries.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("side").alias("ones"),
             F.min("fp").alias("lo"), F.max("fp").alias("hi"))
        .filter("n > 1 and (wild < 0 or (ones > 0 and ones < n))"), "simhash-buckets")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= max_bits
    two = (buckets.filter((F.col("n") == 2) & near(F.col("lo"), F.col("hi")))
           .select(F.col("lo").alias("a"), F.col("hi").alias("b")))

    # The members of buckets of three and more, by the same equality join.
    members = entries.join(buckets.filter("n > 2").select(*key, "n"), key)
    mid = (members.filter(F.col("n") <= PAIR_BUCKET)
           .groupBy(*key).agg(F.collect_list("fp").alias("fps")))
    pairs = (mid.select(F.explode(F.flatten(F.transform(
        "fps", lambda a: F.transform(
            F.filter("fps", lambda b: (a < b) & near(a, b)),
            lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
        .select("p.a", "p.b"))

    crowd = members.filter(F.col("n") > PAIR_BUCKET).select("fp").distinct()
    neighbours = [F.col("fp"), *(F.col("fp").bitwiseXOR(_bits(1 << i)) for i in range(BITS))]
    points = crowd.select("fp", F.explode(F.array(*neighbours)).alias("point"))
    hubs = (points.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("b"))
            .filter("n > 1").select("point", "b"))
    stars = points.join(hubs, "point").filter("fp != b").select(F.col("fp").alias("a"), "b")
    return two.unionByName(pairs).unionByName(stars)


def _grouped(signed: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, root, component)`` of every fingerprint of ``signed(id, fp)``;
    components that share their smallest id differ in ``root``."""
    nodes = materialise(signed.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(names, "root").select("fp", "root", "component", "least")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest id among all rows reachable through
    fingerprints at most ``max_bits`` apart, the row itself included.
    """
    signed = materialise(signatures(df, id_col, text_col, shingle), "simhash-signatures")
    named = _grouped(signed, max_bits).select("fp", "component")
    return signed.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of every component, all columns kept: of the rows that carry
    its smallest id (no id at all, if none has one) those of the smallest
    fingerprint, and of these the smallest row.

    Rows of different components stay apart whatever ids they share or lack:
    a row is known by its id and its fingerprint, not by the id alone.
    """
    signed = materialise(signatures(df, id_col, text_col, shingle), "simhash-signatures")
    kept = (_grouped(signed, max_bits).filter(F.col("least").eqNullSafe(F.col("component")))
            .groupBy("root").agg(F.min("fp").alias("__fp"), F.first("component").alias("__id")))

    @F.pandas_udf("long")
    def mark(batch: pd.Series) -> pd.Series:
        marks = [fingerprint(t, shingle) for t in batch]
        return pd.Series(np.array(marks, dtype=np.uint64).view(np.int64))

    # Else the join's null filter would be pushed below and mark every text twice.
    mark = mark.asNondeterministic()
    text = F.coalesce(column(text_col), F.lit(""))
    rows = df.select(F.struct(*[column(c) for c in df.columns]).alias("__row"),
                     column(id_col).alias("__i"), mark(text).alias("__f"))
    found = rows.join(kept, (F.col("__f") == F.col("__fp")) & F.col("__i").eqNullSafe(F.col("__id")),
                      "left_semi")
    return found.groupBy("__i", "__f").agg(F.min("__row").alias("__row")).select("__row.*")
