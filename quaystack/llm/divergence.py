"""Source divergence audit by chunk factorisation.

How the words of a language differ between its sources. Terms are runs of
ASCII letters and non-ASCII characters, A-Z lower-cased. No term spans ASCII
white space, so a text is its white-space chunks, and most chunks occur over
and over:

1. Every document's chunks are counted. Documents are read in blocks of a
   task; a block numbers its distinct chunks, so a document is a list of
   numbers and counts.
2. The blocks' chunks meet by chunk. The first row of each globally distinct
   chunk is cut into its terms, once, and the others take them over.
3. The terms go back to the blocks, and each block turns numbers into terms:
   documents and occurrences of a term per (lang, source). These partial
   sums are added up over the corpus.

A hot chunk or source is one row a block, never one a document, and of the
documents only their packed numbers are shuffled, never their texts.

Smoothed shares are whole numbers: p = 1 + floor(10^9 (count + smooth) /
(N + smooth V)), in decimals of 38 digits, so nothing is rounded at any size.

Edge cases: null texts, languages and sources are empty strings. Every row
is a document, repeated rows are too. A document without terms still makes
its (lang, source) a group; a language without kept terms has V = 0, all its
values are 0. Ties in rank are broken by the item's UTF-8 bytes. Texts of
any length are read whole; one longer than a block is a block of its own.
Extra columns, whatever their names, are not read. An empty table gives no
rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystack.llm.common import column, ready
from quaystack.session import materialise

#: White-space chunks of a block, some more by its last document. It bounds
#: what a task holds and never changes a result.
BLOCK_CHUNKS = 5_000_000
#: Bits of a chunk's number in its block, and of a block's in its task.
NUMBER_BITS, BLOCK_BITS = 28, 12
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000


class _Numbers(dict):
    """Chunk -> its number in the block, in order of appearance."""

    def __missing__(self, chunk: bytes) -> int:
        number = self[chunk] = len(self)
        return number


def _pack(found: list[tuple[list[int], list[int]]]) -> bytes:
    """Numbers and counts of a few documents: numbers ascending inside each
    document, as differences."""
    sizes = [len(n) for n, _ in found]
    doc = np.repeat(np.arange(len(found)), sizes)
    number = np.concatenate([np.array(n, dtype=np.int64) for n, _ in found])
    times = np.concatenate([np.array(t, dtype=np.int64) for _, t in found])
    order = np.argsort(doc << 32 | number)
    number, times = number[order], times[order]
    steps = np.diff(number, prepend=0)
    first = (np.cumsum(sizes) - sizes)[np.array(sizes) > 0]
    steps[first] = number[first]
    return pa.compress(np.concatenate([steps, times]).astype("<i4").tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = int(sizes.sum())
    raw = np.frombuffer(pa.decompress(packed, 8 * n, "zstd"), dtype="<i4").astype(np.int64)
    steps, times = raw[:n], raw[n:]
    total = np.append(0, np.cumsum(steps))
    return total[1:] - np.repeat(total[np.cumsum(sizes) - sizes], sizes), times


def _blocks(docs: DataFrame, block_chunks: int) -> DataFrame:
    """Rows (block, langs, sources, sizes, packed) of a few documents each,
    and one row a block with its ``chunks`` in the order of their numbers."""
    schema = ("block long, langs array<string>, sources array<string>, sizes array<int>, "
              "packed binary, chunks array<string>")
    strings = pa.list_(pa.string())
    types = [pa.int64(), strings, strings, pa.list_(pa.int32()), pa.binary(), strings]
    names = ["block", "langs", "sources", "sizes", "packed", "chunks"]

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = block = TaskContext.get().partitionId() << BLOCK_BITS
        numbers, size = _Numbers(), 0

        def close() -> pa.RecordBatch:
            if block - first >> BLOCK_BITS or len(numbers) >> NUMBER_BITS:
                raise ValueError("a task has too many blocks, or a block too many chunks")
            # ASCII white space never cuts a character, so chunks are UTF-8.
            return row(block, None, None, None, None, [c.decode() for c in numbers])

        for batch in batches:
            found, start = [], 0
            raws = batch.column("text").cast(pa.binary()).to_pylist()
            for i, raw in enumerate(raws, 1):
                counted = Counter(raw.split())
                found.append((list(map(numbers.__getitem__, counted)), list(counted.values())))
                size += counted.total()
                if size < block_chunks and i < len(raws):
                    continue
                part = batch.slice(start, len(found))
                yield row(block, part.column("lang").to_pylist(), part.column("source").to_pylist(),
                          [len(n) for n, _ in found], _pack(found), None)
                found, start = [], i
                if size >= block_chunks:
                    yield close()
                    numbers, size, block = _Numbers(), 0, block + 1
        if numbers:
            yield close()

    return docs.mapInArrow(run, schema)


def _array(table: pa.Table, name: str) -> pa.Array:
    made = table.column(name).combine_chunks()
    return made.chunk(0) if isinstance(made, pa.ChunkedArray) else made


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


#: A block's sums. A term and its language are one string, "term lang": terms
#: hold no space, and of the many rows the smaller ones cost less disk.
_SUMS = "source string, word string, n_docs long, n_times long"


def _sum_block(docs: pa.Table, chunks: pa.Table) -> pa.Table:
    names = ["source", "word", "n_docs", "n_times"]
    if not docs.num_rows or not chunks.num_rows:
        return pa.table([pa.array([], t) for t in (*[pa.string()] * 2, *[pa.int64()] * 2)], names)
    # Number of a chunk -> its terms, as a ragged array.
    terms = pc.split_pattern(_array(chunks, "terms"), " ")
    ids, words = _codes(terms.flatten())
    lens = np.asarray(terms.value_lengths())
    place = _array(chunks, "number").to_numpy()
    first, many = (np.zeros(place.max() + 1, dtype=np.int64) for _ in range(2))
    first[place], many[place] = np.cumsum(lens) - lens, lens
    langs, lang_names = _codes(_array(docs, "langs").flatten())
    sources, source_names = _codes(_array(docs, "sources").flatten())
    done, held = 0, []
    # A few documents at a time, so that only sums grow with the block.
    for raw, sizes in zip(_array(docs, "packed"), _array(docs, "sizes")):
        sizes = sizes.values.to_numpy().astype(np.int64)
        at, times = _unpack(raw.as_py(), sizes)
        doc = np.repeat(np.arange(done, done + len(sizes)), sizes)
        done += len(sizes)
        # One entry per (document, chunk), then per (document, chunk, term).
        known = at < len(many)
        doc, at, times = doc[known], at[known], times[known]
        n = many[at]
        doc, times = np.repeat(doc, n), np.repeat(times, n)
        term = ids[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        # A document has a term once, however many of its chunks hold it.
        entry, in_doc = _summed(doc * len(words) + term, times)
        doc, term = np.divmod(entry, len(words))
        held.append(_summed((langs[doc] * len(words) + term) * len(source_names) + sources[doc],
                            in_doc, np.ones(len(doc), dtype=np.int64)))
    key, times, n_docs = _summed(*(np.concatenate(x) for x in zip(*held)))
    del held
    key, source = np.divmod(key, len(source_names))
    lang, word = np.divmod(key, len(words))
    word = pc.binary_join_element_wise(words.take(pa.array(word)), lang_names.take(pa.array(lang)), " ")
    return pa.table([source_names.take(pa.array(source)), word, pa.array(n_docs), pa.array(times)],
                    names)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and the sums of each one's values."""
    order = np.argsort(keys)
    keys = keys[order]
    start = np.flatnonzero(np.diff(keys, prepend=-1))
    return (keys[start], *(np.add.reduceat(v[order], start) if len(start) else v for v in values))


def _texts(df: DataFrame, **columns: str) -> DataFrame:
    return df.select(*(F.coalesce(column(c).cast("string"), F.lit("")).alias(n)
                       for n, c in columns.items()))


def term_sums(df: DataFrame, text_col: str = "text", lang_col: str = "lang",
              source_col: str = "source", block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """(source, word, n_docs, n_times) of the whole table as partial sums of
    blocks, to be added up; ``word`` is term, space, language."""
    ready(df.sparkSession)
    docs = _texts(df, lang=lang_col, source=source_col, text=text_col)
    blocks = materialise(_blocks(docs, block_chunks), "divergence-blocks", codec="zstd")
    # Rows of a chunk, in block order: the first one is cut into its terms
    # and the running frame hands them to the rows behind it.
    same = Window.partitionBy("chunk").orderBy("place")
    cut = F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), F.lit(0))
    named = (blocks.filter(F.col("chunks").isNotNull())
             .select("block", F.posexplode("chunks").alias("number", "chunk"))
             .select(F.shiftleft("block", NUMBER_BITS).bitwiseOR(F.col("number").cast("long"))
                     .alias("place"), "chunk")
             .withColumn("first", F.row_number().over(same))
             .withColumn("terms", F.when(F.col("first") == 1, cut))
             .withColumn("terms", F.last("terms", True).over(
                 same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
             .filter(F.size("terms") > 0)
             # Terms hold no space, and one string is a smaller row.
             .select(F.shiftright("place", NUMBER_BITS).alias("block"),
                     F.col("place").bitwiseAND(F.lit((1 << NUMBER_BITS) - 1)).alias("number"),
                     F.array_join("terms", " ").alias("terms")))
    rows = blocks.filter(F.col("chunks").isNull()).select(
        F.col("block").alias("of"), "langs", "sources", "sizes", "packed")
    return rows.groupBy("of").cogroup(named.groupBy("block")).applyInArrow(_sum_block, _SUMS)


def _share(count: Column, total: Column, kept: Column, smooth: int) -> Column:
    """1 + floor(10^9 (count + smooth) / (total + smooth kept)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    more = F.lit(smooth).cast("decimal(3,0)")
    over = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + more)
    return F.lit(1).cast("long") + F.call_function("div", over, wide(total) + more * wide(kept))


def audit(df: DataFrame, min_docs: int = 30, smooth: int = 5, top: int = 50, text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source",
          block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank). Part ``pair``: the
    distance to every other source of the language over its kept terms (those
    in ``min_docs`` of its documents). Part ``term``: the ``top`` kept terms
    whose share here exceeds the language's most."""
    by_group, by_lang = ["lang", "source"], ["lang"]
    # A term's sums meet once: rare terms fall there, and the others are added
    # up per source where they are.
    of_word = Window.partitionBy("word")
    cut = F.instr("word", " ")
    here = (term_sums(df, text_col, lang_col, source_col, block_chunks)
            .withColumn("d", F.sum("n_docs").over(of_word)).filter(F.col("d") >= min_docs)
            .groupBy("word", "source").agg(F.sum("n_times").alias("n_times"))
            .select(F.substring("word", cut + 1, F.length("word")).alias("lang"),
                    F.substring("word", F.lit(1), cut - 1).alias("term"), "source", "n_times"))
    here = materialise(here, "divergence-kept")
    everywhere = here.groupBy("lang", "term").agg(F.sum("n_times").alias("everywhere"))
    langs = here.groupBy("lang").agg(F.sum("n_times").alias("in_lang"))
    langs = langs.join(here.select("lang", "term").distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_kept")), by_lang)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = (_texts(df, lang=lang_col, source=source_col).distinct()
              .join(here.groupBy(*by_group).agg(F.sum("n_times").alias("in_group")), by_group, "left")
              .join(langs, by_lang, "left").select(*by_group, zero("in_group"), zero("in_lang"), zero("n_kept")))
    groups = materialise(groups, "divergence-groups")

    # Sources of a language in order: a term's shares are an array over them.
    # There are as many as a group has rows in the result.
    order = groups.groupBy("lang", "n_kept").agg(
        F.array_sort(F.collect_list(F.struct("source", "in_group"))).alias("sources"))
    shares = (here.groupBy("lang", "term").agg(F.map_from_entries(
                  F.collect_list(F.struct("source", "n_times"))).alias("times"))
              .join(order, by_lang)
              .select("lang", F.transform("sources", lambda s: _share(
                  F.coalesce(F.col("times")[s["source"]], F.lit(0)), s["in_group"], F.col("n_kept"), smooth))
                      .alias("shares")))
    apart = (shares.select("lang", "shares", F.posexplode("shares").alias("i", "p"))
             .select("lang", "i", "p", F.posexplode("shares").alias("j", "q")).filter("i < j")
             .groupBy("lang", "i", "j").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value")))
    both = (order.select("lang", "sources", F.posexplode("sources").alias("x", "s"))
            .select("lang", "x", F.col("s.source").alias("source"),
                    F.posexplode("sources").alias("y", "o")).filter("x <> y")
            .select("lang", "source", F.col("o.source").alias("item"),
                    F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")))
    pairs = both.join(apart, ["lang", "i", "j"], "left").select(
        *by_group, F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    p = _share(F.col("n_times"), F.col("in_group"), F.col("n_kept"), smooth)
    q = _share(F.col("everywhere"), F.col("in_lang"), F.col("n_kept"), smooth)
    terms = (here.join(everywhere, ["lang", "term"]).join(groups, by_group)
             .select(*by_group, F.lit("term").alias("part"), F.col("term").alias("item"),
                     (p - q).alias("value")).filter("value > 0"))
    ranked = Window.partitionBy(*by_group).orderBy(F.col("value").desc(), "item")
    rank = lambda df: df.withColumn("rank", F.row_number().over(ranked))
    return rank(pairs).unionByName(rank(terms).filter(F.col("rank") <= top))
