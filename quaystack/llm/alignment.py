"""Alignment of two tokenisations of the same text, and how often ids meet.

A text is encoded by a byte-level BPE (A, with a space in front) and by a
piece model (B, which puts the space there itself). Tokens are known by the
bytes they stand for; wherever a token of A and one of B end at the same
byte, the text is cut into groups and the two tokens are linked.

A batch of documents is aligned in lockstep: one NumPy vector holds a
pointer into A and one into B for every lane, and a step moves the pointer
whose token ends first, or both where they end together, which emits a link
and a cut. Lanes that are through are compacted away. A lane is a document,
or a stretch of ``LANE`` bytes of a longer one: where two ascending lists of
ends meet inside a stretch depends on that stretch alone.

The links of an id pair are counted over the whole corpus. A task numbers
the pairs of a block of documents, blocks are added up per pair, and the
totals join back to the blocks, one row a pair and block however often the
pair occurs; what a document needs is summed inside its block.

Edge cases: a text that is null or empty, or whose tokens of A or B do not
spell it (the piece model reads its own space mark as a space), has no
tokens: zeros and an empty digest. Strings of special tokens are plain text.
Null ids and repeated rows are rows of their own. Texts of any length are
read whole; one with more links than a block is a block of its own. Extra
columns, whatever their names, are not read. An empty table gives no rows.
The vocabulary files must be readable where tasks run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystack.llm.common import column, larger, ready
from quaystack.session import materialise

#: Links of a block, some more by its last batch. It bounds what a task
#: holds and never changes a result.
BLOCK_LINKS = 1 << 20
#: Bytes of a lane.
LANE = 1024
MARK = "▁"
#: Bytes of a batch, some more by its last rows, and characters of distinct
#: words that are encoded as one text.
BATCH_BYTES, TOGETHER = 5 << 20, 2_000
#: Spaces between two characters that are not white space. In a text without
#: a space beside other white space or at an edge, all of them are.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_WHITE = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
          r"\x{205f}\x{3000}]")
_ODD = f"^ | $| {_WHITE}|{_WHITE} "


def _byte_of() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself
    where it prints, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side(NamedTuple):
    """A tokenizer: ids of whole texts, and each id's bytes and text forms."""

    encode: Callable[[list[str]], list[list[int]]]
    spell: list[bytes]
    sizes: np.ndarray
    inner: np.ndarray   # the id in decimal and a comma
    last: np.ndarray    # the id in decimal and what ends its side of a group

    def spells(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.spell.__getitem__, ids)) == raw


def _side(encode, spell: list[bytes], mark: bytes) -> Side:
    text = [b"%d" % i for i in range(len(spell))]
    forms = [np.empty(len(spell), dtype=object) for _ in range(2)]
    forms[0][:], forms[1][:] = [t + b"," for t in text], [t + mark for t in text]
    return Side(encode, spell, np.array(list(map(len, spell)), dtype=np.int64), *forms)


class Ragged(NamedTuple):
    """Ids of A and of B, laid end to end, and how many each item has."""

    ids: tuple[np.ndarray, np.ndarray]
    counts: tuple[np.ndarray, np.ndarray]

    def take(self, at: np.ndarray) -> "Ragged":
        ids, counts = [], []
        for flat, n in zip(self.ids, self.counts):
            start, n = (np.cumsum(n) - n)[at], n[at]
            ids.append(flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            counts.append(n)
        return Ragged(tuple(ids), tuple(counts))


class Words:
    """Ids of whole texts by both tokenizers, word by word.

    No token of either spans the start of a space that stands between two
    characters which are not white space, and both read what lies between
    two such spaces alike anywhere. Each distinct stretch of a batch is
    therefore encoded once, by the libraries, some hundreds in one text,
    which is cut by the bytes of its tokens. A text with a stretch that one
    of the tokenizers does not spell has no tokens.
    """

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b

    def _together(self, words: list[str]) -> list[tuple[list, list, list, list]]:
        """Ids by A and B and their number a word; -1: not spelled."""
        text = " ".join(words)
        raw = b" " + text.encode()
        ids = [s.encode([text])[0] for s in (self.a, self.b)]
        if not all(s.spells(i, raw) for s, i in zip((self.a, self.b), ids)):
            if len(words) == 1:
                return [([], [], [-1], [-1])]
            half = len(words) // 2
            return self._together(words[:half]) + self._together(words[half:])
        if len(words) == 1:
            return [(*ids, [len(ids[0])], [len(ids[1])])]
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        return [(*ids, *(np.diff(np.searchsorted(np.cumsum(s.sizes[i]), ends, "right"), prepend=0)
                         for s, i in zip((self.a, self.b), ids)))]

    def encode(self, words: list[str]) -> Ragged:
        made, held, size = [], [], 0
        # A word at the edge of its text may begin or end in white space,
        # which would run into its neighbour's space.
        edge = [not w or w[0].isspace() or w[-1].isspace() for w in words]
        for word, alone in zip(words, edge):
            if held and (alone or size > TOGETHER):
                made += self._together(held)
                held, size = [], 0
            if alone:
                made += self._together([word])
            else:
                held.append(word)
                size += len(word) + 1
        if held:
            made += self._together(held)
        empty = np.empty(0, dtype=np.int64)
        flat = [np.concatenate([empty, *(np.asarray(x, dtype=np.int64) for x in part)])
                for part in (zip(*made) if made else [[]] * 4)]
        return Ragged((flat[0], flat[1]), (flat[2], flat[3]))


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The texts' stretches: places of the texts that have any, in the order
    taken, the stretches end to end and their number a text."""
    some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    odd = pc.and_(some, pc.fill_null(pc.match_substring_regex(texts, _ODD), False))
    plain = pc.and_not(some, odd)
    places, words, counts = [], [], []
    for mask, cut in ((plain, lambda x: pc.split_pattern(x, " ")),
                      (odd, lambda x: pa.array([_BETWEEN.split(t.as_py()) for t in x],
                                               pa.list_(pa.string())))):
        places.append(np.flatnonzero(mask.to_numpy(zero_copy_only=False)))
        lists = cut(texts.filter(mask))
        words.append(lists.flatten().cast(pa.string()))
        counts.append(np.asarray(lists.value_lengths(), dtype=np.int64))
    return np.concatenate(places), pa.concat_arrays(words), np.concatenate(counts)


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Words:
    """Both tokenizers, once a process."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    byte_of = _byte_of()
    names = a.get_vocab()
    spell_a = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        if all(c in byte_of for c in name):
            spell_a[i] = bytes(byte_of[c] for c in name)
    b = SentencePieceProcessor(model_file=b_path)
    spell_b = []
    for i in range(b.get_piece_size()):
        if b.is_byte(i):
            spell_b.append(bytes([int(b.id_to_piece(i)[3:-1], 16)]))
        elif b.is_control(i) or b.is_unknown(i):
            spell_b.append(b"")
        else:
            spell_b.append(b.id_to_piece(i).replace(MARK, " ").encode())
    if any(" " in s.decode("utf-8", "ignore").lstrip(" ") for s in spell_b):
        raise ValueError("pieces that hold a space behind other characters are not read")
    return Words(_side(lambda texts: [e.ids for e in a.encode_batch_fast(
                     [" " + t for t in texts], add_special_tokens=False)], spell_a, b"|"),
                 _side(lambda texts: b.encode(texts, num_threads=1), spell_b, b";"))


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, docs: np.ndarray,
             lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Positions in A and in B of the tokens that end together, ascending.

    ``ends_*`` are the ends of all documents' tokens, laid end to end;
    ``docs`` are the ends of the documents themselves."""
    sizes = np.diff(docs, prepend=0)
    lanes = -(-sizes // lane)
    first = np.repeat(docs - sizes, lanes)
    nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    low = first + nth * lane
    high = np.minimum(low + lane, np.repeat(docs, lanes))
    at_a, at_b = (np.searchsorted(e, low, "right") for e in (ends_a, ends_b))
    stop_a, stop_b = (np.searchsorted(e, high, "right") for e in (ends_a, ends_b))
    links_a, links_b = [], []
    live = (at_a < stop_a) & (at_b < stop_b)
    while True:
        if not live.all():
            at_a, at_b, stop_a, stop_b = at_a[live], at_b[live], stop_a[live], stop_b[live]
        if not len(at_a):
            break
        end_a, end_b = ends_a[at_a], ends_b[at_b]
        met = end_a == end_b
        links_a.append(at_a[met])
        links_b.append(at_b[met])
        at_a = at_a + (end_a <= end_b)
        at_b = at_b + (end_b <= end_a)
        live = (at_a < stop_a) & (at_b < stop_b)
    if not links_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Both lists ascend together, so each may be sorted by itself.
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


class Aligned(NamedTuple):
    """The documents of a batch that have tokens, laid end to end."""

    rows: np.ndarray                        # their places in the batch
    ids: tuple[np.ndarray, np.ndarray]      # tokens of A and of B
    stops: tuple[np.ndarray, np.ndarray]    # where each document's end
    links: tuple[np.ndarray, np.ndarray]    # the tokens that close a group
    groups: np.ndarray                      # number of groups before each document's end


def align_batch(texts: pa.Array, words: Words) -> Aligned:
    places, stretches, many = split(texts)
    coded = stretches.dictionary_encode()
    known = words.encode(coded.dictionary.to_pylist())
    at = coded.indices.to_numpy(zero_copy_only=False)
    # Texts with a stretch that is not spelled have no tokens.
    of = np.repeat(np.arange(len(many)), many)
    lost = np.zeros(len(many), dtype=bool)
    lost[of[known.counts[0][at] < 0]] = True
    keep = np.lexsort((np.arange(len(places)), places))
    keep = keep[~lost[keep]]
    first = np.cumsum(many) - many
    n = many[keep]
    at = at[np.repeat(first[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    spelled = Ragged(known.ids, tuple(np.maximum(c, 0) for c in known.counts))
    found = spelled.take(at)
    last = np.cumsum(n)
    stops = [np.append(0, np.cumsum(c))[last] for c in found.counts]
    ends = [np.cumsum(s.sizes[i]) for s, i in zip((words.a, words.b), found.ids)]
    links = lockstep(*ends, ends[0][stops[0] - 1] if len(keep) else np.empty(0, np.int64))
    return Aligned(places[keep], found.ids, tuple(stops), links,
                   np.searchsorted(links[0], stops[0] - 1, "right"))


def digests(found: Aligned, a: Side, b: Side) -> list[str]:
    """SHA-256 of each document's groups as text."""
    (ids_a, ids_b), (last_a, last_b) = found.ids, found.links
    parts = np.empty(len(ids_a) + len(ids_b), dtype=object)
    # A token of A stands behind the B tokens of earlier groups, one of B
    # behind the A tokens up to its own.
    end_a, end_b = last_a + 1, last_b + 1
    group_a = np.searchsorted(end_a, np.arange(len(ids_a)), "right")
    group_b = np.searchsorted(end_b, np.arange(len(ids_b)), "right")
    place_a = np.arange(len(ids_a)) + np.append(0, end_b)[group_a]
    place_b = np.arange(len(ids_b)) + end_a[group_b]
    parts[place_a], parts[place_b] = a.inner[ids_a], b.inner[ids_b]
    parts[place_a[last_a]], parts[place_b[last_b]] = a.last[ids_a[last_a]], b.last[ids_b[last_b]]
    cuts = [0, *(found.stops[0] + found.stops[1]).tolist()]
    return [hashlib.sha256(b"".join(parts[i:j].tolist())[:-1]).hexdigest()
            for i, j in zip(cuts, cuts[1:])]


def _list(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()),
                                    pa.array(values, kind))


_COUNTS = ["n_a", "n_b", "n_groups"]


def _blocks(df: DataFrame, a_path: str, b_path: str, block_links: int, tokens: bool) -> DataFrame:
    """Documents with the numbers of their id pairs in the block and how often
    each is linked, and one row a block with its ``pairs`` and ``counts``."""
    token_fields = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in (
        "a_ids", "b_ids", "a_cuts", "b_cuts")] if tokens else []
    numbers, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("block", T.LongType()), df.schema["id"],
        *(T.StructField(n, T.LongType()) for n in _COUNTS),
        T.StructField("groups_sha256", T.StringType()), *token_fields,
        T.StructField("at", numbers), T.StructField("times", numbers),
        T.StructField("pairs", longs), T.StructField("counts", longs)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizers(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        held: list[tuple[dict, np.ndarray, np.ndarray]] = []
        n_links = 0

        def close() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([k for _, k, _ in held])
            pairs, number = np.unique(keys, return_inverse=True)
            at = 0
            for columns, k, ends in held:
                # (document, pair) with how often it is linked there.
                doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                size = max(1, len(pairs))
                entry, times = np.unique(doc * size + number[at:at + len(k)], return_counts=True)
                at += len(k)
                stops = np.searchsorted(entry, np.arange(1, len(ends) + 1) * size)
                columns |= {"block": pa.array([block] * len(ends), pa.int64()),
                            "at": _list(entry % size, stops, pa.int32()),
                            "times": _list(times, stops, pa.int32())}
                yield _batch(columns, len(ends))
            yield _batch({"block": pa.array([block], pa.int64()),
                          "pairs": pa.array([pairs], pa.list_(pa.int64())),
                          "counts": pa.array([np.bincount(number, minlength=len(pairs))],
                                             pa.list_(pa.int64()))}, 1)

        def _batch(columns: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type)
                 for f in arrow], schema=arrow)

        for batch in larger(batches, BATCH_BYTES):
            found = align_batch(batch.column("text"), words)
            n = batch.num_rows
            (ids_a, ids_b), (last_a, last_b) = found.ids, found.links
            every = [np.zeros(n, dtype=np.int64) for _ in range(3)]
            for out, ends in zip(every, (*found.stops, found.groups)):
                out[found.rows] = np.diff(ends, prepend=0)
            sha = np.full(n, "", dtype=object)
            sha[found.rows] = digests(found, words.a, words.b)
            columns = {"id": batch.column("id"), "groups_sha256": pa.array(sha.tolist(), pa.string()),
                       **{name: pa.array(c) for name, c in zip(_COUNTS, every)}}
            links = np.cumsum(every[2])
            if tokens:
                # Cuts count the document's own tokens up to each group's end.
                before = [np.repeat(np.append(0, s[:-1])[:len(s)], np.diff(found.groups, prepend=0))
                          for s in found.stops]
                columns |= {"a_ids": _list(ids_a, np.cumsum(every[0]), pa.int32()),
                            "b_ids": _list(ids_b, np.cumsum(every[1]), pa.int32()),
                            "a_cuts": _list(last_a + 1 - before[0], links, pa.int32()),
                            "b_cuts": _list(last_b + 1 - before[1], links, pa.int32())}
            held.append((columns, ids_a[last_a] << 32 | ids_b[last_b], links))
            n_links += len(last_a)
            if n_links >= block_links:
                yield from close()
                held, n_links, block = [], 0, block + 1
        if held:
            yield from close()

    return df.mapInArrow(run, schema)


def _sum_block(docs: pa.Table, pairs: pa.Table, names: list[str]) -> pa.Table:
    """Adds each document's ``n_links``, ``n_best`` and ``count_sum``."""
    docs, pairs = docs.combine_chunks(), pairs.combine_chunks()
    size = pairs.num_rows + 1
    count, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    if pairs.num_rows:
        place = pairs.column("number").to_numpy()
        count[place] = pairs.column("count").to_numpy()
        best[place] = pairs.column("best").to_numpy()
    at, times = (docs.column(c).chunk(0) if docs.num_rows else pa.array([], pa.list_(pa.int32()))
                 for c in ("at", "times"))
    ends = np.cumsum(np.asarray(at.value_lengths()))
    at, times = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    sums = []
    for value in (times, times * best[at], times * count[at]):
        total = np.append(0, np.cumsum(value))
        sums.append(pa.array(total[ends] - total[np.append(0, ends[:-1])[:len(ends)]], pa.int64()))
    kept = docs.select([n for n in names if n in docs.column_names])
    for name, values in zip(("n_links", "n_best", "count_sum"), sums):
        kept = kept.append_column(name, values)
    return kept.select(names)


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          tokens: bool = False, block_links: int = BLOCK_LINKS) -> DataFrame:
    """One row a document: id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256; with ``tokens`` also both id lists and, for every group, how
    many tokens of A and B there are up to its end (``a_cuts``, ``b_cuts``)."""
    ready(df.sparkSession)
    docs = df.select(column(id_col).alias("id"), column(text_col).alias("text"))
    blocks = materialise(_blocks(docs, a_path, b_path, block_links, tokens), "alignment-blocks")
    numbered = blocks.filter(F.col("pairs").isNotNull()).select(
        "block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("number", "p")).select(
        "block", "number", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    # An id of B meets no more ids than A has, so its window is bounded.
    same_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    totals = (numbered.groupBy("pair").agg(F.sum("n").alias("count"))
              .withColumn("best", (F.col("count") == F.max("count").over(same_b)).cast("int")))
    named = numbered.join(totals, "pair").select("block", "number", "count", "best")
    rows = (blocks.filter(F.col("pairs").isNull()).drop("pairs", "counts")
            .withColumn("of", F.col("block")).drop("block"))
    fields = {f.name: f for f in blocks.schema.fields}
    long = lambda n: T.StructField(n, T.LongType())
    schema = T.StructType([
        fields["id"], long("n_a"), long("n_b"), long("n_groups"), long("n_links"), long("n_best"),
        long("count_sum"), fields["groups_sha256"],
        *(fields[n] for n in ("a_ids", "b_ids", "a_cuts", "b_cuts") if tokens)])
    names = schema.names
    made = rows.groupBy("of").cogroup(named.groupBy("block")).applyInArrow(
        lambda left, right: _sum_block(left, right, names), schema)
    return made.withColumnRenamed("id", id_col)
