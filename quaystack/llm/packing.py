"""Order-preserving packing of token streams by dynamic programming.

Documents are tokenised and laid end to end by ascending id. A program over
possible cuts chooses where sequences end: after a document, after a
sentence (a token that ends in . ! or ?), or, only in stretches without
either, at fixed steps. It minimises padding plus a penalty for every cut
inside a document and a small cost a sequence. For one cut the best
sequence start is a sliding-window minimum, kept by a monotone queue, so
time is linear in the cuts; starts at exactly a power of two tokens back,
which need no padding, are looked at on their own.

Spark deals the texts into ranges of ids and sorts each, the rows of one id
by a hash of their text, so that no id is one task's alone; a task streams its
range, solving a bounded run of tokens at a time and carrying what lies
past the last settled cut into the next run. No range waits for another: a
range's last sequence is split at powers of two where padding it would cost
more.

Where ranges start depends on the number of partitions, and with it where
sequences end and how they are numbered.

Edge cases: a null or empty text is its end token alone. Null ids come
first. Repeated rows are packed once each, next to each other. A document
longer than a sequence, or than a whole run, is cut into pieces. Other
columns are left aside, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystack.llm.common import larger, ready, texts

#: Words that the memo holds before it starts anew; bounds a worker's memory.
MEMO_WORDS = 1_000_000
MEMO_CHARS = 64
#: Parts that are encoded as one text, and the word that stands between them.
TOGETHER, BETWEEN = 500, "→"
#: Bytes of a batch, some more by its last rows: the larger, the fewer looks
#: into the memo.
BATCH_BYTES = 4 << 20
#: White space to Unicode but not to the vocabulary's own pattern.
_SEPARATORS = r"[\x1c-\x1f]"
#: A character past Latin-1, or one that makes contractions or is a mark and a
#: word character at once: such texts are cut at white space alone.
_WORDS_ONLY = r"[^\x00-\x{ff}]|['_]"
#: Runs of Latin-1 characters that are neither letters, numbers nor white space.
_MARKS = "[" + "".join(f"\\x{{{c:x}}}" for c in range(256)
                       if not (chr(c).isalnum() or chr(c).isspace() or chr(c) == "_")) + "]+"


class Costs(NamedTuple):
    """What the program minimises, in tokens."""

    window: int = 4096      # most tokens of a sequence
    sentence_cut: int = 4   # a cut inside a document, after a sentence
    forced_cut: int = 48    # a cut anywhere else
    sequence: int = 64      # every sequence, or it would pack powers of two alone
    gap: int = 512          # tokens without a boundary that allow forced cuts
    step: int = 64          # tokens between forced cuts
    run: int = 64 * 4096    # tokens solved at a time
    carry: int = 8          # last sequences of a run that are solved again

    def padding(self, length: int) -> int:
        return 0 if length & (length - 1) == 0 else self.window - length


# --- tokens -----------------------------------------------------------------


class WordTokens:
    """Ids of whole texts by a vocabulary whose pieces never span white space.

    Texts are cut where the vocabulary's own pattern always cuts, and each
    distinct part is encoded once by the tokenizers library: at white space,
    and in Latin-1 texts also around runs of punctuation. Latin-1 texts are
    lower-cased first, as the normaliser does character by character.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memo: dict[str, bytes] = {}
        self.between, = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        names = self.tokenizer.get_vocab()
        self.sentence_end = np.zeros(max(names.values()) + 1, dtype=bool)
        for name, token in names.items():
            if name.removesuffix("</w>")[-1:] in (".", "!", "?"):
                self.sentence_end[token] = True

    def _encode(self, items: list[str]) -> dict[str, bytes]:
        """Each item by the library, some hundreds in one text with a word
        between them that is one token; its id cuts the ids again."""
        joined = [w for w in items if BETWEEN not in w]
        groups = [joined[i:i + TOGETHER] for i in range(0, len(joined), TOGETHER)]
        made = self._alone([w for w in items if BETWEEN in w])
        for i in range(0, len(groups), 64):
            part = groups[i:i + 64]
            done = self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(g) for g in part],
                                                    add_special_tokens=False)
            for group, e in zip(part, done):
                ids = np.array(e.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == self.between).tolist()
                if len(cuts) + 1 != len(group):
                    made.update(self._alone(group))
                    continue
                raw = ids.tobytes()
                made.update(zip(group, (raw[4 * a:4 * b] for a, b in zip(
                    [0, *(c + 1 for c in cuts)], [*cuts, len(ids)]))))
        return made

    def _alone(self, items: list[str]) -> dict[str, bytes]:
        done = self.tokenizer.encode_batch_fast(items, add_special_tokens=False) if items else []
        return {w: array("I", e.ids).tobytes() for w, e in zip(items, done)}

    def parts(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """What may be encoded separately: the texts' places in the order
        taken, their parts end to end, and their number a text."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _SEPARATORS)
        marked = pc.and_not(pc.invert(whole), pc.match_substring_regex(texts, _WORDS_ONLY))
        spaced = pc.and_not(pc.invert(whole), marked)
        places, parts, counts = [], [], []
        for mask, cut in (
                (whole, lambda x: pa.array([[t] for t in x.to_pylist()], pa.list_(pa.string()))),
                (marked, lambda x: pc.utf8_split_whitespace(pc.replace_substring_regex(
                    pc.utf8_lower(x), _MARKS, r" \0 "))),
                (spaced, pc.utf8_split_whitespace)):
            places.append(np.flatnonzero(mask.to_numpy(zero_copy_only=False)))
            lists = cut(texts.filter(mask))
            parts.append(lists.flatten())
            counts.append(np.asarray(lists.value_lengths(), dtype=np.int64))
        return np.concatenate(places), pa.concat_arrays(parts), np.concatenate(counts)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        places, parts, many = self.parts(pa.array(batch, pa.string()))
        coded = parts.dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = list(map(self.memo.get, words))
        made = self._encode([w for w, ids in zip(words, known) if ids is None])
        self.memo.update((w, x) for w, x in made.items() if len(w) <= MEMO_CHARS)
        known = [made[w] if ids is None else ids for w, ids in zip(words, known)]
        # Every part's ids, gathered from those of the distinct parts.
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[at]
        start = (np.cumsum(sizes) - sizes)[at]
        raw = flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        stops = 4 * np.append(0, np.cumsum(n))[np.cumsum(many)]
        out = [b""] * len(batch)
        for place, i, j in zip(places.tolist(), [0, *stops.tolist()], stops.tolist()):
            out[place] = raw[i:j]
        return out


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One a process; workers keep it between tasks."""
    return WordTokens(path)


# --- the program ------------------------------------------------------------


def _cuts(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray,
          costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a sequence may end, ascending from 0, and penalties."""
    n = len(ids)
    after = np.flatnonzero(sentence_end[ids]) + 1
    at = np.unique(np.concatenate([[0], after, ends, [n]]))
    gaps = np.flatnonzero(np.diff(at) > min(costs.gap, costs.window))
    step = min(costs.step, costs.window)
    forced = [np.arange(at[g] + step, at[g + 1], step) for g in gaps]
    hard = np.concatenate(forced) if forced else np.empty(0, dtype=at.dtype)
    every = np.unique(np.concatenate([at, hard]))
    price = np.full(len(every), costs.sentence_cut, dtype=np.int64)
    price[np.isin(every, hard)] = costs.forced_cut
    price[np.isin(every, ends)] = 0
    return every, price


def best_cuts(at: np.ndarray, price: np.ndarray, costs: Costs = Costs()) -> list[int]:
    """The cheapest chain of cuts from the first position to the last.

    ``least[j]`` is the cost of everything before cut j. A sequence from cut
    i to cut j of any length costs window - (at[j] - at[i]), so the best i is
    the minimum of least[i] + at[i] over a sliding window; one of exactly a
    power of two costs nothing.
    """
    exact: dict[int, tuple[int, ...]] = {}
    size = 1
    while size <= costs.window:
        where = np.searchsorted(at, at - size)
        hit = np.flatnonzero(at[where] == at - size)
        for j, i in zip(hit.tolist(), where[hit].tolist()):
            exact[j] = (*exact[j], i) if j in exact else (i,)
        size *= 2
    pos, fee = at.tolist(), (price + costs.sequence).tolist()
    least, back = [0] * len(pos), [0] * len(pos)
    # The queue: keys least + at, ascending, and their cuts, from ``head`` on.
    keys, cuts, head = [pos[0]], [0], 0
    window = costs.window
    for j in range(1, len(pos)):
        here = pos[j]
        while pos[cuts[head]] < here - window:
            head += 1
        cost, start = keys[head] + window - here, cuts[head]
        if j in exact:
            for i in exact[j]:
                if least[i] < cost:
                    cost, start = least[i], i
        cost += fee[j]
        least[j], back[j] = cost, start
        key = cost + here
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            cuts.pop()
        keys.append(key)
        cuts.append(j)
    chain_, j = [], len(pos) - 1
    while j:
        chain_.append(pos[j])
        j = back[j]
    return chain_[::-1]


def _split_tail(start: int, end: int, costs: Costs) -> list[int]:
    """The last sequence's cuts: powers of two where padding costs more."""
    left = end - start
    parts = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    if costs.padding(end - start) <= (len(parts) - 1) * (costs.sequence + costs.forced_cut):
        return [end]
    return (start + np.cumsum(parts)).tolist()


class _Doc(NamedTuple):
    row: object     # its id
    first: int      # position of its first id that is in the run
    skipped: int    # ids of it before that
    total: int


def pack_stream(docs: Iterator[tuple[object, bytes]], sentence_end: np.ndarray,
                costs: Costs = Costs()) -> Iterator[tuple]:
    """``(id, ids)`` in order -> pieces ``(id, start, length, ids bytes, total,
    sequence, offset)``, sequences numbered from 0."""
    number = 0
    held: list[_Doc] = []
    raws: list[bytes] = []
    n = 0

    def solve(last: bool):
        nonlocal number, held, raws, n
        ids = np.frombuffer(b"".join(raws), dtype="<u4")
        ends = np.array([d.first + d.total - d.skipped for d in held])
        ends = ends[ends <= len(ids)]
        at, price = _cuts(ids, ends, sentence_end, costs)
        cuts = best_cuts(at, price, costs)
        if last:
            head = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + _split_tail(head, cuts[-1], costs)
        else:
            cuts = cuts[:-costs.carry]
        start, d = 0, 0
        for cut in cuts:
            offset = 0
            while offset < cut - start:
                doc = held[d]
                here = start + offset
                stop = min(cut, doc.first + doc.total - doc.skipped)
                yield (doc.row, doc.skipped + here - doc.first, stop - here,
                       ids[here:stop].tobytes(), doc.total, number, offset)
                offset += stop - here
                if stop == doc.first + doc.total - doc.skipped:
                    d += 1
            start, number = cut, number + 1
        rest = []
        for doc in held[d:]:
            gone = max(0, start - doc.first)
            rest.append(doc._replace(first=doc.first + gone - start, skipped=doc.skipped + gone))
        held, raws, n = rest, [ids[start:].tobytes()], len(ids) - start

    for row, raw in docs:
        size = len(raw) // 4
        held.append(_Doc(row, n, 0, size))
        for i in range(0, len(raw), 4 * costs.run):  # a long document in slices
            raws.append(raw[i:i + 4 * costs.run])
            n += len(raws[-1]) // 4
            if n >= costs.run:
                yield from solve(False)
    if n:
        yield from solve(True)


# --- the operator -----------------------------------------------------------

_PIECES = ("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack(df: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id",
         text_col: str = "text", costs: Costs = Costs()) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id,
    offset. ``ids`` are little-endian unsigned 32-bit, as token files hold
    them. A sequence id is the task's number and the sequence's in it."""
    ready(df.sparkSession)
    place = F.col("id").asc_nulls_first(), F.col("hash")
    ordered = (texts(df, id_col, text_col).withColumn("hash", F.xxhash64("text"))
               .repartitionByRange(*place).sortWithinPartitions(*place, "text").drop("hash"))
    id_type = ordered.schema["id"].dataType.simpleString()
    names = ["id", *(c.split()[0] for c in _PIECES.split(", "))]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(path)
        base = TaskContext.get().partitionId() << 40

        def documents() -> Iterator[tuple[object, bytes]]:
            for batch in larger(batches, BATCH_BYTES):
                for row, raw in zip(batch.column("id").to_pylist(),
                                    words.encode(batch.column("text").to_pylist())):
                    yield row, raw + end

        types = [ordered_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(),
                 pa.int64()]
        pieces: list[tuple] = []
        for row, start, length, ids, total, number, offset in pack_stream(
                documents(), words.sentence_end, costs):
            pieces.append((row, start, length, ids, total, base + number, offset))
            if len(pieces) >= 1024:
                yield _batch(pieces, names, types)
                pieces = []
        if pieces:
            yield _batch(pieces, names, types)

    from pyspark.sql.pandas.types import to_arrow_type

    ordered_type = to_arrow_type(ordered.schema["id"].dataType)
    return ordered.mapInArrow(run, f"id {id_type}, {_PIECES}").withColumnRenamed("id", id_col)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
