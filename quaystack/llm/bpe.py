"""Byte-level BPE encoding and decoding, exact and linear in the text.

A text is cut into pieces by the vocabulary's pattern. A piece's bytes are
mapped to Latin-1 characters, and one Aho-Corasick pass finds the longest
token at every byte. From there the encoder walks left to right taking the
longest token that may follow the one before, and steps back when none
may. Two adjacent tokens are compatible when undoing their merges, latest
first, never meets a pair across their border that merges earlier; this is
memoised. A sequence whose neighbours are all compatible is the one that
the merges produce. A position that proves a dead end is closed for good,
so each is tried once.

Edge cases: a null or empty text has no ids and decodes to no bytes. Null
ids, repeated rows and extra columns pass through; of a column called like
the decoded bytes only these are kept. A piece of any length is
encoded whole. Ids outside the vocabulary fail when decoded. The
vocabulary file must be readable where tasks run, as an installed package
is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quaystack.llm.common import column, ready, texts

#: Entries that a memo may hold before it starts anew; it bounds a worker's
#: memory and never changes a result.
MEMO_ENTRIES = 600_000
#: Longer stretches of text are encoded each time.
MEMO_CHARS = 64
#: A space that touches other white space, or white space besides space and
#: line feed: there the text is cut by the pattern alone.
_ODD = re.compile(r"\A | \Z|  |\n | \n|[^\S \n]")


class Vocabulary:
    """Tokens by rank with the merge that makes each."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        size = max(ranks.values()) + 1
        self.bytes: list[bytes | None] = [None] * size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.lens = [len(t) if t else 0 for t in self.bytes]
        self.left, self.right = list(range(size)), list(range(size))
        self.pairs: dict[tuple[int, int], int] = {}
        self._fit: dict[tuple[int, int], bool] = {}
        made = ahocorasick.Automaton()
        for rank, token in enumerate(self.bytes):
            if token and self._derive(rank, token):
                made.add_word(token.decode("latin-1"), rank)
        made.make_automaton()
        self.automaton = made
        self.shorter = [self._prefix(t) for t in self.bytes]

    def _derive(self, rank: int, token: bytes) -> bool:
        """Find the one merge that makes a token; False if no merges do."""
        if len(token) == 1:
            return True
        for cut in range(1, len(token)):
            a, b = self.ids.get(token[:cut], rank), self.ids.get(token[cut:], rank)
            if a < rank and b < rank and self._made(a) and self._made(b) and self._apart(a, b):
                self.pairs[a, b], self.left[rank], self.right[rank] = rank, a, b
                return True
        return False

    def _made(self, rank: int) -> bool:
        return self.lens[rank] == 1 or self.left[rank] != rank

    def _prefix(self, token: bytes | None) -> int:
        for cut in range(len(token or b"") - 1, 0, -1):
            rank = self.ids.get(token[:cut])
            if rank is not None and self._made(rank):
                return rank
        return -1

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging keeps ``a`` and ``b`` two tokens side by side."""
        over_a = over_b = len(self.bytes)
        while True:
            joint = self.pairs.get((a, b), len(self.bytes))
            # Of equal ranks the leftmost pair merges first: left of the
            # border that is a's own merge, on it the joint one.
            if joint < over_a and joint <= over_b and joint < len(self.bytes):
                return False
            undo_a, undo_b = self.right[a] != a, self.left[b] != b
            if undo_a and (a > b or not undo_b):
                over_a, a = a, self.right[a]
            elif undo_b:
                over_b, b = b, self.left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        known = self._fit.get((a, b))
        if known is None:
            if len(self._fit) >= MEMO_ENTRIES:
                self._fit.clear()
            known = self._fit[a, b] = self._apart(a, b)
        return known

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.ids.get(raw)
        if whole is not None:
            return [whole]
        lens, shorter, n = self.lens, self.shorter, len(raw)
        longest = [-1] * n
        for end, rank in self.automaton.iter(raw.decode("latin-1")):
            longest[end - lens[rank] + 1] = rank  # ends ascend: the last is longest
        out: list[int] = []
        open_ends = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            end = at + lens[token]
            if open_ends[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = shorter[token]
            if token < 0:  # nothing fits here: never come back
                open_ends[at] = 0
                token = out.pop()
                at -= lens[token]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class _Memo(dict):
    """Text -> its ids as little-endian 32-bit bytes, computed when missing."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Texts to ids by one vocabulary and pattern."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        find = regex.compile(pattern).findall
        piece = _Memo(lambda s: np.array(
            vocabulary.encode_piece(s.encode("utf-8")), dtype="<i4").tobytes())
        self._cut = lambda s: b"".join(map(piece.__getitem__, find(s)))
        # A piece may start with one space and never holds another, so a
        # space between two other characters always starts a piece: what
        # lies between two such spaces is encoded on its own.
        self._plain = _Memo(self._cut)
        self._spaced = _Memo(lambda s: self._cut(" " + s))

    def encode_bytes(self, text: str) -> bytes:
        if _ODD.search(text):
            return self._cut(text)
        first, *rest = text.split(" ")
        return self._plain[first] + b"".join(map(self._spaced.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a process; workers keep it between tasks."""
    return Encoder(Vocabulary(read_ranks(path)), pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every row's whole text."""
    ready(df.sparkSession)
    rows = texts(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path, pattern)
        for batch in batches:
            raws = [made.encode_bytes(t.as_py()) for t in batch.column("text")]
            ends = np.cumsum([0, *(len(r) // 4 for r in raws)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                           pa.array(np.frombuffer(b"".join(raws), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids], ["id", "ids"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids",
           out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each row's ids stand for."""
    ready(df.sparkSession)
    df = df.select(*(column(n) for n in df.columns if n != out_col))
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())])
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path, pattern).vocabulary
        for batch in batches:
            lists = batch.column(at)
            raw = [vocabulary.decode(x.values.to_numpy().tolist()) if x.is_valid else b""
                   for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())],
                                             schema.names)

    return df.mapInArrow(run, schema)
