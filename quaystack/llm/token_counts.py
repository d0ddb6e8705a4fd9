"""Token counts of a byte-fallback BPE model by rank-synchronous merging.

A text is prepared as the model does it (one space in front, spaces as the
model's space mark) and cut into pre-tokens at places that no piece of the
vocabulary spans: before a run of spaces, around line feeds, and inside
words between two characters that stand side by side in no piece. Merges on
the two sides of such a place never meet, so pre-tokens are counted alone
and each distinct word once.

Pre-tokens are held as one ragged batch: an array of symbols, one of the
rank of each adjacent pair, and the starts of the sequences. A step finds
every sequence's lowest rank and applies it in all sequences at once, left
to right where it occurs more than once. That is what merging one pair at a
time gives as long as no pair made on the way ranks as low; a sequence where
one does takes its leftmost merge alone in that step. Sequences without a
pair left are counted and drop out. What survives counts one token a symbol;
a character that the model does not know counts its UTF-8 bytes.

Edge cases: a null or empty text has no tokens. Null ids, repeated rows and
extra columns pass through; of a column that is called like a result only
the result is kept. A text of any length is read whole: a long word is one
sequence of the batch. Strings that look like special tokens are plain text,
as the library reads them. An empty table gives no rows. The model file must
be readable where tasks run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystack.llm.common import column, ready

MARK = "▁"
#: Words that the memo holds before it starts anew, and their longest.
MEMO_WORDS, MEMO_CHARS = 1_000_000, 64
_NONE = np.iinfo(np.int32).max


class Pieces:
    """A vocabulary as arrays: characters, pairs that merge, cuts."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, kind = model.normalizer_spec, model.trainer_spec
        if (norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
                or not norm.escape_whitespaces or kind.treat_whitespace_as_suffix
                or kind.model_type != 2 or not kind.byte_fallback):
            raise ValueError("only identity-normalised BPE models with byte fallback are read")
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == p.NORMAL}
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not read")
        scores = np.array([p.score for p in model.pieces])
        # Equal scores are equal ranks: the leftmost such pair merges first.
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        size = len(model.pieces)
        #: Symbols beyond the pieces: an unknown character of 1 to 4 bytes.
        self.weight = np.ones(size + 5, dtype=np.int64)
        self.weight[size:] = np.arange(5)
        self.chars = {c: i for c, i in pieces.items() if len(c) == 1}
        self.unknown = size
        merges = {}
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                a, b = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = (rank[i], i)
        self.pairs = np.array(sorted(merges), dtype=np.int64)
        made = [merges[k] for k in self.pairs.tolist()]
        self.pair_rank = np.array([r for r, _ in made], dtype=np.int32)
        self.pair_makes = np.array([i for _, i in made], dtype=np.int64)
        # Which characters stand side by side in a piece.
        joint = sorted({c for p in pieces if len(p) > 1 for c in p})
        self._place = {c: i for i, c in enumerate(joint, 1)}
        self.together = np.zeros((len(joint) + 1, len(joint) + 1), dtype=bool)
        for p in pieces:
            for a, b in zip(p, p[1:]):
                self.together[self._place[a], self._place[b]] = True
        for p in pieces:
            if "\n" in p[1:] or (p[0] == "\n" and len(p) > 1) or re.search(f"[^{MARK}]{MARK}", p):
                raise ValueError("pieces that span line feeds or end in spaces are not read")

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``_NONE``: does not merge) and its place."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], _NONE), at

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all words, the starts of their sequences (a word is cut
        where no piece joins two characters), and each sequence's word."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        known, back = np.unique(points, return_inverse=True)
        names = [chr(c) for c in known.tolist()]
        table = np.array([self.chars.get(c, self.unknown + len(c.encode("utf-8", "surrogatepass")))
                          for c in names], dtype=np.int64)
        place = np.array([self._place.get(c, 0) for c in names], dtype=np.int64)[back]
        first = np.zeros(len(points), dtype=bool)
        first[np.cumsum(lens) - lens] = True
        first[1:] |= ~self.together[place[:-1], place[1:]]
        starts = np.flatnonzero(first)
        return table[back], starts, np.repeat(np.arange(len(words)), lens)[starts]


def merge_all(pieces: Pieces, sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Tokens that are left of each sequence; sequences are not empty."""
    counts = np.zeros(len(starts), dtype=np.int64)
    seq = np.arange(len(starts))            # which sequence each live row is
    rank = np.full(len(sym), _NONE, dtype=np.int32)
    makes = np.zeros(len(sym), dtype=np.int64)

    def refresh(at: np.ndarray) -> None:
        rank[at], makes[at] = pieces.find(sym[at], sym[at + 1])

    last = np.append(starts[1:], len(sym)) - 1
    inner = np.ones(len(sym), dtype=bool)
    inner[last] = False
    refresh(np.flatnonzero(inner))
    while len(starts):
        least = np.minimum.reduceat(rank, starts)
        done = least == _NONE
        if done.any():
            total = np.add.reduceat(pieces.weight[sym], starts)
            counts[seq[done]] = total[done]
            lens = np.diff(np.append(starts, len(sym)))
            keep = np.repeat(~done, lens)
            sym, rank, makes = sym[keep], rank[keep], makes[keep]
            lens, seq, least = lens[~done], seq[~done], least[~done]
            starts = np.cumsum(lens) - lens
            if not len(starts):
                break
        lens = np.diff(np.append(starts, len(sym)))
        owner = np.repeat(np.arange(len(starts)), lens)
        at = np.flatnonzero(rank == least[owner])
        # Of neighbouring hits (they share a symbol) every second one merges.
        run = np.ones(len(at), dtype=bool)
        run[1:] = (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])
        head = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - head) % 2 == 0]
        new = pieces.pair_makes[makes[at]]
        mine = owner[at]
        # Pairs made on the way: the neighbour on the left as it is by then,
        # the one on the right as it was before.
        left = at - 1
        has_left = (at > starts[mine])
        merged = np.zeros(len(sym), dtype=np.int64)
        merged[at] = new
        gone = np.zeros(len(sym), dtype=bool)
        gone[at + 1] = True
        before = np.where(gone[left], merged[left - 1], sym[left])
        right = at + 2
        has_right = right < starts[mine] + lens[mine]
        low = np.zeros(len(at), dtype=bool)
        low[has_left] = pieces.find(before[has_left], new[has_left])[0] <= least[mine[has_left]]
        low[has_right] |= (pieces.find(new[has_right], sym[right[has_right]])[0]
                           <= least[mine[has_right]])
        if low.any():
            alone = np.zeros(len(starts), dtype=bool)
            alone[mine[low]] = True
            first = np.ones(len(at), dtype=bool)
            first[1:] = mine[1:] != mine[:-1]
            use = first | ~alone[mine]
            at, new, mine = at[use], new[use], mine[use]
            gone[:] = False
            gone[at + 1] = True
        sym[at] = new
        stay = ~gone
        where = np.cumsum(stay) - 1
        ends = np.append(starts[1:], len(sym)) - 1
        rank[ends] = _NONE
        sym, rank, makes, owner = sym[stay], rank[stay], makes[stay], owner[stay]
        lens = lens - np.bincount(mine, minlength=len(starts))
        starts = np.cumsum(lens) - lens
        at = where[at]
        near = np.unique(np.concatenate([at, at - 1]))
        near = near[near >= 0]
        inside = (near + 1 < len(sym))
        near = near[inside]
        same = owner[near] == owner[near + 1]
        refresh(near[same])
        rank[starts + lens - 1] = _NONE
    return counts


class Counter:
    """Token counts of whole texts by one model."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.memo: dict[str, int] = {}
        self._cut = re.compile(r" *[^ \n]+|\n| +").findall

    def words(self, words: list[str]) -> list[int]:
        """Tokens of each word; its spaces stand in front of it."""
        sym, starts, word = self.pieces.symbols([w.replace(" ", MARK) for w in words])
        return np.bincount(word, merge_all(self.pieces, sym, starts),
                           len(words)).astype(np.int64).tolist()

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        get = self.memo.get
        # The mark itself is a space to the model.
        cut = [self._cut(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        known = [list(map(get, c)) for c in cut]
        new = list({w for c, k in zip(cut, known) if None in k for w, n in zip(c, k) if n is None})
        made = {}
        for i in range(0, len(new), 20_000):
            made.update(zip(new[i:i + 20_000], self.words(new[i:i + 20_000])))
        self.memo.update((w, n) for w, n in made.items() if len(w) <= MEMO_CHARS)
        return [sum(made[w] if n is None else n for w, n in zip(c, k)) if None in k else sum(k)
                for c, k in zip(cut, known)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One a process; workers keep it between tasks."""
    return Counter(path)


def count_tokens(df: DataFrame, path: str, limit: int = 4096, text_col: str = "text",
                 out_col: str = "n_tokens") -> DataFrame:
    """``df`` with the tokens of each row's whole text and ``over_limit``."""
    ready(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (out_col, "over_limit")]
    schema = T.StructType([*kept, T.StructField(out_col, T.LongType(), False)])
    names = [f.name for f in kept]
    if text_col not in names:
        raise ValueError(f"the text column {text_col} is called like a result")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counter(path)
        for batch in batches:
            found = pa.array(made.count(batch.column(at).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], schema.names)

    rows = df.select(*(column(n) for n in names)).mapInArrow(run, schema)
    return rows.withColumn("over_limit", column(out_col) > limit)
