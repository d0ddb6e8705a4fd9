"""Counts by rank-synchronous merging against the library."""

import random

import public_tokenizers
import pytest
import sentencepiece

from quaystack.llm import token_counts
from quaystack.llm.queries import op13_token_counts
from tests.conftest import SF_SMALL
from tests.llm.conftest import ROWS

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABETS = ["ab", "aab  \t\n", "abcdefghijklmnopqrstuvwxyz ", "▁ <0x41>\r\n=-_*/(){};\"'",
             "日本語 中文のテ", "éüßñ \xa0　", "a▁ \x00�😀", "==========   ", "theinga n"]
ODD = ["", "a", " ", "  ", "\n", "\n\n", " \n ", "a" * 5000, " " * 3000, "=" * 2000,
       "<s></s><unk>▁▁", " a  b   c    d     e", "▁", "a▁ b", "ab" * 4000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(5)
    for _ in range(1500):
        letters = rng.choice(ALPHABETS) + (rng.choice(ALPHABETS) if rng.random() < 0.5 else "")
        yield "".join(rng.choice(letters) for _ in range(rng.choice((3, 10, 40, 200))))


def test_counts_equal_the_library(library):
    every = ODD + list(texts())
    every.append("".join(random.Random(2).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)))
    assert token_counts.counter(PATH).count(every) == list(map(len, library.encode(every)))


def test_a_full_memo_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 5)
    monkeypatch.setattr(token_counts, "MEMO_CHARS", 3)
    some = list(texts())[:200]
    made = token_counts.Counter(PATH)
    for i in range(0, len(some), 20):
        assert made.count(some[i:i + 20]) == list(map(len, library.encode(some[i:i + 20])))


def test_frames(spark, docs, empty, library):
    made = token_counts.count_tokens(docs, PATH, limit=30)
    assert made.columns == [*docs.columns, "n_tokens", "over_limit"]
    got = sorted(((r["doc_id"], r["n_tokens"], r["over_limit"]) for r in made.collect()), key=str)
    want = [(i, len(library.encode(t or "")), len(library.encode(t or "")) > 30) for i, t in ROWS]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(empty, PATH).count() == 0


def test_a_column_called_like_a_result_gives_way(spark, docs):
    clash = docs.withColumn("n_tokens", docs["n_chars"])
    made = token_counts.count_tokens(clash, PATH)
    assert made.columns.count("n_tokens") == 1 and made.filter("n_tokens is null").count() == 0


def test_query(spark, small, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"])
           for r in op13_token_counts(spark, SF_SMALL).collect()}
    ids = library.encode([t for _, t in small])
    assert got == {i: (len(t.encode()), len(x), len(x) > 4096) for (i, t), x in zip(small, ids)}
