"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quaystack.llm import bpe
from tests.llm.conftest import ROWS

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pair(request):
    path = public_tokenizers.path(request.param)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(path),
                                special_tokens={})
    return bpe.encoder(path, PATTERN), library


def same(pair, text):
    own, library = pair
    ids = own.encode(text).tolist()
    assert ids == library.encode_ordinary(text)
    assert own.vocabulary.decode(ids) == text.encode()


def test_documents(pair, small):
    for _, text in [*ROWS, *small]:
        same(pair, text or "")


def test_white_space_and_odd_characters(pair):
    rng = random.Random(2)
    pool = list("ab'sT12 .,!\n\t  \r\x0b\x1c\x85\xa0 　éßñ日本🙂́_-") + [" "] * 8
    for _ in range(3000):
        same(pair, "".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = bpe.encoder(path, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.vocabulary.ids,
                                special_tokens={})
    assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_every_token_decodes_and_merges_are_exact(pair):
    """Each token's bytes encode as naive merging of its bytes would."""
    own, _ = pair
    ranks = own.vocabulary.ids
    rng = random.Random(3)

    def naive(raw):
        parts = [raw[i:i + 1] for i in range(len(raw))]
        while True:
            at = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                      if a + b in ranks), default=None)
            if at is None:
                return [ranks[p] for p in parts]
            i = at[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
    tokens = rng.sample(sorted(ranks), 1500)
    for a, b in zip(tokens, tokens[1:]):
        raw = a + b
        if raw not in ranks:
            assert own.vocabulary.encode_piece(raw) == naive(raw)
    for raw in (b"a" * 300, b"ab" * 200, bytes(range(256))):
        assert own.vocabulary.encode_piece(raw) == naive(raw)


def test_long_piece_is_linear_and_whole(pair):
    text = "abcdefghij" * 30_000
    ids = pair[0].encode(text)
    assert pair[0].vocabulary.decode(ids.tolist()) == text.encode()


def test_frames(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(path),
                                special_tokens={})
    rows = bpe.decode(bpe.encode(docs, path, PATTERN), path, PATTERN).collect()
    got = sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in rows), key=str)
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in ROWS), key=str)
    assert got == want
    assert bpe.decode(bpe.encode(empty, path, PATTERN), path, PATTERN).count() == 0


def test_query(spark, small):
    from quaystack.llm.queries import op3_byte_bpe
    from tests.conftest import SF_SMALL
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(path),
                                special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
           for r in op3_byte_bpe(spark, SF_SMALL).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, t in small:
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))
    assert got == want
    assert np.int32  # ids are 32-bit


def test_a_column_called_like_the_result_gives_way(spark, docs):
    from pyspark.sql import functions as F
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    clash = bpe.encode(docs, path, PATTERN).withColumn("decoded", F.lit("old"))
    made = bpe.decode(clash, path, PATTERN)
    assert made.columns.count("decoded") == 1 and made.filter(F.col("decoded") == F.lit(b"old")).count() == 0
