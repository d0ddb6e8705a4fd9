"""Alignment against a plain one, document by document and pair by pair."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest

from quaystack.llm import alignment
from quaystack.llm.queries import op11_cross_tokenizer_alignment
from tests.conftest import SF_SMALL
from tests.llm.conftest import ROWS, frame
from tests.llm.test_token_counts import ALPHABETS

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EDGES = [" ", "  ", "\n", " \n ", "a  b", " a", "a ", "<|endoftext|> x", "▁", "a\xa0 b", "a \x85b"]


@pytest.fixture(scope="module")
def words():
    return alignment.tokenizers(*PATHS)


def plain(text, words):
    """(a ids, b ids, groups, links) of one text, read token by token."""
    if not text:
        return [], [], [], []
    raw = b" " + text.encode()
    ids = [s.encode([text])[0] for s in (words.a, words.b)]
    if not all(s.spells(i, raw) for s, i in zip((words.a, words.b), ids)):
        return [], [], [], []
    ends = []
    for side, made in zip((words.a, words.b), ids):
        at, here = 0, {}
        for n, token in enumerate(made):
            at += len(side.spell[token])
            here[at] = n
        ends.append(here)
    groups, links, i, j = [], [], 0, 0
    for end in sorted(ends[0].keys() & ends[1].keys()):
        x, y = ends[0][end], ends[1][end]
        groups.append((ids[0][i:x + 1], ids[1][j:y + 1]))
        links.append((ids[0][x], ids[1][y]))
        i, j = x + 1, y + 1
    return *ids, groups, links


def digest(groups):
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return hashlib.sha256(text.encode()).hexdigest() if groups else ""


def brute(rows, words):
    found = [(i, plain(t, words)) for i, t in rows]
    count = Counter(link for _, (*_, links) in found for link in links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(((i, len(a), len(b), len(groups), len(links),
                    sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                    digest(groups)) for i, (a, b, groups, links) in found), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_batches_equal_plain_alignment(words):
    rng = random.Random(4)
    some = [None, "", *EDGES]
    for _ in range(600):
        letters = rng.choice(ALPHABETS) + rng.choice(ALPHABETS)
        some.append("".join(rng.choice(letters) for _ in range(rng.choice((3, 10, 40, 300)))))
    found = alignment.align_batch(pa.array(some, pa.string()), words)
    want = [plain(t, words) for t in some]
    assert found.rows.tolist() == [i for i, w in enumerate(want) if w[0]]
    kept = [w for w in want if w[0]]
    for side in (0, 1):
        assert found.ids[side].tolist() == [t for w in kept for t in w[side]]
    assert alignment.digests(found, words.a, words.b) == [digest(w[2]) for w in kept]


def test_lanes_do_not_change_links(words):
    text = "the quick brown fox, naïve 日本語 " * 400
    side = [s.sizes[s.encode([text])[0]].cumsum() for s in (words.a, words.b)]
    docs = side[0][-1:]
    whole = alignment.lockstep(*side, docs, lane=1 << 30)
    for lane in (1, 7, 1024):
        assert all((x == y).all() for x, y in zip(alignment.lockstep(*side, docs, lane=lane), whole))


def test_frames(spark, docs, empty, words):
    assert rows_of(alignment.align(docs, *PATHS)) == brute(ROWS, words)
    assert alignment.align(empty, *PATHS).count() == 0


def test_blocks_do_not_change_results(spark, words, monkeypatch):
    rows = ROWS * 3 + [(20, "a▁b"), (21, "<|endoftext|> <s>")]
    docs = frame(spark, rows).repartition(3)
    for links in (1, 40, 1 << 20):
        assert rows_of(alignment.align(docs, *PATHS, block_links=links)) == brute(rows, words)


def test_tokens_and_cuts(spark, docs, words):
    for r in alignment.align(docs.filter("doc_id = 9"), *PATHS, tokens=True).collect():
        a, b, groups, _ = plain(dict(ROWS)[9], words)
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        made = [(a[i:j], b[k:m]) for i, j, k, m in zip(
            [0, *r["a_cuts"]], r["a_cuts"], [0, *r["b_cuts"]], r["b_cuts"])]
        assert made == groups


def test_query(spark, small, words):
    assert rows_of(op11_cross_tokenizer_alignment(spark, SF_SMALL)) == brute(small, words)
