"""SimHash fingerprints and components against brute force."""

import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from quaystack.llm import simhash
from quaystack.llm.components import connected_components
from tests.llm.conftest import ROWS, frame


def reference_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
             .replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ")
             .replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, max_bits):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= max_bits:
            parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprints(small):
    for _, text in [*ROWS, *small]:
        assert simhash.fingerprint(text or "") == reference_fingerprint(text or "")


@pytest.mark.parametrize("max_bits", [0, 1, 2])
@pytest.mark.parametrize("pair_bucket", [2, 64])
def test_links_give_the_brute_force_components(spark, monkeypatch, max_bits, pair_bucket):
    """Chains, balls around a centre (hot buckets), and noise; with a tiny
    pair bucket nearly all goes through the crowded way."""
    monkeypatch.setattr(simhash, "PAIR_BUCKET", pair_bucket)
    rng = random.Random(5)
    fps = {0, 2**64 - 1}
    for _ in range(3):
        centre = rng.getrandbits(64)
        fps |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
    walk = rng.getrandbits(64)
    for _ in range(40):
        walk ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.3) * (1 << rng.randrange(64))
        fps.add(walk)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    want = brute_components(sorted(fps), max_bits)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in
             connected_components(simhash.links(df, max_bits)).collect()}
    got = {f: roots.get(signed(f), signed(f)) for f in fps}
    pairs = lambda m: {(a, b) for a, b in combinations(sorted(fps), 2) if m[a] == m[b]}
    assert pairs(got) == pairs(want)


def test_every_edge_is_a_link(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    far = simhash.links(df, 2).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2)
    assert far.count() == 0


def test_query_against_brute_force(spark, small):
    from quaystack.llm.queries import op4_simhash_near_dedup
    from tests.conftest import SF_SMALL
    fps = {i: reference_fingerprint(t) for i, t in small}
    comp = brute_components(sorted(set(fps.values())), 2)
    least = {}
    for i, f in fps.items():
        least[comp[f]] = min(i, least.get(comp[f], i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"])
           for r in op4_simhash_near_dedup(spark, SF_SMALL).collect()}
    assert got == {i: (f"{f:016x}", least[comp[f]]) for i, f in fps.items()}


def test_edge_cases(spark, docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert {by[i][0] for i in (3, 4, 5)} == {("0" * 16, 3)}
    assert by[1][0][1] == by[2][0][1] == by[7][0][1] == 1 and len(by[7]) == 2
    assert by[None][0][1] is None
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 6, 9, 10, None], key=str)
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_bits_outside_the_method(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_repeated_ids_collapse_to_one_row(spark):
    df = frame(spark, [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")])
    assert [r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()] == [1]


def test_texts_of_null_and_shared_ids_stay_apart(spark):
    """Different texts without an id or with one id; a near copy without an
    id gives way to the row that has one."""
    texts = ["the harbour crane lifts a box of grain at dawn", "nine quiet ledgers list the price of tin",
             "snow fell over the pass and closed the road north", "a violin was found beneath the attic floor"]
    df = frame(spark, [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]),
                       (None, texts[3]), (5, texts[2]), (8, texts[2])])
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df).collect()), key=str)
    assert kept == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3])], key=str)
