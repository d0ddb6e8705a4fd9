"""Merkle fingerprints against a plain Python tree."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quaystack.llm import merkle
from tests.llm.conftest import ROWS, frame

S = r"[\x20\x09-\x0D]"
LEAF = re.compile(f"(?:{S}*[^\\x20\\x09-\\x0D]+){{1,8}}|{S}+")


def sha(level, body):
    return hashlib.sha256(f"{level}:{body}".encode()).hexdigest()


def tree(text):
    leaves = [[sha("leaf", m[0]) for m in LEAF.finditer(p)] for p in (text or "").split("\n")]
    paragraphs = [sha("paragraph", "".join(x)) for x in leaves]
    sections, run = [], ""
    for h in paragraphs:
        run += h
        if h < "2":
            sections.append(sha("section", run))
            run = ""
    if run:
        sections.append(sha("section", run))
    return sha("root", "".join(sections)), sections, paragraphs, leaves


def test_trees_match(spark, docs, small):
    for df, rows in ((docs, ROWS), (frame(spark, small), small)):
        got = sorted((r["doc_id"], r["tree"]["root"], r["tree"]["sections"], r["tree"]["paragraphs"],
                      r["tree"]["leaves"]) if r["doc_id"] is not None else (-1, r["tree"]["root"], [], [], [])
                     for r in merkle.merkle_trees(df).collect())
        want = sorted((i, *tree(t)) if i is not None else (-1, tree(t)[0], [], [], []) for i, t in rows)
        assert got == want


def test_leaves_hold_the_whole_text(small):
    for _, text in [*ROWS, *small]:
        for p in (text or "").split("\n"):
            assert "".join(m[0] for m in LEAF.finditer(p)) == p


def test_next_text_over_many_blocks(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-10_000, 10_000), 400)
    rows = [(i, f"text {i}") for i in ids]
    got = {r["id"]: r["next_text"] for r in merkle.with_next_text(
        frame(spark, rows), block_rows=7).collect()}
    order = sorted(ids)
    assert got == {i: f"text {order[(n + 1) % len(order)]}" for n, i in enumerate(order)}


def test_next_text_of_ties_nulls_and_repeated_rows(spark):
    rows = [(None, "n"), (1, "b"), (1, "a"), (1, "a"), (2, "c"), (2**62, "z"), (-2**62, "y")]
    got = sorted((str(r["id"]), r["text"], r["next_text"]) for r in merkle.with_next_text(
        frame(spark, rows), block_rows=1).collect())
    chain = sorted(rows, key=place(spark, rows))
    want = sorted((str(i), t, chain[(n + 1) % len(chain)][1]) for n, (i, t) in enumerate(chain))
    assert got == want


def place(spark, rows):
    """The order of rows: id (null first), hash of the text, text."""
    hashes = {t: h for t, h in spark.createDataFrame([(t,) for _, t in rows], "t string").selectExpr(
        "t", "shiftrightunsigned(xxhash64(t), 1)").collect()}
    return lambda row: (row[0] is not None, row[0] or 0, hashes[row[1]], row[1])


def test_hot_ids_are_spread_over_blocks(spark):
    rng = random.Random(8)
    rows = ([(7, f"hot {i}") for i in range(300)] + [(None, f"null {i}") for i in range(300)]
            + [(i, f"own {i}") for i in rng.sample(range(-200, 200), 300)])
    chain = sorted(rows, key=place(spark, rows))
    linked = merkle.with_next_text(frame(spark, rows), block_rows=20)
    want = {(i, t): chain[(n + 1) % len(chain)][1] for n, (i, t) in enumerate(chain)}
    assert {(r["id"], r["text"]): r["next_text"] for r in linked.collect()} == want
    edges = np.array(sorted([7] * 15 + [-100, 100]))
    blocks = spark.range(300).selectExpr("shiftrightunsigned(xxhash64(concat('hot ', id)), 1) h").select(
        merkle._block(F.lit(7), F.col("h"), edges).alias("b")).groupBy("b").count().collect()
    assert len(blocks) == 15 and max(r["count"] for r in blocks) < 45


def test_texts_of_twenty_thousand_words(spark):
    rng = random.Random(5)
    text = "\n".join(" ".join(f"w{rng.randrange(999)}" for _ in range(k)) for k in (15_000, 1, 5_000, 900))
    rows = [(1, text), (2, text + " end"), (3, "short")]
    got = {r["doc_id"]: r["tree"] for r in merkle.merkle_trees(frame(spark, rows)).collect()}
    for i, t in rows:
        root, sections, paragraphs, leaves = tree(t)
        assert (got[i]["root"], got[i]["sections"], got[i]["paragraphs"], got[i]["leaves"]) == (
            root, sections, paragraphs, leaves)


def test_one_row_and_empty_table(spark, empty):
    assert [r["next_text"] for r in merkle.with_next_text(frame(spark, [(5, "me")])).collect()] == ["me"]
    assert merkle.with_next_text(empty).count() == 0
    assert merkle.merkle_trees(empty).count() == 0


def test_first_difference_locates_the_edit(spark):
    base = "\n".join(" ".join(f"w{p}x{i}" for i in range(30)) for p in range(40))
    rng = random.Random(4)
    rows = []
    for n in range(25):
        words = base.split(" ")
        k = rng.randrange(len(words))
        words[k] = words[k].replace("x", "CHANGED", 1)
        rows.append((n, base, " ".join(words)))
    rows.append((99, base, base))
    df = spark.createDataFrame(rows, "n int, a string, b string")
    df = merkle.with_tree(merkle.with_tree(df, "a", "ta"), "b", "tb")
    for r in df.select("n", "a", "b", merkle.first_difference("ta", "tb").alias("d"),
                       merkle.likeness("ta", "tb").alias("l")).collect():
        if r["n"] == 99:
            assert r["d"] is None and r["l"] == 1.0
            continue
        pa, pb = r["a"].split("\n"), r["b"].split("\n")
        p = next(i for i in range(len(pa)) if pa[i] != pb[i])
        la, lb = ([m[0] for m in LEAF.finditer(x[p])] for x in (pa, pb))
        leaf = next(i for i in range(len(la)) if la[i] != lb[i])
        assert (r["d"]["paragraph"], r["d"]["leaf"]) == (p, leaf)
        assert tree(r["a"])[1][r["d"]["section"]] not in tree(r["b"])[1]
        assert 0.9 < r["l"] < 1.0


def test_query_contract(spark, small):
    from quaystack.llm.queries import op2_merkle_fingerprint
    from tests.conftest import SF_SMALL
    got = {r["doc_id"]: r for r in op2_merkle_fingerprint(spark, SF_SMALL).collect()}
    flat = lambda t: {x for p in tree(t)[3] for x in p}
    dice = lambda a, b: 2.0 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    for n, (i, t) in enumerate(small):
        nxt = small[(n + 1) % len(small)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (tree(t)[0], tree(edited)[0])
        assert r["near_edited"] == dice(flat(t), flat(edited))
        assert r["near_next"] == dice(flat(t), flat(nxt))
