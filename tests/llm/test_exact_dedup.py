"""Exact dedup against brute force, with hash collisions forced."""

import hashlib
import re

from pyspark.sql import functions as F

from quaystack.llm import exact_dedup
from tests.llm.conftest import ROWS, frame


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is not None, i if i is not None else 0, i))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for n, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), n == 0,
                        hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, **options):
    rows = exact_dedup.exact_duplicates(df, **options).collect()
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["sha256"]) for r in rows), key=str)


def test_matches_brute_force(docs):
    assert result(docs) == brute(ROWS)


def test_collisions_are_told_apart_by_bytes(docs):
    weak = lambda text: F.pmod(F.length(text), F.lit(2)).cast("string")
    assert result(docs, hash128=weak) == brute(ROWS)


def test_empty_table(empty):
    assert result(empty) == []
    assert exact_dedup.drop_exact_duplicates(empty).columns == empty.columns
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_drop_keeps_one_whole_row_per_text(spark, docs):
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    want = sorted((i for i, _, _, k, _ in brute(ROWS) if k), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want


def test_an_id_shared_by_two_texts_loses_none(spark):
    df = frame(spark, [(1, "a b"), (1, "c d"), (2, "ab"), (3, "c d"), (3, "cd ")])
    kept = {(r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_duplicates(df).collect()}
    assert kept == {(1, "a b"), (1, "c d")}
