"""The audit against a plain one; the query has SQL as well."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from quaystack.llm import divergence
from quaystack.llm.divergence import LOWER, SCALE, TERM, UPPER

FIELDS = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, min_docs, smooth=5, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(TERM, t.translate(str.maketrans(UPPER, LOWER))) for _, _, t in rows]
    df, by_group, by_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for (lang, source, _), found in zip(rows, terms):
        df[lang].update(set(found))
        by_group[lang, source].update(found)
        by_lang[lang].update(found)
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        share = lambda c: {t: 1 + SCALE * (c[t] + smooth) // (
            sum(c[k] for k in kept) + smooth * len(kept)) for t in kept}
        q = share(by_lang[lang])
        sources = sorted({s for x, s, _ in rows if x == lang})
        p = {s: share(by_group[lang, s]) for s in sources}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if by_group[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, n) for n, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def rows_of(df):
    assert df.columns == FIELDS
    return sorted(tuple(r) for r in df.collect())


def frame(spark, rows):
    """With extra columns called like internal ones."""
    return spark.createDataFrame([(*r, 1, "w") for r in rows],
                                 "lang string, source string, text string, block long, word string")


def made_up(n=120):
    rng = random.Random(8)
    words = ["The", "the", "the,", "a", "é", "É", "naïve\xa0x", "don't", "日本", "x1y", "Zeta", "tail"]
    rows = [(rng.choice(("en", "de", None)), rng.choice(("s1", "s2", "s3 b", None)),
             " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for _ in range(n)]
    return rows + [("en", "silent", None), ("en", "silent", " \t\n"), ("fr", "lone", "mot"),
                   ("xx", "a", "un"), ("xx", "b", "")] + rows[:10]


def test_audit_equals_plain(spark):
    rows = made_up()
    for min_docs in (1, 5, 30):
        assert rows_of(divergence.audit(frame(spark, rows), min_docs=min_docs, top=4)) \
            == plain(rows, min_docs, top=4)


def test_blocks_do_not_change_results(spark):
    rows = made_up(40) + [("en", "s1", "long " * 5000 + "text")]
    want = plain(rows, 3)
    for chunks in (1, 60, 10_000):
        assert rows_of(divergence.audit(frame(spark, rows).repartition(3), min_docs=3,
                                        block_chunks=chunks)) == want


def test_empty_table(spark):
    assert divergence.audit(frame(spark, made_up()).limit(0)).count() == 0


def test_numbers_survive_packing():
    found = [([5, 0, 9], [1, 2, 300]), ([], []), ([7], [1]), ([2, 1], [4, 5])]
    sizes = np.array([len(n) for n, _ in found])
    at, times = divergence._unpack(divergence._pack(found), sizes)
    assert at.tolist() == [0, 5, 9, 7, 1, 2] and times.tolist() == [2, 1, 300, 1, 5, 4]
    none = divergence._pack([([], [])])
    assert [x.tolist() for x in divergence._unpack(none, np.array([0]))] == [[], []]


def test_shares_are_exact_for_huge_counts(spark):
    from pyspark.sql import functions as F
    row = spark.createDataFrame([(10 ** 15 + 7, 3 * 10 ** 15, 10 ** 6)], "c long, n long, v long")
    got = row.select(divergence._share(F.col("c"), F.col("n"), F.col("v"), 5)).first()[0]
    assert got == 1 + SCALE * (10 ** 15 + 12) // (3 * 10 ** 15 + 5 * 10 ** 6)
