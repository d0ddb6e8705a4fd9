"""Personal data: base patterns, the CRF's likelihood and decoding, masking."""

import hashlib
import re
from itertools import product

import numpy as np
import pytest

from quaystack.llm import pii
from tests.llm.conftest import ROWS


def plain_base(text):
    """The four patterns with Python's own search, one after the other."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and not all(int(p) <= 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = 0
                for i, d in enumerate(reversed(digits)):
                    v = int(d) * (1 + i % 2)
                    total += v - 9 if v > 9 else v
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((kind, m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.train())


def test_base_spans_on_documents_and_noise(small):
    rng = np.random.default_rng(1)
    pool = list("ab.@@-+%_ 0123456789()  \n") + ["4111111111111111", "+1 (555) 123-4567", "10.0.0.255", "a@b.c"]
    noise = ["".join(rng.choice(pool, rng.integers(1, 40))) for _ in range(6000)]
    for text in [t or "" for _, t in [*ROWS, *small]] + noise:
        assert pii.base_spans(text) == plain_base(text), text


def test_base_spans_are_linear():
    for unit in ("a", "1", "a@", "1.", "+1 ", "1 "):
        pii.base_spans(unit * 200_000)


def test_viterbi_is_the_best_path(tagger):
    crf = tagger.crf
    for line in ("call +4 (555) 123-4567 now", "x 10.0.0.1 y", "token = \"0a1b2c3d4e5f60718293\""):
        words = line.split()
        padded = [pii._EDGE, *(pii.word_features(w) for w in words), pii._EDGE]
        rows = [crf.rows(p) for p in padded]
        emit = [rows[i + 1][0] + rows[i][1] + rows[i + 2][2] for i in range(len(words))]
        k = range(len(pii.TAGS))
        # All paths over the three likeliest tags of each word and the decoded one.
        (best,) = tagger.tags([words])
        choice = [sorted(set(np.argsort(-e)[:3].tolist()) | {int(b)}) for e, b in zip(emit, best)]

        def score(path):
            return (crf.first[path[0]] + crf.last[path[-1]] + sum(e[t] for e, t in zip(emit, path))
                    + sum(crf.moves[a, b] for a, b in zip(path, path[1:])))
        top = max(product(*choice), key=score)
        assert abs(score(top) - score(tuple(best))) < 1e-3
        assert len(k) == 11


def test_lines_do_not_depend_on_their_batch(tagger, small):
    lines = [w for _, t in small[:40] for w in (x.split() for x in t.split("\n")) if w]
    together = tagger.tags(lines)
    alone = [pii.Tagger(tagger.crf).tags([line])[0] for line in lines[:60]]
    assert all((a == b).all() for a, b in zip(together, alone))


def test_fresh_draws_of_the_table_are_tagged_right(tagger):
    rows = pii.labelled_rows(copies=4, seed=1234)
    got = tagger.tags([words for words, _ in rows])
    right = [(a == b).all() for a, (_, b) in zip(got, rows)]
    assert np.mean(right) > 0.97


def test_the_method_finds_what_the_patterns_lose(tagger):
    text = "In rest +1 (555) 123-4567 4111111111111111 here.\nKey token = \"9b0b3c6a43eb78aa99cbd7049c572391\" end."
    (spans,) = pii.all_spans([text], tagger)
    assert [(k, text[a:b], base) for k, a, b, base in spans] == [
        ("card", "4111111111111111", False), ("phone", "+1 (555) 123-4567", False),
        ("secret", "9b0b3c6a43eb78aa99cbd7049c572391", False)]
    assert plain_base(text) == []


def test_clean_texts_get_no_spans(tagger):
    clean = ["In 1984, 12,000 people paid $5.99 (10%) at 10:30 on 2024-05-06.", "Version 2.0. of v1.2.3, item 4-5",
             "THE!! OLD!! MAN.!! that*** this%%% a&&&", "", "ISBN 9783161484100 and order 1234567812345678"]
    assert pii.all_spans(clean, tagger) == [[]] * len(clean)


def test_masked():
    text = "mail a@b.co or +1 555 123 4567."
    spans = [("email", 5, 11, True), ("phone", 15, 30, True), ("card", 17, 30, False)]
    assert pii.masked(text, spans) == "mail <EMAIL> or <PHONE>."


def test_frames(spark, docs, empty, small):
    from quaystack.llm.queries import op5_pii_crf
    from tests.conftest import SF_SMALL
    assert pii.find_pii(docs).count() == len(ROWS) and pii.find_pii(empty).count() == 0
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns and masked.filter("text is null").count() == 1
    assert pii.mask_pii(empty).count() == 0
    got = {r["doc_id"]: r for r in op5_pii_crf(spark, SF_SMALL).collect()}
    for i, text in small:
        base = plain_base(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[0] == k for s in base) for k in pii.BASE_KINDS]
        every = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(every)
        order = [(pii.KINDS.index(k), int(a)) for k, a, _ in every]
        assert order == sorted(order)
