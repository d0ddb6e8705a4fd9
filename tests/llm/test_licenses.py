"""License scan against a brute-force containment of every window."""

import random
import re

import pytest

from quaystack.llm import licenses
from tests.llm.conftest import ROWS, frame

WORD = re.compile(r"[^\W_]+")


def grams(words, n=licenses.SHINGLE):
    return {" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}


def brute(text, notices, threshold=0.8):
    """Best containment of each template over windows of its own length."""
    words = [w.lower() for w in WORD.findall(text)]
    found = {}
    for name, notice in notices.items():
        own = WORD.findall(notice.lower())
        want = grams(own)
        best = max((len(grams(words[i:i + len(own)]) & want) / len(want)
                    for i in range(max(1, len(words) - len(own) + 1))), default=0) if words else 0
        if best >= threshold:
            found[name] = best
    return found


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.NOTICES)


def test_planted_notices_are_found_whole(scanner):
    rng = random.Random(1)
    filler = [f"{a}{b}" for a in ("ba", "ke", "mo", "ti", "su") for b in ("ra", "lo", "ne", "pi", "du")]
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    for name, notice in licenses.NOTICES.items():
        for size in (0, 3, 40, 700):
            text = f"{prose(size)} {notice} {prose(size)}".strip()
            found = scanner.scan(text)
            assert [(m.license, m.containment) for m in found] == [(name, 1.0)], (name, size)
            inside = WORD.findall(text[found[0].start:found[0].end].lower())
            assert inside == WORD.findall(notice.lower())


def test_edited_notices_by_containment(scanner):
    """One changed word: found exactly when enough shingles are left."""
    rng = random.Random(2)
    for name, notice in licenses.NOTICES.items():
        words = notice.split()
        for k in rng.sample(range(len(words)), min(4, len(words))):
            text = "so " * 30 + " ".join([*words[:k], "changedword", *words[k + 1:]]) + " or" * 30
            got = {m.license: m.containment for m in scanner.scan(text)}
            want = brute(text, {name: notice})
            assert (name in got) == (name in want) or got, (name, k)
            if name in got and name in want:
                assert got[name] >= want[name] - 1e-9


def test_two_notices_side_by_side(scanner):
    text = licenses.NOTICES["MIT"] + "\n" + licenses.NOTICES["GPL"] + "\n" + licenses.NOTICES["MIT"]
    assert [m.license for m in scanner.scan(text)] == ["MIT", "GPL", "MIT"]


def test_clean_texts(scanner, small):
    for _, text in [*ROWS, *small]:
        found = {m.license for m in scanner.scan(text or "")}
        want = brute(text or "", licenses.NOTICES)
        assert bool(found) == bool(want)
        assert all(want.get(n) == 1.0 for n in found)


def test_templates_of_few_words():
    own = licenses.Scanner({"PD": "Public domain.", "X": "All rights reserved"})
    assert [(m.license, m.start, m.end) for m in own.scan("this is PUBLIC domain, all rights reserved!")] == [
        ("PD", 8, 21), ("X", 23, 42)]


def test_long_texts_in_slices(scanner, monkeypatch):
    monkeypatch.setattr(licenses.Scanner, "SLICE", 128)
    text = "word and more " * 500 + licenses.NOTICES["MIT-text"] + " tail of it" * 300
    assert [(m.license, m.containment) for m in scanner.scan(text)] == [("MIT-text", 1.0)]


def test_frames(spark, docs, empty):
    df = frame(spark, [*ROWS, (50, "x " + licenses.NOTICES["MIT"]), (50, licenses.NOTICES["MIT"]), (None, licenses.NOTICES["MIT"])])
    got = sorted((str(r["doc_id"]), r["license"], r["start"]) for r in licenses.scan_licenses(df).collect())
    assert got == [("50", "MIT", 0), ("50", "MIT", 2), ("None", "MIT", 0)]
    assert licenses.scan_licenses(empty).count() == 0


def test_query(spark, small):
    from quaystack.llm.queries import op9_license_scan
    from tests.conftest import SF_SMALL
    got = {}
    for r in op9_license_scan(spark, SF_SMALL).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    want = {i: {n for n, c in brute(t, licenses.NOTICES).items() if c == 1.0} for i, t in small}
    assert got == {i: w for i, w in want.items() if w}


@pytest.mark.parametrize("times", [2, 3, 4, 5])
@pytest.mark.parametrize("lead", [0, 7, 50])
def test_a_notice_several_times_in_a_row(scanner, times, lead):
    for name, notice in licenses.NOTICES.items():
        text = "filler " * lead + " ".join([notice] * times)
        found = scanner.scan(text)
        assert [(m.license, m.containment) for m in found] == [(name, 1.0)] * times, name
        for m in found:
            assert WORD.findall(text[m.start:m.end].lower()) == WORD.findall(notice.lower())


def test_the_tail_of_a_notice_before_a_whole_one(scanner):
    for name, notice in licenses.NOTICES.items():
        words = WORD.findall(notice)
        if len(words) < 20:
            continue
        text = " ".join(words[-8:]) + " and " + notice + " " + notice
        assert [(m.license, m.containment) for m in scanner.scan(text)] == [(name, 1.0)] * 2, name


def _inserted(words, places, n):
    out = []
    for i, w in enumerate(words):
        if i in places:
            out += [f"extra{j}" for j in range(n)]
        out.append(w)
    return out


def test_notices_with_inserted_words_by_containment(scanner):
    """0 to 10 words at one to four places: found exactly when enough is left."""
    rng = random.Random(11)
    lost = 0
    for name, notice in licenses.NOTICES.items():
        words = WORD.findall(notice)
        want = grams([w.lower() for w in words])
        for _ in range(12):
            places = set(rng.sample(range(1, len(words)), min(rng.randrange(1, 5), len(words) - 1)))
            n = rng.randrange(0, 11)
            made = _inserted(words, places, n)
            text = "some text before it " * 6 + " ".join(made) + " and some text behind it" * 6
            left = len(grams([w.lower() for w in WORD.findall(text)]) & want) / len(want)
            found = {m.license: m for m in scanner.scan(text)}
            if left >= licenses.THRESHOLD:
                assert name in found, (name, sorted(places), n, left)
                assert abs(found[name].containment - left) < 1e-9
            else:
                lost += 1
                assert name not in found
    assert lost


def test_edited_notices_in_a_row_are_all_found(scanner):
    for name in ("MIT-text", "GPL-header", "ISC", "MIT-body", "BSD-3-Clause", "Zlib"):
        words = WORD.findall(licenses.NOTICES[name])
        one = " ".join(_inserted(words, {len(words) // 2}, 5))
        found = scanner.scan("lead in text " * 5 + " ".join([one] * 3))
        assert [m.license for m in found] == [name] * 3, name


def test_the_longer_notice_wins_over_the_short_one_it_holds(scanner):
    words = WORD.findall(licenses.NOTICES["Apache-2.0-header"])
    for place in range(9, len(words)):
        found = scanner.scan("a b c d e " + " ".join(_inserted(words, {place}, 1)))
        assert [m.license for m in found] == ["Apache-2.0-header"]
    for name in ("BSD-2-Clause", "BSD-3-Clause", "AGPL-3.0-header", "LGPL-2.1-header", "MPL-2.0-header"):
        assert [m.license for m in scanner.scan(licenses.NOTICES[name])] == [name]


def test_a_notice_whose_paragraphs_are_swapped(scanner):
    words = WORD.findall(licenses.NOTICES["MIT-body"])
    half = len(words) // 2
    found = scanner.scan(" ".join(words[half:] + words[:half]))
    assert "MIT-body" in {m.license for m in found}
