"""Packing: the dynamic program against exhaustive search, pieces against the tokenizer."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quaystack.llm import packing
from quaystack.llm.packing import Costs
from tests.llm.conftest import ROWS, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


def test_word_tokens_match_the_library(library, small):
    rng = random.Random(1)
    pool = list("abcXYZ'_-.,!? \n\t0123éÉßÑµ²¼日本Σσςİ \x1c\x85\xa0é") + [" "] * 10
    fuzz = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    batch = [t or "" for _, t in [*ROWS, *small]] + fuzz + ["<|endoftext|> as text", ""]
    words = packing.WordTokens(PATH)
    for text, raw in zip(batch, words.encode(batch)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def brute(at, price, costs):
    least = {at[0]: 0}
    for j in range(1, len(at)):
        least[at[j]] = min(
            (least[at[i]] + costs.padding(at[j] - at[i]) + costs.sequence + int(price[j])
             for i in range(j) if at[j] - at[i] <= costs.window and at[i] in least), default=None)
        if least[at[j]] is None:
            del least[at[j]]
    return least[at[-1]]


def test_best_cuts_is_optimal():
    rng = random.Random(6)
    for _ in range(300):
        costs = Costs(window=rng.choice([8, 16, 32]), sequence=rng.randrange(0, 6))
        at = np.unique(np.cumsum([0] + [rng.randrange(1, costs.window) for _ in range(rng.randrange(1, 30))]))
        price = np.array([rng.choice([0, 4, 9]) for _ in at])
        cuts = packing.best_cuts(at, price, costs)
        where = {p: i for i, p in enumerate(at.tolist())}
        total, last = 0, 0
        for c in cuts:
            assert c - last <= costs.window
            total += costs.padding(c - last) + costs.sequence + int(price[where[c]])
            last = c
        assert last == at[-1] and total == brute(at.tolist(), price, costs)


@pytest.mark.parametrize("run", [64, 300, 10_000])
def test_stream_keeps_every_id_once_and_in_order(run):
    rng = random.Random(run)
    ends = np.zeros(50, dtype=bool)
    ends[7] = True
    costs = Costs(window=16, run=run, gap=12, step=4, carry=2)
    docs = [(n, np.array([rng.randrange(3, 50) for _ in range(rng.choice([0, 3, 20, 400]))] + [2], "<u4"))
            for n in range(60)]
    pieces = list(packing.pack_stream(((n, d.tobytes()) for n, d in docs), ends, costs))
    by_doc, by_seq = {}, {}
    for row, start, length, raw, total, seq, offset in pieces:
        assert length > 0 and len(raw) == 4 * length
        by_doc.setdefault(row, []).append((start, raw, total))
        assert offset == by_seq.get(seq, 0)
        by_seq[seq] = offset + length
    for n, d in docs:
        got = by_doc[n]
        assert [s for s, _, _ in got] == np.cumsum([0] + [len(r) // 4 for _, r, _ in got])[:-1].tolist()
        assert b"".join(r for _, r, _ in got) == d.tobytes() and {t for _, _, t in got} == {len(d)}
    assert max(by_seq.values()) <= 16 and sorted(by_seq) == list(range(len(by_seq)))


def test_tail_is_split_only_where_padding_costs_more():
    costs = Costs()
    assert packing._split_tail(0, 4096, costs) == [4096]
    assert packing._split_tail(10, 4096 + 10 - 3, costs) == [4096 + 10 - 3]
    assert packing._split_tail(0, 1300, costs) == [1024, 1280, 1296, 1300]


def test_query(spark, library, small):
    from quaystack.llm.queries import op6_packing
    from tests.conftest import SF_SMALL
    rows = op6_packing(spark, SF_SMALL).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in small}
    total = 0
    for i, text in small:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        total += len(ids)
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert [r["doc_id"] for r in pieces] == sorted(r["doc_id"] for r in pieces)
        padding += Costs().padding(sum(r["length"] for r in pieces))
    assert padding < 0.02 * total


def test_edge_cases(spark, docs, empty, library):
    rows = packing.pack(docs, PATH).collect()
    assert sorted(str(r["doc_id"]) for r in rows if r["start"] == 0) == sorted(str(i) for i, _ in ROWS)
    assert sum(r["length"] for r in rows) == sum(
        len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    assert packing.pack(empty, PATH).count() == 0


def test_a_hot_id_is_packed_by_many_tasks(spark):
    rows = ([(None, f"Nobody said {i}.") for i in range(200)] + [(5, f"Five said {i}.") for i in range(200)]
            + [(i, f"Number {i}.") for i in range(10, 210)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = packing.pack(frame(spark, rows), PATH).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for hot in (None, 5):
        tasks = {}
        for r in got:
            if r["doc_id"] == hot:
                task = r["sequence_id"] >> 40
                tasks[task] = tasks.get(task, 0) + (r["start"] == 0)
        assert sum(tasks.values()) == 200 and max(tasks.values()) < 150
    assert sum(r["start"] == 0 for r in got) == len(rows)
