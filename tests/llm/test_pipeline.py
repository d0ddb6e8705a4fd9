"""The pipeline's stages against brute force, and its end to end run."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quaystack.llm import pii, quality
from tests.conftest import SF_SMALL
from tests.llm.conftest import ROWS, frame
from tests.llm.test_simhash import brute_components, reference_fingerprint


def brute(spark):
    """Documents after the first four stages, by plain loops."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    rows = {i: t for i, t in rows.items()
            if model.scores(quality.features(t)[None])[0] >= quality.THRESHOLD}
    best = {}
    for i, t in rows.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (1, 0)), (-len(t), i))
    rows = {i: rows[i] for _, i in best.values()}
    fps = {i: reference_fingerprint(t) for i, t in rows.items()}
    comp = brute_components(sorted(set(fps.values())), 2)
    least = {}
    for i, f in fps.items():
        least[comp[f]] = min(i, least.get(comp[f], i))
    rows = {i: rows[i] for i in least.values()}
    tagger = pii.Tagger(pii.train())
    return {i: pii.masked(t, pii.all_spans([t], tagger)[0]) for i, t in rows.items()}


def test_run_matches_brute_force(spark):
    want = brute(spark)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    pieces = {}
    for r in corpus_pipeline.run(spark, SF_SMALL).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert set(pieces) == set(want)
    for i, text in want.items():
        ids = b"".join(raw for _, raw in sorted(pieces[i]))
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [2]


def test_stages_keep_the_columns_and_survive_edge_cases(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (ROWS, []):
        docs = frame(spark, rows).select(*columns)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert docs.columns == columns and dict(docs.dtypes)["n_chars"] == "bigint"
        assert (docs.count() > 0) == bool(rows)
