"""Quality classifier: the risk, held-out accuracy, edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from quaystack.llm import quality
from tests.llm.conftest import ROWS

SF = "/root/testdata/sf0.01"


def test_features_are_finite_and_see_the_whole_text():
    for _, text in ROWS:
        x = quality.features(text)
        assert x.shape == (quality.N_FEATURES,) and np.isfinite(x).all()
    long = "clean words here. " * 5000
    assert not np.allclose(quality.features(long), quality.features(long + "### $$$ " * 2000))
    assert (quality.features(None) == quality.features("")).all()


def test_fit_recovers_a_hidden_class():
    """Positives, and a mixture of 70 % positives with negatives elsewhere."""
    rng = np.random.default_rng(1)
    n, d = 2000, quality.N_FEATURES
    make = lambda m, size: rng.normal(m, 1, (size, d)).astype(np.float32) * (np.arange(d) < 6)
    hidden = rng.random(n) < 0.7
    mixed = np.where(hidden[:, None], make(1.0, n), make(-1.0, n))
    model = quality.fit(make(1.0, n), mixed, 0.7)
    assert ((model.scores(mixed) >= 0.5) == hidden).mean() > 0.95


def _mixture(share, n=4000, seed=1, gap=1.0):
    rng = np.random.default_rng(seed)
    make = lambda m, size: rng.normal(m, 1, (size, quality.N_FEATURES)).astype(np.float32) * (
        np.arange(quality.N_FEATURES) < 6)
    hidden = rng.random(n) < share
    return make(gap, n // 2), np.where(hidden[:, None], make(gap, n), make(-gap, n)), hidden


def test_prior_comes_from_positives_and_unlabelled_rows_alone():
    for share in (0.1, 0.3, 0.5, 0.7, 0.9):
        positive, mixed, hidden = _mixture(share)
        assert abs(quality.estimate_prior(positive, mixed) - hidden.mean()) < 0.05, share
    few, mixed, _ = _mixture(0.3, n=30)
    assert quality.estimate_prior(few, mixed) == quality.PRIOR


def test_positives_alone_train_a_classifier():
    positive, mixed, hidden = _mixture(0.4, seed=3)
    model = quality.fit(positive, mixed, quality.estimate_prior(positive, mixed))
    assert ((model.scores(mixed) >= 0.5) == hidden).mean() > 0.95
    assert 0.3 < model.scores(mixed).mean() < 0.5


def test_fit_lowers_the_non_negative_risk():
    """The risk by its definition, before and after, and at no better point nearby."""
    positive, mixed, _ = _mixture(0.4, n=600, seed=5)

    def risk(model):
        loss = lambda x, y: np.mean([-np.log(np.clip(s if y else 1 - s, 1e-12, 1))
                                     for s in model.scores(x)])
        return 0.4 * loss(positive, 1) + max(0.0, loss(mixed, 0) - 0.4 * loss(positive, 0))

    model = quality.fit(positive, mixed, 0.4, decay=0.0)
    start = model._replace(weights=model.weights * 0, bias=float(np.log(0.4 / 0.6)))
    assert risk(model) < 0.3 * risk(start)
    rng = np.random.default_rng(0)
    for _ in range(20):
        other = model._replace(weights=model.weights + rng.normal(0, 0.3, model.weights.shape))
        assert risk(other) > risk(model) - 1e-3


def test_labels_of_negatives_are_not_needed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels.filter("quality = 1"))
    rows = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= quality.THRESHOLD) == (r["quality"] == 1) for r in rows]) > 0.93


def test_held_out_fold(spark):
    rows = spark.range(200).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_held_out_accuracy(spark):
    from quaystack.llm.queries import op8_quality_pu
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op8_quality_pu(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 30
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (6, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    none = quality.train(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in quality.score(docs, none).collect()} == {0.5}
    kept = quality.keep_good(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert quality.score(empty, quality.train(empty, labels)).count() == 0
