"""Toxicity: ordinal likelihood, held-out accuracy, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from quaystack.llm import toxicity
from tests.llm.conftest import ROWS

SF = "/root/testdata/sf0.01"


def test_ordinal_fit_orders_cuts_and_grades():
    rng = np.random.default_rng(2)
    rows, grades = [], []
    for _ in range(1500):
        g = int(rng.integers(0, 4))
        rows.append({f"bad{i}" for i in range(g * 2)} | {f"w{rng.integers(60)}" for _ in range(20)})
        grades.append(g)
    features = {f"bad{i}": i for i in range(6)}
    model = toxicity.fit(rows, np.array(grades), features)
    assert (np.diff(model.cuts) > 0).all()
    scorer = toxicity.Scorer(model)
    score = np.array([scorer.score(" ".join(w.replace(str(w[-1]), "abcdefghij"[int(w[-1])])
                                            for w in row)) for row in rows])
    assert score.shape == (1500,)  # digits are no letters: nothing is found
    direct = np.array([sum(model.weights[i] * n for i, n in scorer.counts(row).items())
                       * toxicity.weight_of_one(len(row)) for row in rows])
    severity = model.chances(direct).sum(axis=1)
    means = [severity[np.array(grades) == g].mean() for g in range(4)]
    assert means == sorted(means) and abs(means[3] - 3) < 0.4 and means[0] < 0.4


def test_gradient_of_the_likelihood():
    """The fit's optimum beats small moves of any weight or of all cuts."""
    rng = np.random.default_rng(4)
    rows = [{f"b{i}" for i in range(3) if rng.random() < p} | {"x"} for p in rng.random(400)]
    grades = np.array([min(2, int(len(r) - 1 + rng.integers(-1, 2) > 0) + int(len(r) > 2)) for r in rows])
    model = toxicity.fit(rows, grades, {"b0": 0, "b1": 1, "b2": 2}, rounds=3000, decay=0.0)
    scorer = toxicity.Scorer(model)
    counts = [dict(scorer.counts(r)) for r in rows]

    def loss(weights, cuts):
        score = np.array([sum(weights[i] * n for i, n in c.items()) * toxicity.weight_of_one(len(r))
                          for c, r in zip(counts, rows)])
        p = 1 / (1 + np.exp(-(score[:, None] - cuts)))
        wide = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1)
        k = np.arange(len(p))
        return -np.log(np.maximum(wide[k, grades] - wide[k, grades + 1], 1e-12)).mean()
    best = loss(model.weights, model.cuts)
    for i in range(3):
        for step in (-0.05, 0.05):
            moved = model.weights.copy()
            moved[i] += step
            assert loss(moved, model.cuts) >= best - 1e-4
    for step in (-0.05, 0.05):
        assert loss(model.weights, model.cuts + step) >= best - 1e-4


def test_best_threshold_keeps_ties_together():
    p = np.array([0.9, 0.8, 0.8, 0.3, 0.1])
    assert toxicity._best_threshold(p, np.array([True, True, True, False, False])) == 0.55
    assert toxicity._best_threshold(p, np.array([True, True, False, False, False])) < 0.85


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    own = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    model = toxicity.train(docs, labels.filter(~own))
    rows = (toxicity.grade(docs.select("doc_id", "text"), model)
            .join(labels.filter(own).select("doc_id", F.col("toxic").alias("y")), "doc_id").collect())
    hit = np.array([r["toxic"] for r in rows])
    y = np.array([r["y"] == 1 for r in rows])
    assert (hit == y).mean() > 0.93
    assert (hit & ~y).sum() <= 0.03 * (~y).sum()


def test_query_covers_every_row(spark):
    from quaystack.llm.queries import op1_toxicity
    rows = op1_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["severity"] <= 3 and 0 <= r["grade"] <= 3 for r in rows)


def test_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 0), (7, 1), (None, 1), (6, None)],
                                   "doc_id long, toxic int")
    for lab in (labels, labels.filter("toxic = 0"), labels.limit(0)):
        model = toxicity.train(docs, lab)
        rows = toxicity.grade(docs, model).collect()
        assert len(rows) == len(ROWS)
        assert all(0 <= r["severity"] < 3.01 for r in rows)
    assert not any(r["toxic"] for r in rows)
    out = toxicity.grade(empty, toxicity.train(empty, labels))
    assert out.count() == 0 and out.columns[:len(empty.columns)] == empty.columns


def test_an_id_with_many_rows_trains_once(spark):
    """A third of all rows share one id: the model is that of one row of it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    hot = labels.join(docs, "doc_id").orderBy("doc_id").select("doc_id", "text").limit(1)
    many = docs.unionByName(hot.crossJoin(spark.range(100)).select("doc_id", "text"))
    a, b = toxicity.train(docs, labels), toxicity.train(many, labels)
    assert a.threshold == b.threshold and str(a) == str(b)
