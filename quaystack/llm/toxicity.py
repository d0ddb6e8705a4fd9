"""Toxicity grades by cumulative-link ordinal regression over sparse words.

P(grade > k) = sigmoid(x . w - cut_k): one weight vector shared by all
thresholds, cuts kept in order. The expected severity is the sum of those
probabilities over k. The features of a document are its distinct words
(lower-cased runs of letters) and their beginnings, each with the number of
words that carry it over the square root of the text's length. Only features that are significantly commoner
in toxic training rows take part, so a long text gathers no weight from
words that say nothing.

The labels say toxic or not. Grades above 0 come from the share of a toxic
row's words that carry such features: its terciles are grades 1 to 3. A
table that has grades is used as it is.

Edge cases: a null or empty text has no words and gets the score of the
bias alone; null ids are scored but never trained on. Of several labels of
one document the largest counts. Repeated rows score alike. Without any
toxic row in the training sample every document has severity 0. Texts of any
length are read whole. Extra columns stay; of one called like a result only
the result is kept.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystack.llm.common import column, ready, texts

#: Most labelled rows that train the model, of each class, by hash of the id.
TOXIC_ROWS, CLEAN_ROWS = 3_000, 6_000
#: Lengths of word beginnings, the least training rows of a feature, and its
#: least log-odds ratio in standard errors.
PREFIXES, MIN_DOCS, MIN_Z, GRADES = (4, 5, 6, 7), 4, 3.5, 3
MEMO_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


class ToxicityModel(NamedTuple):
    features: dict[str, int]
    weights: np.ndarray   # one a feature, shared by the thresholds
    cuts: np.ndarray      # ascending, one a grade above 0
    threshold: float = 0.5  # of P(grade > 0): the best F1 on the training rows

    def chances(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ...: one column a threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts, -40, 40)))


class Scorer:
    """Scores texts; remembers which features a word has, up to a bound that
    only limits its memory."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.weights = model.weights.tolist()
        self.memo: dict[str, tuple[int, ...]] = {}

    def _marks(self, word: str) -> tuple[int, ...]:
        known = self.model.features
        marks = tuple(known[f] for f in features_of(word) if f in known)
        if len(word) <= 64:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = marks
        return marks

    def counts(self, words: set[str]) -> Counter:
        found: Counter = Counter()
        get = self.memo.get
        for word in words:
            marks = get(word)
            found.update(self._marks(word) if marks is None else marks)
        return found

    def score(self, text: str | None) -> float:
        words = words_of(text)
        found = sorted(self.counts(words).items())
        return float(sum(self.weights[i] * n for i, n in found) * weight_of_one(len(words)))


def weight_of_one(words: int) -> float:
    """What one of so many distinct words counts."""
    return (1 + words / 100) ** -0.5


def select_features(rows: list[set[str]], toxic: np.ndarray) -> dict[str, int]:
    """Features whose log-odds ratio for toxic rows is MIN_Z errors over 0."""
    bad: Counter = Counter()
    good: Counter = Counter()
    for words, y in zip(rows, toxic):
        (bad if y else good).update({f for w in words for f in features_of(w)})
    n_bad, n_good = int((toxic > 0).sum()), int((toxic == 0).sum())
    kept = []
    for f, n in bad.items():
        if n < MIN_DOCS:
            continue
        cells = np.array([n, n_bad - n, good[f], n_good - good[f]]) + 0.5
        ratio = np.log(cells[0] * cells[3] / (cells[1] * cells[2]))
        if ratio > MIN_Z * np.sqrt((1 / cells).sum()):
            kept.append(f)
    return {f: i for i, f in enumerate(sorted(kept))}


def severity_grades(rows: list[set[str]], toxic: np.ndarray, features: dict[str, int],
                    grades: int = GRADES) -> np.ndarray:
    """Grades of binary labels: 0, or the tercile of a toxic row's share of
    words that carry a feature."""
    density = np.array([sum(any(f in features for f in features_of(w)) for w in words)
                        / max(len(words), 1) for words in rows])
    out = np.zeros(len(rows), dtype=np.int64)
    bad = toxic > 0
    if bad.any():
        steps = np.quantile(density[bad], np.arange(1, grades) / grades)
        out[bad] = 1 + np.searchsorted(steps, density[bad], side="left")
    return out


def fit(rows: list[set[str]], grades: np.ndarray, features: dict[str, int], rounds: int = 400,
        rate: float = 0.1, decay: float = 1e-4) -> ToxicityModel:
    """Maximise the ordinal likelihood (Adam); cuts are a start and positive gaps."""
    top, n = max(int(grades.max(initial=0)), 1), len(rows)
    if not features or grades.max(initial=0) == 0:
        return ToxicityModel({}, np.zeros(0), np.full(top, 40.0))
    size = len(features)
    scorer = Scorer(ToxicityModel(features, np.zeros(size), np.zeros(top)))
    counts = [sorted(scorer.counts(words).items()) for words in rows]
    at = np.repeat(np.arange(n), [len(c) for c in counts])
    cols = np.array([i for c in counts for i, _ in c], dtype=np.int64)
    x = np.array([k for c in counts for _, k in c], dtype=float)
    x *= np.array([weight_of_one(len(words)) for words in rows])[at]
    share = np.array([(grades > k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    start = np.log((1 - share) / share)
    value = np.concatenate([np.zeros(size), [start[0]], np.log(np.diff(start).clip(0.05))])
    m, v = np.zeros_like(value), np.zeros_like(value)
    every = np.arange(n)

    def cuts_of(value: np.ndarray) -> np.ndarray:
        return value[size] + np.concatenate([[0.0], np.cumsum(np.exp(value[size + 1:]))])

    for step in range(1, rounds + 1):
        w = value[:size]
        score = np.bincount(at, weights=w[cols] * x, minlength=n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts_of(value), -40, 40)))
        # P(grade = g) is the difference of two neighbouring columns.
        wide = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        slope = wide * (1 - wide)
        mass = np.maximum(wide[every, grades] - wide[every, grades + 1], 1e-9)
        lower, upper = slope[every, grades] / mass / n, slope[every, grades + 1] / mass / n
        by_cut = np.zeros((n, top + 2))
        by_cut[every, grades] -= lower
        by_cut[every, grades + 1] += upper
        later = np.cumsum(by_cut[:, 1:-1].sum(axis=0)[::-1])[::-1]
        g = np.concatenate([
            np.bincount(cols, weights=(lower - upper)[at] * x, minlength=size) - decay * w,
            later[:1], later[1:] * np.exp(value[size + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        value = value + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    p = 1 / (1 + np.exp(np.clip(cuts_of(value)[0] - np.bincount(
        at, weights=value[:size][cols] * x, minlength=n), -40, 40)))
    return ToxicityModel(features, value[:size], cuts_of(value), _best_threshold(p, grades > 0))


def _best_threshold(p: np.ndarray, toxic: np.ndarray) -> float:
    """Half way between the two scores that part the rows with the best F1."""
    order = np.argsort(-p, kind="stable")
    ranked, hits = p[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + toxic.sum())
    ends = np.append(ranked[:-1] != ranked[1:], True)  # ties stay together
    best = int(np.where(ends, f1, -1).argmax())
    return float((ranked[best] + (ranked[best + 1] if best + 1 < len(p) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", graded: bool = False, toxic_rows: int = TOXIC_ROWS,
          clean_rows: int = CLEAN_ROWS) -> ToxicityModel:
    """Fit on at most ``toxic_rows`` and ``clean_rows`` labelled documents."""
    ready(docs.sparkSession)
    known = (labels.select(column(id_col).alias("id"), column(label_col).cast("int").alias("y"))
             .filter(F.col("id").isNotNull() & F.col("y").isNotNull())
             .groupBy("id").agg(F.max("y").alias("y")))
    parts = [known.filter(test).orderBy(F.xxhash64("id"), "id").limit(most)
             for test, most in (("y > 0", toxic_rows), ("y <= 0", clean_rows))]
    sample = parts[0].unionByName(parts[1])  # toxic_rows + clean_rows at most
    rows = texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(sorted(words_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("y"), pa.array(words, pa.string())],
                ["id", "y", "words"])

    id_type = rows.schema["id"].dataType.simpleString()
    # One row a sampled id: of an id with many texts the least words.
    found = (rows.join(F.broadcast(sample), "id").select("id", "y", "text")
             .mapInArrow(run, f"id {id_type}, y int, words string")
             .groupBy("id", "y").agg(F.min("words").alias("words")).toPandas())
    found = found.sort_values("id", kind="stable")
    sets = [set(map(sys.intern, w.split())) for w in found["words"]]
    y = np.maximum(found["y"].to_numpy(dtype=np.int64), 0)
    features = select_features(sets, y)
    return fit(sets, y if graded else severity_grades(sets, y, features), features)


def grade(df: DataFrame, model: ToxicityModel, text_col: str = "text",
          threshold: float | None = None) -> DataFrame:
    """``df`` with severity (expected grade), grade (the likeliest), p_toxic
    and toxic (p_toxic at ``threshold`` or more, by default the model's)."""
    ready(df.sparkSession)

    @F.pandas_udf("severity double, grade int, p_toxic double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            p = model.chances(np.array([scorer.score(t) for t in batch]))
            wide = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1)
            yield pd.DataFrame({"severity": p.sum(axis=1),
                                "grade": (wide[:, :-1] - wide[:, 1:]).argmax(axis=1).astype("int32"),
                                "p_toxic": p[:, 0]})

    out = df.withColumn("__judged", judge(column(text_col)))
    least = model.threshold if threshold is None else threshold
    return (out.withColumns({c: F.col(f"__judged.{c}") for c in ("severity", "grade", "p_toxic")})
            .withColumn("toxic", F.col("p_toxic") >= least).drop("__judged"))
