"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model under the
non-negative unbiased risk: prior * (loss of positives as positive) +
max(0, loss of unlabelled as negative - prior * loss of positives as
negative). While the bracket is negative its gradient is turned round, so
the model does not fit the positives hidden in the unlabelled text. The
class prior is the share of positives hidden in the unlabelled text. It is
estimated from positives and unlabelled rows alone: a classifier of one
against the other is fitted on half of both, and on the other half the least
ratio, over all thresholds, of unlabelled to positive rows above it bounds
the share from above (best bin estimate). Labelled negatives are not read.

Features read the whole text: square roots of the frequencies of
character-class pairs, and repetition of words and lines. They see no id,
source, language or label. The sample for training is bounded by two
documented parameters, taken by a hash of the id; scores cover every row.

Edge cases: a null or empty text has all features at their least and gets
the score that the model gives those; null ids are scored, and are never
part of a training sample. Repeated rows get equal scores; a document with
conflicting labels is no trusted positive. Without any trusted positive, or
with fewer than ``FEWEST`` rows on a side, the prior is ``PRIOR``; without
any, every score is the prior. Texts of any length are read whole. Extra
columns stay; of one called like the score only the score is kept.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystack.llm.common import column, ready, texts

#: Most trusted positives and most unlabelled rows that train the model.
POSITIVES, UNLABELLED = 6_000, 12_000
THRESHOLD = 0.3
#: The prior where it cannot be estimated, the rows of a side that an estimate
#: needs, its bounds, and how sure (1 - SURE) the confidence term is.
PRIOR, FEWEST, BOUNDS, SURE = 0.5, 20, (0.02, 0.98), 0.1

# Character classes of UTF-8 bytes; continuation bytes are dropped, other
# letters count as lower case.
_CLASSES = 12
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n",
           ".", ",;:", "!?", "'\"()[]{}", "-_/", "|\t"]


def _table() -> bytes:
    classes = [_CLASSES - 1] * 256
    for i, group in enumerate(_GROUPS):
        for c in group:
            classes[ord(c)] = i
    for b in range(0xC0, 0x100):
        classes[b] = 0
    return bytes(classes)


_TABLE, _CONTINUED = _table(), bytes(range(0x80, 0xC0))
N_FEATURES = _CLASSES * _CLASSES + 7


def _share_repeated(items: list) -> float:
    return 1 - len(set(items)) / len(items) if items else 0.0


def features(text: str | None) -> np.ndarray:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass").translate(_TABLE, _CONTINUED)
    codes = np.frombuffer(raw, dtype=np.uint8)
    pairs = np.bincount(codes[:-1].astype(np.int64) * _CLASSES + codes[1:],
                        minlength=_CLASSES**2) if len(codes) > 1 else np.zeros(_CLASSES**2)
    words = text.split()
    lines = text.split("\n")
    near = sum(map(str.__eq__, words, words[1:])) / max(1, len(words) - 1)
    rest = [near, np.sqrt(near), _share_repeated(words), _share_repeated(lines),
            np.log1p(len(words)) / 10, np.log1p(len(text)) / 10,
            len(codes) / max(1, len(words)) / 50]
    return np.concatenate([np.sqrt(pairs / max(1, len(codes) - 1)), rest]).astype(np.float32)


class QualityModel(NamedTuple):
    """Weights over standardised features; ``prior`` is the class prior."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400,
        rate: float = 0.05, decay: float = 1e-3, plain: bool = False) -> QualityModel:
    """Minimise the non-negative PU risk with the logistic loss; ``plain``
    takes the unlabelled rows for negatives instead."""
    if not len(positive) or not len(unlabelled):
        odds = np.clip(prior, 1e-6, 1 - 1e-6)
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES),
                            float(np.log(odds / (1 - odds))), prior)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float64) for x in (positive, unlabelled))
    w, b = np.zeros(p.shape[1]), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    step, m, v = 0, np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, rounds + 1):
        zp, zu = p @ w + b, u @ w + b
        hidden = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        if plain:
            hidden = 0.0
        up = prior * (sigmoid(zp) - 1) / len(p)                 # positives as positive
        down_u, down_p = sigmoid(zu) / len(u), -prior * sigmoid(zp) / len(p) * (not plain)
        gp, gu = (up + down_p, down_u) if hidden >= 0 else (-down_p, -down_u)
        g = np.append(gp @ p + gu @ u + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return QualityModel(mean, scale, w, float(b), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows.

    Above a threshold of any score lie a share p of the positives and a share
    u of the unlabelled rows, and u / p is at least the prior: equal where
    negatives do not reach. The threshold is the one with the least ratio
    plus its confidence term, which keeps small counts from deciding.
    """
    if min(len(positive), len(unlabelled)) < 2 * FEWEST:
        return PRIOR
    # Every second row of each sample is held back from the classifier.
    model = fit(positive[::2], unlabelled[::2], 0.5, plain=True)
    p, u = (np.sort(model.scores(x[1::2])) for x in (positive, unlabelled))
    at = np.unique(p)
    above = lambda x: 1 - np.searchsorted(x, at, "left") / len(x)
    share_p, share_u = above(p), above(u)
    doubt = sum(np.sqrt(np.log(4 / SURE) / (2 * len(x))) for x in (p, u))
    best = np.argmin((share_u + doubt) / share_p)
    return float(np.clip(share_u[best] / share_p[best], *BOUNDS))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Rows whose CRC-32 of the id as text falls in fold 0; null ids do not."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", positives: int = POSITIVES,
          unlabelled: int = UNLABELLED) -> QualityModel:
    """Fit on at most ``positives`` trusted and ``unlabelled`` other rows,
    none of them held out."""
    ready(docs.sparkSession)
    mark = F.xxhash64(F.col("id"))
    trusted = (labels.select(column(id_col).alias("id"), column(label_col).alias("y"))
               .filter(~held_out(F.col("id")) & F.col("id").isNotNull() & F.col("y").isNotNull())
               .groupBy("id").agg(F.min("y").alias("y")))

    rows = texts(docs, id_col, text_col)
    good = trusted.filter("y = 1").orderBy(mark, "id").limit(positives).select(
        "id", F.lit(True).alias("good"))
    # Its own order: a document may be in both samples, as in the theory.
    other = (docs.select(column(id_col).alias("id"))
             .filter(F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
             .orderBy(F.xxhash64(F.col("id"), F.lit(1)), "id").limit(unlabelled)
             .select("id", F.lit(False).alias("good")))
    sample = good.unionByName(other)  # positives + unlabelled rows at most

    def run(batches):
        for batch in batches:
            made = [features(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("good"), pa.array(made, pa.binary())],
                ["id", "good", "x"])

    id_type = rows.schema["id"].dataType.simpleString()
    # One row a sampled id: of an id with many texts the least features.
    found = (rows.join(F.broadcast(sample), "id").select("id", "good", "text")
             .mapInArrow(run, f"id {id_type}, good boolean, x binary")
             .groupBy("id", "good").agg(F.min("x").alias("x")).toPandas())
    found = found.sort_values("id", kind="stable")
    x = np.frombuffer(b"".join(found["x"]), dtype=np.float32).reshape(-1, N_FEATURES)
    is_good = found["good"].to_numpy(dtype=bool)
    positive, other = x[is_good], x[~is_good]
    return fit(positive, other, estimate_prior(positive, other))


def score_column(model: QualityModel, text: Column) -> Column:
    """The score (0 to 1) of a text column; batches run in Python workers."""

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in batch], dtype=np.float32).reshape(-1, N_FEATURES)
        return pd.Series(model.scores(x).astype(float))

    return score(text)


def score(df: DataFrame, model: QualityModel, text_col: str = "text",
          score_col: str = "score") -> DataFrame:
    ready(df.sparkSession)
    return df.withColumn(score_col, score_column(model, column(text_col)))


def keep_good(df: DataFrame, model: QualityModel, text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that score ``threshold`` or more."""
    ready(df.sparkSession)
    return df.filter(score_column(model, column(text_col)) >= threshold)
