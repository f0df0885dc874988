"""Positive-unlabelled quality classifier.

A linear model over hashed byte n-grams and a few shape features of the whole text is trained with the non-negative unbiased risk: trusted
positives (labels.quality = 1) against unlabelled web text; labels of 0 are never used. The class prior is estimated from
the two samples alone: models that tell positives from unlabelled text score the folds that they have not seen, and the
least ratio of the shares above a threshold bounds the prior (best-bin estimation). When the estimated negative
risk turns negative, its gradient is reversed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import blobs, free_name, plain, slices
from eventlens.llm.features import fold, ngram_frequencies, sampled_features, shape_features

#: Shape features, after the n-grams.
N_SHAPE = 6


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def features(texts: list[bytes | None]) -> np.ndarray:
    """N-gram shares, shape features, and last how much evidence a text of its length is (0 to 1)."""
    size = np.array([len(t or b"") for t in texts], np.float32)[:, None]
    return np.concatenate([ngram_frequencies(texts), shape_features(texts), size / (size + 24)], 1)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, drawn to the mean where a text is short."""
        return (x[:, :-1] - self.mean) * self.scale * x[:, -1:]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.inputs(x) @ self.weights + self.bias)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.02, decay: float = 1e-3, negative_floor: bool = True, rows: tuple | None = None) -> QualityModel:
    """Full-batch Adam on the non-negative risk with the logistic loss; without the floor, positives against all unlabelled. rows: the rows of both to take."""
    of_p, of_u = (np.arange(len(positive)), np.arange(len(unlabelled))) if rows is None else rows
    n, width = len(of_p), positive.shape[1] - 1
    z = np.empty((n + len(of_u), width), np.float32)  # one array, standardised in place
    np.take(positive[:, :-1], of_p, 0, out=z[:n], mode="clip")
    np.take(unlabelled[:, :-1], of_u, 0, out=z[n:], mode="clip")
    mean = z.mean(0)
    z -= mean
    scale = (1 / np.maximum(np.sqrt(np.einsum("ij,ij->j", z, z, dtype=np.float64) / len(z)), 1e-4)).astype(np.float32)
    scale[:-N_SHAPE] /= np.float32(np.sqrt(positive.shape[1]))
    model = QualityModel(mean, scale, np.zeros(width, np.float32), 0.0, prior)
    z *= scale
    p, u = z[:n], z[n:]
    p *= positive[of_p, -1:]
    u *= unlabelled[of_u, -1:]
    w, b = model.weights, float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        loss = lambda z: np.logaddexp(0, z)  # noqa: E731  of the negative class
        negative = loss(zu).mean() - prior * loss(zp).mean()
        up, uu = prior * (sp - 1) / len(p), np.zeros(len(u))
        if not negative_floor:
            uu = (1 - prior) * su / len(u)
        elif negative >= 0:
            up, uu = up - prior * sp / len(p), su / len(u)
        else:  # step back along the negative risk alone
            up, uu = prior * sp / len(p), -su / len(u)
        g = np.r_[up.astype(np.float32) @ p + uu.astype(np.float32) @ u + decay * w, up.sum() + uu.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    model.weights, model.bias = w, b
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, folds: int = 4) -> float:
    """Share of positives among the unlabelled, 0.01 to 0.99, from scores of rows that the scoring model has not seen.

    Above any score threshold, the unlabelled share is at least prior times the positive share, with equality where
    no negative scores that high; the threshold of the least upper bound (shares with their deviations) is taken. Since
    that errs upwards in small samples, one standard deviation of the share comes off.
    """
    rng = np.random.default_rng(4)
    of_p, of_u = rng.permutation(len(positive)) % folds, rng.permutation(len(unlabelled)) % folds
    if len(positive) < folds or len(unlabelled) < folds:
        return 0.5
    p, u = [], []
    for i in range(folds):
        model = fit_nnpu(positive, unlabelled, 0.5, steps=150, negative_floor=False, rows=(np.flatnonzero(of_p != i), np.flatnonzero(of_u != i)))
        p.append(model.score(positive[of_p == i]))
        u.append(model.score(unlabelled[of_u == i]))
    p, u = np.sort(np.concatenate(p)), np.sort(np.concatenate(u))
    above = 1 - np.arange(len(p)) / len(p)  # share of positives at or above each positive score
    share = 1 - np.searchsorted(u, p, "left") / len(u)
    bound = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(np.argmin((share + bound) / above))
    spread = np.sqrt(share[best] * (1 - share[best]) / len(u))
    return float(np.clip((share[best] - spread) / above[best], 0.01, 0.99))


def train_quality(docs: DataFrame, labels: DataFrame, most: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> QualityModel | None:
    """Fit on at most `most` trusted positives and as many unlabelled texts, none of the held-out fold.

    A document is a trusted positive if all its quality labels that are not null are 1. None without positives.
    """
    train = docs.where(fold(id_col) != 2).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    trusted = labels.where(F.col("quality").isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.min("quality").alias("least"), F.max("quality").alias("greatest"))
    marked = train.join(trusted.where("least = 1 and greatest = 1"), "id", "left_semi")
    positive, _ = sampled_features(marked.withColumn("label", F.lit("p")), "text", "label", most, 1, "id", features)
    unlabelled, _ = sampled_features(train.withColumn("label", F.lit("u")), "text", "label", most, 2, "id", features)
    if not len(positive) or not len(unlabelled):
        return None
    return fit_nnpu(positive, unlabelled, estimate_prior(positive, unlabelled))


def score_quality(docs: DataFrame, model: QualityModel | None, text_col: str = "text", column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 added; null and empty texts get that of no n-grams, 0.5 without a model.

    A column of docs that bears the name stays; the new one then ends in an underscore. Equal texts score alike. Texts
    of any length are read whole, a few megabytes at a time.
    """
    column = free_name(docs, column)
    schema = docs.select("*", F.lit(0.0).alias(column)).schema
    arrow = plain(schema)
    names = docs.columns

    def run(batches):
        for b in slices(batches, text_col, 1 << 20):
            score = model.score(features(blobs(b.column(text_col)))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(score.astype(np.float64))], schema=arrow)

    return docs.mapInArrow(run, schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs.select("doc_id", "text"), train_quality(docs, labels))
    return scored.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
