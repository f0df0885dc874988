"""Language identification with error-correcting output codes.

Each language has a codeword. One binary classifier per bit, linear over hashed byte n-grams, is trained on labelled
text; a document's language is the one whose codeword has the least loss under the bits' margins. A document whose
two best languages are close is flagged as ambiguous.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import blobs, free_name, plain, slices
from eventlens.llm.features import fold, ngram_frequencies, sampled_features

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text.decode("utf-8", "replace")))


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """int8 [k, bits] of -1 and 1: all splits for up to 7 languages, beyond that the widest-set of some random codes."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 7:
        splits = np.arange(1, 1 << (k - 1))
        bits = np.stack([np.zeros_like(splits), *(splits >> i & 1 for i in range(k - 1))])
        return (2 * bits - 1).astype(np.int8)
    rng, best, width = np.random.default_rng(seed), None, int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (k, width))
        gap = min(int((code[i] != code[i + 1 :]).sum(1).min()) for i in range(k - 1))
        if best is None or gap > best[0]:
            best = (gap, code)
    return best[1]


@dataclass
class LanguageModel:
    names: list[str]
    code: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # [dims, bits]
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its share of the softmax of negated losses, gap to the second's)."""
        margin = ((x - self.mean) * self.scale) @ self.weights + self.bias
        loss = np.stack([np.logaddexp(0, -margin * word).mean(1) for word in self.code], 1) * 4
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        order = np.sort(share, 1)
        gap = order[:, -1] - order[:, -2] if share.shape[1] > 1 else np.ones(len(x))
        return loss.argmin(1), share.max(1), gap


def fit_ecoc(x: np.ndarray, labels: list[str], steps: int = 200, rate: float = 0.05, decay: float = 1e-3) -> LanguageModel:
    names = sorted(set(labels))
    code = codewords(len(names))
    y = code[[names.index(c) for c in labels]].astype(np.float32)
    mean = x.mean(0)
    scale = (1 / np.maximum(x.std(0), 1e-4)).astype(np.float32) / np.float32(np.sqrt(x.shape[1]))
    z = (x - mean) * scale
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    share = np.array([labels.count(c) for c in names], np.float32) / len(labels)
    weight = 1 / (len(names) * share[[names.index(c) for c in labels]])[:, None] / len(labels)
    m = v = 0
    for t in range(1, steps + 1):
        d = -y * weight / (1 + np.exp(np.clip(y * (z @ w + b), -30, 30)))
        g = np.concatenate([z.T @ d + decay * w, d.sum(0, keepdims=True)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), (b - step[-1]).astype(np.float32)
    return LanguageModel(names, code, mean, scale, w, b)


def train_language(docs: DataFrame, most: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fit on at most `most` labelled texts per language, none of the held-out fold; None without any."""
    train = docs.where((fold(id_col) != 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, lang_col)
    x, labels = sampled_features(train, text_col, lang_col, most, 3, id_col)
    return fit_ecoc(x, labels) if len(x) else None


def identify_language(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", ambiguous_below: float = 0.1) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_ambiguous added; `und` with score 0 where a text is null or has no letter.

    Of languages with equal loss the first by name is taken, and the row is ambiguous. Columns of docs that bear these
    names stay; the new ones then end in an underscore. Texts of any length are read whole, a few megabytes at a time.
    """
    extra = {free_name(docs, "lang_pred"): F.lit(""), free_name(docs, "lang_score"): F.lit(0.0), free_name(docs, "lang_ambiguous"): F.lit(False)}
    schema = docs.withColumns(extra).schema
    arrow, names = plain(schema), docs.columns

    def run(batches):
        for b in slices(batches, text_col, 1 << 20):
            texts = blobs(b.column(text_col))
            known = np.array([model is not None and has_letter(t) for t in texts])
            pred, score, gap = np.zeros(len(texts), int), np.zeros(len(texts)), np.ones(len(texts))
            if known.any():
                pred[known], score[known], gap[known] = model.decode(ngram_frequencies([t for t, k in zip(texts, known, strict=True) if k]))
            label = [model.names[p] if k else "und" for p, k in zip(pred, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(label, pa.string()), pa.array(score), pa.array(gap < ambiguous_below)], schema=arrow)

    return docs.mapInArrow(run, schema)


def op10_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify_language(docs.select("doc_id", "text"), train_language(docs))
    return found.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
