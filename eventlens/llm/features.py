"""Hashed byte n-gram frequencies of whole texts, and the training sample of a fold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 2048
_K2, _K3 = np.uint32(2654435761), np.uint32(2246822519)


def ngram_frequencies(texts: list[bytes | None], dims: int = DIMS) -> np.ndarray:
    """float32 [texts, dims]: shares of hashed byte bigrams (first half) and trigrams (second half); an empty text has zeros."""
    half, n = dims // 2, len(texts)
    shift = np.uint32(32 - (half.bit_length() - 1))
    out = np.zeros((n, dims), np.float32)
    size = np.array([len(t or b"") for t in texts], np.int64)
    flat = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # bytes from here to the text's end
    for k, (width, factor) in enumerate(((2, _K2), (3, _K3))):
        if len(flat) < width:
            continue
        gram = flat[: len(flat) - width + 1].copy()
        for i in range(1, width):
            gram = gram << np.uint32(8) | flat[i : len(flat) - width + 1 + i]
        inside = left[: len(gram)] >= width
        at = doc[: len(gram)] * np.int64(half) + ((gram * factor) >> shift)
        out[:, k * half : (k + 1) * half] = np.bincount(at[inside], minlength=n * half)[: n * half].reshape(n, half)
    return out / np.maximum(size, 1)[:, None].astype(np.float32)


def fold(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; rows where it is 2 are held out. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4, F.lit(0))


def threshold(most: int, n: int) -> int:
    """The signed 64-bit value below which a share most / n of all hashes lies; above every hash where n <= most."""
    return (1 << 63) - 1 if n <= most else (most << 64) // n - (1 << 63)


def sampled_features(df: DataFrame, text_col: str, label_col: str, most: int, salt: int, id_col: str = "doc_id", features=ngram_frequencies) -> tuple[np.ndarray, list]:
    """Features and labels of at most `most` rows per label, those of least salted hash; the same for the same rows.

    Tasks compute the features of about twice as many rows as are kept. Repeated rows may be drawn as often as they
    stand. Labels are few: one row each is counted on the driver.
    """
    import pyarrow as pa
    from pyspark.sql import Window

    from eventlens.llm.common import blobs, slices

    def run(batches):
        for b in slices(batches, "text", 1 << 20):
            x = features(blobs(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([r.tobytes() for r in x], pa.binary()), b.column("label")], ["h", "x", "label"])

    label = F.col(label_col).cast("string")
    counts = {r["label"]: r["count"] for r in df.groupBy(label.alias("label")).count().collect()}
    if not counts:
        return np.zeros((0, 0), np.float32), []
    cut = F.create_map(*(F.lit(v) for name, n in counts.items() if name is not None for v in (name, threshold(2 * most, n))))
    rows = df.select(F.xxhash64(F.lit(salt), F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"), label.alias("label"))
    rows = rows.where(F.col("h") <= F.try_element_at(cut, F.col("label"))).mapInArrow(run, "h long, x binary, label string")
    first = F.row_number().over(Window.partitionBy("label").orderBy("h", "x"))
    table = rows.withColumn("first", first).where(F.col("first") <= most).select("label", "h", "x").toArrow()
    if not len(table):
        return np.zeros((0, 0), np.float32), []
    # in order of labels and hashes, so that the order of tasks does not matter; rows of one hash are equal
    labels, order = table["label"].to_pylist(), np.lexsort((table["h"].to_numpy(), table["label"].to_numpy()))
    width = len(table["x"][0].as_py()) // 4
    flat, at = np.empty((len(order), width), np.float32), np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    start = 0
    for chunk in table["x"].chunks:
        for i, x in enumerate(chunk):
            flat[at[start + i]] = np.frombuffer(x.as_buffer(), np.float32)
        start += len(chunk)
    del table
    pa.default_memory_pool().release_unused()
    return flat, [labels[i] for i in order]


def shape_features(texts: list[bytes | None]) -> np.ndarray:
    """float32 [texts, 6]: shares of equal neighbour words, of distinct words, of upper-case letters, of ASCII signs, of words of one sign, of repeated lines."""
    out = np.zeros((len(texts), 6), np.float32)
    upper, signs = bytes(range(65, 91)), bytes(c for c in range(33, 127) if not chr(c).isalnum())
    for i, text in enumerate(texts):
        if not text:
            continue
        words, lines = text.split(), text.split(b"\n")
        n = max(1, len(words))
        distinct = len(set(words))
        # only texts with few distinct words can have many equal neighbours
        near = sum(map(bytes.__eq__, words, words[1:])) / n if distinct < 0.95 * n else 0.0
        size = len(text)
        out[i] = near, distinct / n, (size - len(text.translate(None, upper))) / size, (size - len(text.translate(None, signs))) / size, sum(w in _SIGNS for w in words) / n, 1 - len(set(lines)) / len(lines)
    return out


_SIGNS = frozenset(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
