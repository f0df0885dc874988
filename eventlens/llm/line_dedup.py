"""Line deduplication over a whole corpus by range-partitioned line hashes.

Line hashes are range-partitioned by (hash, document) and sorted by hash, then document descending, then position.
Each task streams its sorted rows once: the first document of a hash keeps its lines, later ones lose theirs once
the hash was seen in enough documents. A hash that crosses a task's border (a hot line spans many tasks) is left
open; what is known of it there is one row per task and hash, summed afterwards. Decisions come back as
compressed keep bitmaps per document, never as text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import OWN, blobs, slices, text_key, written

_LINES = "h1 long, h2 long, doc long, tkey long, pos int"
_SEEN = "h1 long, h2 long, doc long, tkey long, pos int, open boolean, n int"
#: White space that is stripped from both ends of a line's key.
STRIP = b" \t\n\x0b\x0c\r"


def split_lines(text: bytes | None) -> list[bytes]:
    """The lines of a text; null and empty texts hold one empty line."""
    return (text or b"").split(b"\n")


def _emit(min_chars: int, id_col: str, text_col: str, key_col: str):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in slices(batches, text_col):
            ids, keys = batch.column(id_col).to_pylist(), batch.column(key_col).to_pylist()
            hashes, docs, tkeys, pos = [], [], [], []
            for doc, tkey, text in zip(ids, keys, blobs(batch.column(text_col)), strict=True):
                for i, line in enumerate(split_lines(text)):
                    line = line.strip(STRIP)
                    if len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode("utf-8", "replace")) >= min_chars):
                        hashes.append(digest(line.lower()))
                        docs.append(doc)
                        tkeys.append(tkey)
                        pos.append(i)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs, pa.int64()), pa.array(tkeys, pa.int64()), pa.array(pos, pa.int32())], ["h1", "h2", "doc", "tkey", "pos"])

    return run


def _stream(min_docs: int):
    """Sorted rows in; out: dropped lines, and for the first and last hash of the task (which may go on elsewhere) all lines, open, with the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        first = True

        def decide(rows: np.ndarray, edge: bool) -> pa.RecordBatch | None:
            """rows: whole hashes, columns h1 h2 doc tkey pos."""
            if not len(rows):
                return None
            new_hash = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
            new_doc = new_hash | np.r_[True, rows[1:, 2] != rows[:-1, 2]]
            group = np.cumsum(new_hash) - 1
            docs = np.bincount(group, new_doc).astype(np.int64)[group]
            top = rows[np.flatnonzero(new_hash)][:, 2][group]
            if edge:
                keep, n = np.ones(len(rows), bool), np.where(new_doc, 1, 0)
            else:
                keep, n = (docs >= min_docs) & (rows[:, 2] != top), docs
            if not keep.any():
                return None
            x = rows[keep]
            return pa.RecordBatch.from_arrays(
                [*(pa.array(np.ascontiguousarray(x[:, i])) for i in range(4)), pa.array(x[:, 4].astype(np.int32)), pa.array(np.full(len(x), edge)), pa.array(n[keep].astype(np.int32))],
                ["h1", "h2", "doc", "tkey", "pos", "open", "n"],
            )

        def settled(last: bool) -> Iterator[pa.RecordBatch]:
            """Decides on all held hashes but the last, which more rows may follow."""
            nonlocal held, first
            rows = np.concatenate(held)
            at = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
            begin = 0
            if first and (len(at) > 1 or last):
                begin = at[1] if len(at) > 1 else len(rows)
                yield decide(rows[:begin], True)
                first = False
            if first:  # one hash so far
                held = [rows]
                return
            end = max(begin, at[-1])
            yield decide(rows[begin:end], False)
            held = [rows[end:]]
            if last:
                yield decide(rows[end:], True)

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], 1))
                if len(held) > 1 and first and (held[0][0, :2] == held[-1][-1, :2]).all():
                    # one hash fills the task: pass its rows on and hold the last row alone
                    rows = np.concatenate(held)
                    if (out := decide(rows[:-1], True)) is not None:
                        yield _mend(out, rows)
                    held = [rows[-1:]]
                    continue
                yield from (x for x in settled(False) if x is not None)
        if held and sum(map(len, held)):
            yield from (x for x in settled(True) if x is not None)

    def _mend(out: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
        """The row held back counts its document again: the rows passed on leave that one out."""
        n = out.column(6).to_numpy(zero_copy_only=False).copy()
        n[rows[:-1, 2] == rows[-1, 2]] = 0
        return out.set_column(6, "n", pa.array(n))

    return run


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, tkey, pos) of the lines to drop; tkey tells rows of one id with different texts apart.

    A key is the line stripped of ASCII white space with A-Z lower-cased. Keys of min_chars code points or more that
    are found in min_docs documents or more lose their lines except in the largest id. Rows without an id take no part.
    """
    spark = docs.sparkSession
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("tkey"), F.col(text_col).alias("body"))
    lines = lines.mapInArrow(_emit(min_chars, "doc", "body", "tkey"), _LINES)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size >> 28) + 1)  # a partition has the lines of about 256 MB at most
    ordered = lines.withColumn("down", F.bitwise_not("doc")).repartitionByRange(parts, "h1", "h2", "down").sortWithinPartitions("h1", "h2", "down", "tkey", "pos").drop("down")
    seen = written(ordered.mapInArrow(_stream(min_docs), _SEEN), "lines")
    edges = seen.where("open").groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("doc").alias("top")).where(F.col("docs") >= min_docs)
    # at most two hashes per task of the sorted pass, so this side stays small: tasks x 32 bytes
    late = seen.where("open").join(F.broadcast(edges), ["h1", "h2"]).where(F.col("doc") < F.col("top"))
    return seen.where(~F.col("open")).select("doc", "tkey", "pos").unionByName(late.select("doc", "tkey", "pos"))


def pack_bitmap(n_lines: int, dropped) -> bytes:
    """zlib-compressed keep bits, one per line, most significant first."""
    keep = np.ones(n_lines, np.uint8)
    keep[np.asarray(dropped, np.int64)] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def unpack_bitmap(data: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, tkey, n_bits, bitmap) for documents that lose a line; bits beyond n_bits are kept lines.

    Empty tables give no rows; repeated rows of one id count as one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = [np.unique(x) for x in b.column("pos").to_pylist()]
            n = [int(x[-1]) + 1 for x in pos]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tkey"), pa.array(n, pa.int32()), pa.array([pack_bitmap(k, x) for k, x in zip(n, pos, strict=True)], pa.binary())], ["doc", "tkey", "n_bits", "bitmap"])

    drops = dropped_lines(docs, id_col, text_col, min_chars, min_docs)
    return drops.groupBy("doc", "tkey").agg(F.collect_list("pos").alias("pos")).mapInArrow(run, "doc long, tkey long, n_bits int, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut to its kept lines, and n_lines and n_dropped of each row added as __el_lines and __el_dropped.

    A text that loses nothing stays as it is, null included.
    """
    own = [f"{OWN}lines", f"{OWN}dropped"]
    key, bits = f"{OWN}key", bitmaps.select(*(F.col(c).alias(OWN + c) for c in ("doc", "tkey", "n_bits", "bitmap")))
    both = docs.withColumn(key, text_key(text_col))
    both = both.join(bits, (F.col(id_col) == F.col(f"{OWN}doc")) & (F.col(key) == F.col(f"{OWN}tkey")), "left").drop(key, f"{OWN}doc", f"{OWN}tkey")
    columns = docs.columns
    schema = docs.select(*columns).withColumns({c: F.lit(0).cast("long") for c in own}).schema
    from eventlens.llm.common import plain

    arrow = plain(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            texts, lines, dropped = blobs(b.column(text_col)), [], []
            for i, (n, bitmap) in enumerate(zip(b.column(f"{OWN}n_bits").to_pylist(), b.column(f"{OWN}bitmap").to_pylist(), strict=True)):
                if bitmap is None:
                    lines.append((texts[i] or b"").count(b"\n") + 1)
                    dropped.append(0)
                    continue
                parts, keep = split_lines(texts[i]), unpack_bitmap(bitmap, n)
                kept = [x for x, k in zip(parts, keep, strict=False) if k] + parts[n:]
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
                texts[i] = b"\n".join(kept)
            arrays = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text_col else b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], schema=arrow)

    return both.select(*columns, f"{OWN}n_bits", f"{OWN}bitmap").mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs without the lines that repeat across documents; a document that loses all its lines keeps an empty text."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col).drop(f"{OWN}lines", f"{OWN}dropped")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", F.col(f"{OWN}lines").alias("n_lines"), F.col(f"{OWN}dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, i.pos AS pos, i.line AS line, translate(trim(i.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), E'\n'), lambda x, j: {'pos': j, 'line': x})) AS i FROM documents)
), k AS (
  SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), d AS (
  SELECT l.doc_id, l.pos, l.line, k.key IS NOT NULL AND l.doc_id <> k.top AS dropped FROM l LEFT JOIN k USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
