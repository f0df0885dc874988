"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Frequent ids get small ranks, so most values take one byte. Each group of four values has one control byte with four
2-bit lengths; all control bytes stand before the data bytes, and a reader turns them into byte lengths by one table
lookup per control byte. Files hold blocks in ascending doc_id order:

    b"ELT1"  n_docs u32  n_ids u64  n_data u64  | doc_id i64 x n_docs | null flag u8 x n_docs | n_tokens u32 x n_docs
    | control bytes x ceil(n_ids / 4) | data bytes x n_data

ranks.bin beside them lists the token id of every rank (u32).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import scratch_path, slices, written
from eventlens.llm.files import RollingWriter, get, put, spread
from eventlens.llm.tokens import ChunkEncoder, vocabulary_path

HEAD = struct.Struct("<4sIQQ")
_LENGTHS = (np.arange(256)[:, None] >> (2 * np.arange(4)) & 3).astype(np.uint8) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint64)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = values.astype("<u4")
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = n - 1
    control = (code.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))).sum(1, dtype=np.uint8)
    keep = np.arange(4)[None, :] < n[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values back; the tail of the last control byte is ignored."""
    n = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    start = np.cumsum(n, dtype=np.int64) - n
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    word = raw[start].astype(np.uint64)
    for i in (1, 2, 3):
        if (n > i).any():
            word |= raw[start + i].astype(np.uint64) << np.uint64(8 * i)
    return (word & _MASKS[n]).astype(np.uint32)


def pack_block(docs: list, counts: np.ndarray, values: np.ndarray) -> bytes:
    control, data = encode_values(values)
    ids = np.array([0 if x is None else x for x in docs], "<i8")
    nulls = np.array([x is None for x in docs], np.uint8)
    return HEAD.pack(b"ELT1", len(docs), len(values), len(data)) + ids.tobytes() + nulls.tobytes() + counts.astype("<u4").tobytes() + control + data


def read_blocks(content: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, tokens per document, values) of every block of a file."""
    at = 0
    while at < len(content):
        magic, n_docs, n_ids, n_data = HEAD.unpack_from(content, at)
        if magic != b"ELT1":
            raise ValueError("not a token file")
        at += HEAD.size
        ids = np.frombuffer(content, "<i8", n_docs, at)
        nulls = np.frombuffer(content, np.uint8, n_docs, at + 8 * n_docs)
        counts = np.frombuffer(content, "<u4", n_docs, at + 9 * n_docs)
        at += 13 * n_docs
        n_control = -(-n_ids // 4)
        yield [None if z else int(i) for i, z in zip(ids, nulls, strict=True)], counts.astype(np.int64), decode_values(content[at : at + n_control], content[at + n_control : at + n_control + n_data], n_ids)
        at += n_control + n_data


def _tokenise(path: str, end_id: int, vocabulary_size: int):
    """Rows of kind 0: the ids of a document; of kind 1: how often each id stands in this task (id, count pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, seen = ChunkEncoder(path), np.zeros(vocabulary_size, np.int64)
        seq = TaskContext.get().partitionId() << 40
        kind = np.dtype("<u2" if vocabulary_size <= 1 << 16 else "<u4")
        for b in slices(batches, "text"):
            ids, n = encoder.encode(b.column("text"))
            seen += np.bincount(ids, minlength=vocabulary_size)
            seen[end_id] += len(n)
            whole = np.insert(ids.astype(kind), np.cumsum(n), end_id)
            offsets = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int64) * kind.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(whole.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), b.column("doc_id"), pa.array(seq + np.arange(len(n))), pa.array(n + 1), data.cast(pa.binary())], ["kind", "doc_id", "seq", "n_tokens", "ids"])
            seq += len(n)
        used = np.flatnonzero(seen)
        pairs = np.stack([used, seen[used]], 1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([seq]), pa.array([len(used)], pa.int64()), pa.array([pairs], pa.binary())], ["kind", "doc_id", "seq", "n_tokens", "ids"])

    return run


def _sum_counts(vocabulary_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocabulary_size, np.int64)
        for b in batches:
            for x in b.column("ids").to_pylist():
                pairs = np.frombuffer(x, "<i8").reshape(-1, 2)
                seen[pairs[:, 0]] += pairs[:, 1]
        used = np.flatnonzero(seen)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["id", "n"])

    return run


def write_token_files(docs: DataFrame, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocabulary: str | None = None, shard_tokens: int = 6_000_000, block_tokens: int = 1_000_000) -> tuple[str, DataFrame]:
    """Encode docs and write token files in ascending doc_id order; (folder URI, table of file, part, number, n_docs, n_tokens, start).

    Null text is empty (end_id alone), null ids come first, rows of one id follow each other in the order of the input
    and may fill many files. Ids are counted over all documents before they are ranked. start counts the ids of all
    files before one. Only the counts of the vocabulary come to the driver.
    """
    from tokenizers import Tokenizer

    spark, path = docs.sparkSession, vocabulary or vocabulary_path()
    uri = uri or scratch_path(spark, "tokens")
    size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(rows.mapInArrow(_tokenise(path, end_id, size), "kind int, doc_id long, seq long, n_tokens long, ids binary"), "ids")
    counts = rows.where("kind = 1").select("ids").mapInArrow(_sum_counts(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = sorted(range(size), key=lambda i, n=dict(map(tuple, counts)): (-n.get(i, 0), i))
    put(uri, "ranks.bin", np.array(order, "<u4").tobytes())
    total = sum(x["n"] for x in counts)
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, made, part = RollingWriter(uri, ".elt"), [], TaskContext.get().partitionId()
        held, n_held, n_docs, n_ids = [], 0, 0, 0

        def block() -> None:
            nonlocal held, n_held
            if held:
                ids = [np.frombuffer(x, kind) for _, x in held]
                out.write(pack_block([d for d, _ in held], np.array([len(x) for x in ids]), rank[np.concatenate(ids)]))
            held, n_held = [], 0

        def roll() -> None:
            nonlocal n_docs, n_ids
            if name := out.roll():
                made.append((name, part, len(made), n_docs, n_ids))
            n_docs = n_ids = 0

        for b in batches:
            for doc, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids")), strict=True):
                held.append((doc, ids))
                n_held, n_docs, n_ids = n_held + n, n_docs + 1, n_ids + n
                if n_held >= block_tokens:
                    block()
                    if out.full:
                        roll()
        block()
        roll()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64() if i else pa.string()) for i in range(5)], ["file", "part", "number", "n_docs", "n_tokens"])

    parts = max(1, -(-total // shard_tokens))
    order = [F.asc_nulls_first("doc_id"), F.asc("seq")]
    ranged = rows.where("kind = 0").select("doc_id", "seq", "n_tokens", "ids").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return uri, with_starts(written(ranged.mapInArrow(write, "file string, part long, number long, n_docs long, n_tokens long"), "token-files"), parts)


def with_starts(files: DataFrame, parts: int) -> DataFrame:
    """files with start, the n_tokens of all files before; running sums within runs of about sqrt(parts) parts, and over the runs."""
    width = max(1, int(parts**0.5))
    files = files.withColumn("run", (F.col("part") / width).cast("long"))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = files.groupBy("run").agg(F.sum("n_tokens").alias("n_tokens")).select("run", before(Window.orderBy("run")).alias("base"))
    within = files.withColumn("start", before(Window.partitionBy("run").orderBy("part", "number")))
    out = within.join(runs, "run").select("file", "part", "number", "n_docs", "n_tokens", (F.col("base") + F.col("start")).alias("start"))
    return written(out, "token-starts")


def read_token_files(uri: str, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) of every document in the listed files."""
    schema = "doc_id long, start long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = np.frombuffer(get(uri, "ranks.bin"), "<u4")
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                for docs, counts, values in read_blocks(get(uri, name)):
                    ids = ids_of[values].astype("<u4")
                    ends = np.cumsum(counts)
                    data = [ids[j - n : j].tobytes() for j, n in zip(ends, counts, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array(data, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                    start += int(ends[-1]) if len(ends) else 0

    return spread(files.select("file", "start")).mapInArrow(run, schema)


def checksum(values: np.ndarray) -> int:
    return zlib.crc32(values.astype("<u4").tobytes())


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    uri, files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_token_files(uri, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
