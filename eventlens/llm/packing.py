"""Sum-of-squares packing of token documents into fixed windows.

Each task packs the documents of its own input partition while it reads them: no shuffle. A document longer than a
window fills whole windows first; its rest is an item. An item goes to the fill level (or to a new window) which
minimises the sum of squared counts of partially filled windows; the counts sit in one level array. What is still
open at the end, or beyond max_open windows, is laid end to end and cut into full windows, and the last rest into
windows of powers of two, so nothing is padded and at most 11 short windows remain per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import slices
from eventlens.llm.tokens import ChunkEncoder, vocabulary_path

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_NONE = np.iinfo(np.int64).max


class SumOfSquares:
    """The online packer. Pieces are (doc, start, ids, doc_tokens); finished windows go to `out`."""

    def __init__(self, window: int, first_id: int = 0, max_open: int = 16_384):
        self.window, self.next_id, self.max_open = window, first_id, max_open
        self.count = np.zeros(window + 1, np.int64)
        self.at: dict[int, list[list]] = {}
        self.n_open = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def level(self, size: int) -> int:
        """The level to place an item at; 0 opens a window."""
        w, n = self.window, self.count
        new = 2 * n[size] + 1
        if size == w:
            return 0
        gain = n[1 + size : w + 1] - n[1 : w - size + 1]  # half the change, for levels 1 .. w - size
        gain = np.where(n[1 : w - size + 1] > 0, 2 * gain + 2, _NONE)
        if gain[-1] != _NONE:
            gain[-1] -= 1  # a full window is counted no more
        best = len(gain) - 1 - int(np.argmin(gain[::-1]))  # the fullest of equal ones
        return best + 1 if gain[best] <= new else 0

    def add(self, doc, ids: np.ndarray) -> None:
        total, start, w = len(ids), 0, self.window
        while total - start >= w:
            self._emit([(doc, start, ids[start : start + w], total)])
            start += w
        if start == total:
            return
        # a copy: a view would keep the whole document as long as its window is open
        piece, size = (doc, start, ids[start:].copy(), total), total - start
        old = self.level(size)
        if old:
            pieces = self.at[old].pop()
            self.count[old] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if old + size == w:
            self._emit(pieces)
            return
        self.count[old + size] += 1
        self.at.setdefault(old + size, []).append(pieces)
        self.n_open += 1
        if self.n_open > self.max_open:
            self.flush(rest=False)

    def flush(self, rest: bool = True) -> None:
        """Lay the open windows end to end and cut; without rest, what doesn't fill a window stays open."""
        line = [x for level in sorted(self.at, reverse=True) for pieces in self.at[level] for x in pieces]
        self.count[:] = 0
        self.at, self.n_open = {}, 0
        if not line:
            return
        held, room = [], self.window
        left = sum(len(x[2]) for x in line)

        def size() -> int:
            return self.window if left >= self.window or not rest else 1 << (left.bit_length() - 1)

        room = size()
        for doc, start, ids, total in line:
            while len(ids):
                part = ids[:room]
                held.append((doc, start, part, total))
                ids, start, room = ids[len(part) :], start + len(part), room - len(part)
                if not room:
                    left -= sum(len(x[2]) for x in held)
                    self._emit(held)
                    held = []
                    room = size() if left else 0
        if held:
            level = sum(len(x[2]) for x in held)
            self.count[level] += 1
            self.at[level] = [held]
            self.n_open = 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every row is one document, also when its id is null or repeated; null text is empty and holds end_id alone. Each
    id of a document, end_id included, lies in exactly one piece. sequence_id is unique over the table: the input
    partition in the upper bits, a counter in the lower 33. Ties between fill levels go to the fullest. A text of any
    length is packed whole. At most 16,384 windows stay open in a task, which hold their own ids and no more: 128 MB. When
    there are more, as with documents that are all longer than half a window, the open ones are laid end to end and cut.
    In partitions of few documents that final cut makes most windows.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = ChunkEncoder(path), SumOfSquares(window, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], np.uint32)
        for b in slices(batches, "text"):
            ids, n = encoder.encode(b.column("text"))
            bounds = np.concatenate([[0], np.cumsum(n)])
            for doc, i, j in zip(b.column("doc_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                packer.add(doc, np.concatenate([ids[i:j], end]).astype("<u4"))
            if packer.out:
                yield _batch(packer.out)
                packer.out = []
        packer.flush()
        if packer.out:
            yield _batch(packer.out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return with_digest(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
