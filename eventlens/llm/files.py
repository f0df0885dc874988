"""Custom binary files on the shared file system: tasks write them, a Parquet table lists those of successful tasks.

A file's name is never used twice, so attempts of one task cannot meet; files of lost attempts are in no list and are
never read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


class RollingWriter:
    """Writes files of about `limit` bytes into a directory URI."""

    def __init__(self, uri: str, suffix: str, limit: int = 24 << 20):
        self.fs, self.root = _system(uri)
        self.suffix, self.limit = suffix, limit
        self.size, self.stream, self.name = 0, None, None
        self.fs.create_dir(self.root, recursive=True)

    def write(self, data: bytes) -> None:
        if self.stream is None:
            self.name, self.size = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.stream = self.fs.open_output_stream(f"{self.root}/{self.name}")
        self.stream.write(data)
        self.size += len(data)

    @property
    def full(self) -> bool:
        return self.size >= self.limit

    def roll(self) -> str | None:
        """Close the open file and give its name."""
        if self.stream is None:
            return None
        self.stream.close()
        self.stream, self.size = None, 0
        return self.name


def put(uri: str, name: str, data: bytes) -> None:
    system, root = _system(uri)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{name}") as f:
        f.write(data)


def open_file(uri: str, name: str):
    system, root = _system(uri)
    return system.open_input_stream(f"{root}/{name}")


def get(uri: str, name: str) -> bytes:
    with open_file(uri, name) as f:
        return f.read()


def spread(files: DataFrame, most: int = 10_000) -> DataFrame:
    """Rows of a file list dealt one by one over tasks (`most` at most), however few of its own partitions hold them."""
    n = files.count()
    return files.repartition(max(1, min(n, most)), F.xxhash64("file")) if n else files


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (weight in bytes, values) rows, cut at about `size` bytes."""
    held, weight = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for n, row in rows:
        held.append(row)
        weight += n + 64
        if weight > size:
            yield batch()
            held, weight = [], 0
    if held:
        yield batch()
