"""Cutting a lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own where it is unset on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="eventlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each job inside go as soon as it has ended, not with the driver's next collection of garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_wide(df: DataFrame) -> DataFrame:
    """cut() by way of a compressed Parquet table in the shared folder, for wide rows; what was shuffled for it is dropped at once. Order is not kept."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wide-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, columns: dict | None = None) -> DataFrame:
    """df with more columns, all of which are computed once a row, however often filters and columns behind it name them.

    The optimizer copies an expression to all places that name it; it never copies one into or over a generated row.
    """
    df = df.withColumns(columns) if columns else df
    return df.select(F.explode(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))).alias("__row")).select("__row.*")


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df with a broadcast hint if it was counted to hold at most `most` rows; otherwise joins shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
