"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import written


def _joined(sides: DataFrame, label: str) -> DataFrame:
    """(u, v) rows with m, the least of u and its neighbours; the minima are a written table, so AQE can split a hub's rows."""
    least = written(sides.groupBy("u").agg(F.min("v").alias("m")), label)
    return sides.join(least, "u").withColumn("m", F.least("m", "u"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id of an edge between two different ids, with the smallest id that it reaches.

    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    pairs = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    pairs = written(pairs, "edges")
    state = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select(F.col("v"), F.col("v"))).distinct()
        state = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined(both, "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _joined(written(large, "star"), "small")
        pairs = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u <> v").distinct(), "edges")


class LocalComponents:
    """Components of edges between numbers below n inside one task; `root` gives the smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = np.asarray(a), np.asarray(b)
        while len(a):
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
