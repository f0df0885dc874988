"""Whole-number intervals as nodes of a binary tree: node n of level k holds n * 2^k <= x < (n + 1) * 2^k."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _node(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def tree_path(x: Column, levels: int) -> Column:
    """The nodes that hold x, one a level from 0 to `levels`. Null for null."""
    path = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), _node(x, k).alias("node")))
    return F.when(x.isNotNull(), path)


def tree_cover(first: Column, last: Column, levels: int) -> Column:
    """The fewest disjoint nodes that make up first <= x < last: at most two a level. None where the interval is empty or a bound is null.

    Bounds lie between 0 and 2^levels. A number is in the interval exactly if its path meets the cover, and then in one node.
    """

    def of_level(k: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1), k)
        low, high = _node(first + one - 1, k), _node(last, k)
        left = F.when((low < high) & (low % 2 == 1), F.struct(k.alias("level"), low.alias("node")))
        right = F.when((low < high) & (high % 2 == 1), F.struct(k.alias("level"), (high - 1).alias("node")))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of_level)))
