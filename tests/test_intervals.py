"""Intervals as tree nodes, and query tables joined by them."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from eventlens.functions.intervals import tree_cover, tree_path
from eventlens.functions.time import DAY_TAG
from eventlens.operators import filters as X

NOW = datetime(2024, 1, 31)


def test_cover_and_path_meet_once(spark):
    levels, rows = 6, [(a, b) for a in range(0, 65, 3) for b in range(0, 65, 5)] + [(None, 3), (3, None)]
    df = spark.createDataFrame(rows, "a int, b int").select("a", "b", tree_cover(F.col("a"), F.col("b"), levels).alias("cover"))
    for a, b, cover in df.collect():
        held = sorted(x for k, n in cover or [] for x in range(n << k, n + 1 << k))
        assert held == (list(range(a, b)) if None not in (a, b) else [])
        assert len(cover or []) <= 2 * levels
    path = spark.range(64).select("id", tree_path(F.col("id"), levels).alias("p")).where("id = 37").first()["p"]
    assert [tuple(n) for n in path] == [(k, 37 >> k) for k in range(7)]


def made(spark, n=150, m=60):
    rng = random.Random(5)
    at = lambda: datetime(2023, 11, 1) + timedelta(hours=rng.randrange(24 * 95))
    events = []
    for i in range(n):
        a = at()
        end = rng.choice([None, a, a + timedelta(hours=rng.randrange(1, 2000)), a - timedelta(hours=3)])
        events.append((f"e{i}", "cyber", rng.randrange(5), 1, ["PL"], "active", end, [DAY_TAG] if i % 3 == 0 else [], at(), at(), at(), a if i % 5 else None))
    schema = "id string, category string, severity int, independent_source_count int, countries array<string>, lifecycle_status string, valid_to timestamp, tags array<string>, occurred_start timestamp, last_changed_at timestamp, issued_at timestamp, valid_from timestamp"
    queries = []
    for i in range(m):
        a = at()
        queries.append((f"q{i}", rng.choice(["occurred", "changed", "published", "validity"]), 24, a, a + timedelta(hours=rng.choice([1, 24, 100, 720])), None, None, rng.randrange(3), 1, True))
    q = "query_id string, time_basis string, window_hours int, since timestamp, until timestamp, category string, country string, severity_min int, min_sources int, include_inactive boolean"
    return spark.createDataFrame(queries, q), spark.createDataFrame(events, schema)


def test_both_ways_of_a_query_table_agree_and_give_each_pair_once(spark):
    queries, events = made(spark)
    few = sorted(map(tuple, X.run_queries(queries, events, NOW).collect()))
    many = sorted(map(tuple, X.run_queries(queries, events, NOW, most=0).collect()))
    assert few == many and len(set(many)) == len(many) > 500
    one = X.run_queries(queries.where("query_id = 'q1'"), events, NOW, most=0)
    assert sorted(map(tuple, one.collect())) == [p for p in few if p[0] == "q1"]
    assert X.run_queries(queries, events.limit(0), NOW, most=0).isEmpty()
