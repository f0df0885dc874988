"""Identity in rounds over all rows against the replay of one row at a time."""

import random
from datetime import timedelta

from eventlens.operators import identity as I
from tests.test_ingest import NOW, norm


def outcome(spark, rows, known, overrides, stored, rounds):
    e = spark.createDataFrame(known, "external_id string, event_id string")
    o = spark.createDataFrame(overrides, "source_id string, provider_record_id string, event_id string")
    s = spark.createDataFrame(stored, "source_id string, provider_record_id string, event_id string, external_ids array<string>")
    good, bad = I.resolve_identity(norm(spark, *rows), e, o, s, rounds, 0)
    found = good.select("record_id", "raw_hash", "event_id", "is_new").collect()
    return sorted(map(repr, map(tuple, found))), sorted(map(repr, map(tuple, bad.select("record_id", "raw_hash", "reason").collect())))


def made(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        source = rng.choice(["usgs", "gdacs", "meteoalarm", "cisa_kev"])
        keys = [f"usgs:{rng.randrange(90)}" for _ in range(rng.choice([0, 1, 1, 2]))] + (["usgs:hot"] if rng.random() < 0.15 else [])
        row = {"source_id": source, "provider_record_id": f"r{rng.randrange(110)}", "external_ids": keys, "title": str(i), "source_updated_at": rng.choice([None, NOW - timedelta(minutes=rng.randrange(9))])}
        if source == "meteoalarm":
            row |= {"sender": rng.choice("AB"), "external_ids": [*keys, f"cap:{rng.choice('AB')}:{row['provider_record_id']}"]}
        rows.append(row)
    known = [(f"usgs:{k}", f"E{k % 7}") for k in range(0, 90, 9)]
    overrides = [("usgs", f"r{k}", f"O{k % 3}") for k in range(0, 110, 11)]
    stored = [(s, f"r{k}", f"S{k % 5}", [f"cap:A:r{k}"]) for s in ("usgs", "meteoalarm") for k in range(0, 110, 13)]
    return rows, known, overrides, stored


def test_rounds_equal_the_replay(spark):
    seen = set()
    for seed in (1,):
        given = made(seed)
        want = outcome(spark, *given, 0)
        for rounds in (4,):
            assert outcome(spark, *given, rounds) == want
        seen |= {r.split("'")[-2] for r in want[1]}
    assert {"identity_conflict", "override_conflict", "cap_sender_conflict"} <= seen


def test_a_hot_key_needs_no_single_task(spark):
    rows = [{"provider_record_id": f"r{i}", "external_ids": ["usgs:hot"], "source_updated_at": NOW} for i in range(300)]
    good, bad = I.resolve_identity(norm(spark, *rows), spark.createDataFrame([], "external_id string, event_id string"), replayed=0)
    assert bad.count() == 0 and {r.event_id for r in good.collect()} == {"ev:record:usgs:r0"} and good.where("is_new").count() == 1
    line = norm(spark, *rows[:3])
    assert I.resolve_identity(line.limit(0), spark.createDataFrame([], "external_id string, event_id string"))[0].count() == 0


def test_a_chain_longer_than_the_rounds(spark):
    rows = [{"provider_record_id": f"r{i:02}", "external_ids": [f"usgs:{i}", f"usgs:{i + 1}"], "source_updated_at": NOW + timedelta(minutes=i)} for i in range(25)]
    given = rows, [], [], []
    assert outcome(spark, *given, 3) == outcome(spark, *given, 0)


def test_withdrawals_count_keys_of_the_given_kinds(spark):
    from eventlens import queries, state_queries  # noqa: F401

    found = {n: {r.id for r in queries.QUERIES[n](spark, "/root/testdata/sf0.001").collect()} for n in ("j03_known_only", "j03_known_own_keys")}
    assert found["j03_known_own_keys"] < found["j03_known_only"]


def test_wide_cuts_leave_compressed_tables_and_no_shuffles(spark, tmp_path):
    """What is cut holds less than its rows, keeps its schema when empty, and its job's shuffle files are gone."""
    import os

    from pyspark.sql import functions as F

    from eventlens.sources.lineage import cut_wide

    sizes = lambda root, name: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if name in f)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    before, shuffled = sizes(folder, ""), sizes(local, "shuffle_")
    df = spark.range(20_000).select("id", F.repeat(F.lit("wide "), 200).alias("text")).repartition(3, "id")
    out = cut_wide(df)
    assert out.dtypes == df.dtypes and out.count() == 20_000 and cut_wide(df.where("id < 0")).dtypes == df.dtypes
    assert sizes(folder, "") - before < 2_000_000 and sizes(local, "shuffle_") - shuffled < 100_000
