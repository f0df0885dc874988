"""Streams against their batch twins."""

from datetime import datetime, timedelta

import pytest

from eventlens.streaming import jobs

T0 = datetime(2024, 5, 1)


@pytest.fixture
def stream(spark, tmp_path):
    def run(batches, schema, build, mode="append"):
        src = tmp_path / "in"
        src.mkdir(exist_ok=True)
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{src}/b{i}")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
        got = []
        q = build(df).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return got

    return run


def test_counts_equal_batch(spark, stream):
    rows = [(f"k{i % 3}", T0 + timedelta(minutes=7 * i)) for i in range(200)]
    end = [("k0", T0 + timedelta(days=9))]
    got = stream([rows[:100], rows[100:], end], "k string, ts timestamp", lambda d: jobs.count_stream(d, "ts", "1 hour", keys=("k",)))
    want = [tuple(r) for r in jobs.count_stream(spark.createDataFrame(rows, "k string, ts timestamp"), "ts", "1 hour", keys=("k",)).collect()]
    assert sorted(got) == sorted(want)


def test_latest_state_keeps_late_versions_as_evidence(stream):
    batches = [[("a", T0 + timedelta(hours=2), "p2")], [("a", T0, "p0"), ("b", T0, "q")], [("a", T0 + timedelta(hours=3), "p3")]]
    got = {(k, p): up for k, _, p, up in stream(batches, "key string, clock timestamp, payload string", jobs.latest_state_stream)}
    assert got == {("a", "p2"): True, ("a", "p0"): False, ("b", "q"): True, ("a", "p3"): True}


def test_high_water(stream):
    batches = [[("s", 1, T0 + timedelta(hours=1), "x")], [("s", 2, T0, "y"), ("s", 3, T0 + timedelta(hours=1), "x"), ("s", 4, T0 + timedelta(hours=1), "z"), ("s", 5, T0 + timedelta(hours=2), "w")]]
    got = {r[1]: r[4] for r in stream(batches, "key string, seq long, clock timestamp, payload string", jobs.highwater_stream)}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_expiry_needs_no_input(stream):
    batches = [[("a", T0, T0 + timedelta(hours=1))], [("b", T0 + timedelta(hours=5), T0 + timedelta(hours=9))], [("b", T0 + timedelta(hours=6), T0 + timedelta(hours=9))]]
    got = [(k, s) for k, s, _ in stream(batches, "key string, clock timestamp, valid_to timestamp", jobs.expiry_stream)]
    assert got.count(("a", "active")) == 1 and got.count(("a", "expired")) == 1 and ("b", "expired") not in got


def test_ingest_stream_is_idempotent(spark, tmp_path):
    from eventlens.schemas import RAW_DOCUMENT

    src, out = tmp_path / "raw", f"{tmp_path}/table"
    row = ("usgs", "u", 200, "x", T0, False, "{}")
    for i in range(2):
        spark.createDataFrame([row], RAW_DOCUMENT).coalesce(1).write.mode("append").parquet(f"{src}")
        del i
    schema = "source_id string, provider_record_id string, payload_hash string"

    def persist(batch, batch_id):
        rows = batch.selectExpr("source_id", "url AS provider_record_id", "md5(body) AS payload_hash")
        try:
            old = spark.read.schema(schema).parquet(out)
        except Exception:
            old = spark.createDataFrame([], schema)
        jobs.new_rows(rows, old).write.mode("append").parquet(out)

    q = jobs.start_ingest_stream(jobs.stream_raw_documents(spark, str(src), 1), str(tmp_path / "cp"), persist)
    q.awaitTermination(60)
    assert spark.read.parquet(out).count() == 1


def test_pairs_over_the_dateline_and_near_the_poles(stream):
    at = [("a", T0, 179.99, 10.0), ("b", T0 + timedelta(minutes=5), -179.99, 10.0), ("c", T0, 20.0, 85.0), ("d", T0, 22.1, 85.0), ("e", T0, 20.0, -89.95), ("f", T0, -160.0, -89.95), ("g", T0 + timedelta(hours=2), 20.0, 85.0)]
    got = stream([at], "id string, clock timestamp, lon double, lat double", lambda d: jobs.relate_stream(d, d.select("*"), 600, 25.0))
    assert {(a, b) for a, b, *_ in got} == {("a", "b"), ("c", "d"), ("e", "f")} and len(got) == 3
