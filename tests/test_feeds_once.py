"""Documents are parsed once for each table that comes of them, and dealt to all tasks."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventlens.feed_queries import documents
from eventlens.sources import feeds
from eventlens.sources.lineage import once


def plan(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("source, body, parse, read", [
    ("gdacs", "<rss/>", "from_xml(", feeds.normalize_gdacs),
    ("cert_pl", "<rss/>", "from_xml(", feeds.normalize_cert),
    ("meteoalarm", "<alert/>", "from_xml(", lambda d: feeds.normalize_cap(d, "DE")),
    ("noaa_swpc", "[]", "from_json(", feeds.normalize_swpc),
    ("noaa_swpc", "[]", "from_json(", lambda d: (feeds.resolve_swpc_refs(feeds.normalize_swpc(d)[0]), d)),
])
def test_a_document_is_parsed_once_a_table(spark, source, body, parse, read):
    rows = spark.range(20).select(F.col("id").alias("n"))
    events, _ = read(documents(rows, source, F.concat(F.lit(body), F.substring(F.col("n").cast("string"), 1, 0))))
    text = plan(events)
    assert text.count(parse) + text.count(parse.replace("from_xml(", "xmltostructs(").replace("from_json(", "jsontostructs(")) <= 1
    assert text.count("Window") + text.count("Join") < 4


def test_once_keeps_names_and_values(spark):
    df = once(spark.createDataFrame([(1, None), (2, "x")], "a int, `at:b c` string"), {"d": F.col("a") + 1})
    assert df.columns == ["a", "at:b c", "d"] and sorted(map(tuple, df.collect())) == [(1, None, 2), (2, "x", 3)]


def test_documents_of_a_small_file_are_dealt_to_all_tasks(spark, tmp_path):
    spark.range(4000).select(F.col("id").alias("n")).coalesce(1).write.parquet(f"{tmp_path}/t")
    docs = documents(spark.read.parquet(f"{tmp_path}/t"), "gdacs", F.col("n").cast("string"))
    assert docs.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_repeats_collapse_and_keys_with_two_payloads_go(spark):
    rows = [("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), (None, "3"), ("c", None), ("d", "4")]
    one, other = feeds.dedupe_feed(spark.createDataFrame(rows, "key string, raw_hash string"), "key")
    assert sorted(map(tuple, one.collect())) == [("a", "1"), ("d", "4")] and sorted(map(tuple, other.collect())) == [("b", "1"), ("b", "2")]


def test_bulletins_with_and_without_an_original_time_find_their_keys(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [("c:1:20240101T0100Z", "c", "1", at(1), []), ("c:2:20240101T0200Z", "c", "2", at(2), [("1", None)]), ("c:3:20240101T0300Z", "c", "3", at(3), [("9", None)]), ("c:4:20240101T0400Z", "c", "4", at(4), [("7", at(0)), ("1", None)])]
    df = spark.createDataFrame(rows, "provider_record_id string, code string, serial string, minute timestamp, refs array<struct<serial:string,minute:timestamp>>").withColumns({"external_ids": F.array(F.concat(F.lit("swpc:"), "provider_record_id")), "tags": F.array(F.lit("t"))})
    out = {r.serial: (r.external_ids, r.tags) for r in feeds.resolve_swpc_refs(df).collect()}
    assert out["1"] == (["swpc:c:1:20240101T0100Z"], ["t"]) and out["2"][0] == ["swpc:c:1:20240101T0100Z", "swpc:c:2:20240101T0200Z"]
    assert out["3"] == (["swpc:c:3:20240101T0300Z"], ["t", "unresolved_source_reference"])
    assert out["4"] == (["swpc:c:1:20240101T0100Z", "swpc:c:4:20240101T0400Z", "swpc:c:7:20240101T0000Z"], ["t"])
