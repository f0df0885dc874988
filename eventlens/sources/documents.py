"""Raw documents: scans, admission, JSON and XML envelopes, and static dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.schemas import RAW_DOCUMENT, SOURCES
from eventlens.sources.lineage import once

#: Size caps in bytes (fixed values): general, and of single sources.
MAX_BYTES = 10 << 20
SOURCE_MAX_BYTES = {"imgw_hydro": 5 << 20, "cert_pl": 512 << 10}


def read_raw_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(RAW_DOCUMENT).format(fmt).load(path)


def read_binary_documents(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Files of feed bodies as raw documents; the modification time is the fetch clock."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.lit(source_id).alias("source_id"), F.col("path").alias("url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("content_type"), F.col("modificationTime").alias("fetched_at"), F.lit(False).alias("not_modified"), F.decode("content", "utf-8").alias("body"))


def admit_documents(raw: DataFrame, limits: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(admitted, failed with `reason`): a failed document is not an empty feed."""
    cap = F.lit(MAX_BYTES)
    for source, n in (SOURCE_MAX_BYTES | (limits or {})).items():
        cap = F.when(F.col("source_id") == source, n).otherwise(cap)
    size = F.octet_length(F.coalesce("body", F.lit("")))
    status = F.col("status").between(200, 299) | (F.coalesce("not_modified", F.lit(False)) & (size > 0))
    reason = F.when(~F.coalesce(status, F.lit(False)), "status").when(F.trim(F.coalesce("body", F.lit(""))) == "", "empty_body").when(size > cap, "too_large")
    out = raw.withColumn("reason", reason)
    return out.where("reason is null").drop("reason"), out.where("reason is not null")


def decode_json_feed(docs: DataFrame, source: str, element: str, path: str | None, envelope: str = "") -> tuple[DataFrame, DataFrame]:
    """(records, failed documents). A record is a row with `rec` (element schema), `index`, `raw` and the envelope's fields in `env`.

    path: the field of an object root that holds the array, `a.b` for a nested one; None where the root is an array.
    NaN and infinities, a wrong root and a missing array fail the whole document.
    """
    options = {"allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}
    docs = docs.where(F.col("source_id") == source)
    body = F.ltrim(F.col("body"))
    valid = F.try_parse_json("body").isNotNull() & ~body.rlike(r'[:\[,]\s*-?(NaN|Infinity)\b')
    if path is None:
        rows, env = F.from_json("body", f"array<{element}>", options), F.lit(None)
        ok = valid & body.startswith("[")
    else:
        schema = f"array<{element}>"
        for name in reversed(path.split(".")):
            schema = f"struct<{name}:{schema}{',' + envelope if envelope and name == path.split('.')[0] else ''}>"
        env = F.from_json("body", schema, options)
        rows = env
        for name in path.split("."):
            rows = rows[name]
        ok = valid & body.startswith("{")
    base = once(docs.select("source_id", "url", "fetched_at", env.alias("env"), rows.alias("rows"), F.coalesce(ok, F.lit(False)).alias("ok")))
    good = F.col("ok") & F.col("rows").isNotNull()
    failed = base.where(~good).select("source_id", "url", F.lit("bad_envelope").alias("reason"))
    out = base.where(good).select("source_id", "url", "fetched_at", "env", F.posexplode("rows").alias("index", "rec"))
    return out.withColumn("raw", F.to_json("rec")), failed


def decode_xml_feed(docs: DataFrame, source: str, root: str, schema: str, options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with `xml`, failed ones): no document type or entity declarations, the right root tag, well formed."""
    docs = docs.where(F.col("source_id") == source)
    declared = F.col("body").rlike(r"(?i)<!\s*(DOCTYPE|ENTITY)")
    tag = F.regexp_extract(F.regexp_replace("body", r"(?s)<\?.*?\?>|<!--.*?-->", ""), r"^\s*<([A-Za-z0-9_:.-]+)", 1)
    parsed = F.from_xml("body", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE", **(options or {})})
    out = once(docs, {"reason": F.when(declared, "declares_entities").when(~F.regexp_replace(tag, "^.*:", "").eqNullSafe(root), "root_tag")})
    out = once(out, {"xml": F.when(F.col("reason").isNull(), parsed)})
    out = out.withColumn("reason", F.coalesce("reason", F.when(F.col("xml").isNull() | F.col("xml._corrupt_record").isNotNull(), "malformed")))
    return out.where("reason is null").drop("reason"), out.where("reason is not null").select("source_id", "url", "reason")


def sources_df(spark: SparkSession) -> DataFrame:
    """The static registry."""
    return spark.createDataFrame(SOURCES, "source_id string, name string, category string, poll_seconds int, needs_key boolean, priority int")


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """iso2, name, rings of a GeoJSON file: the first feature of each two-letter code."""
    features = spark.read.option("multiLine", True).schema("features array<struct<properties:struct<ISO_A2:string,ISO_A2_EH:string,NAME:string,NAME_EN:string>,geometry:struct<type:string,coordinates:string>>>").json(path)
    return countries_from_features(features.select(F.posexplode("features").alias("pos", "f")))


def _code(name: str) -> Column:
    c = F.upper(F.col(f"f.properties.{name}"))
    return F.when(c.rlike("^[A-Z]{2}$"), c)


def countries_from_features(features: DataFrame) -> DataFrame:
    from eventlens.functions.geo import parse_geojson

    geo = F.concat(F.lit('{"type":"'), F.col("f.geometry.type"), F.lit('","coordinates":'), F.col("f.geometry.coordinates"), F.lit("}"))
    rows = features.select("pos", F.coalesce(_code("ISO_A2_EH"), _code("ISO_A2")).alias("iso2"), F.coalesce("f.properties.NAME_EN", "f.properties.NAME").alias("name"), parse_geojson(geo).alias("geometry"))
    first = rows.where("iso2 is not null").groupBy("iso2").agg(F.min_by(F.struct("name", "geometry"), "pos").alias("x"))
    return first.select("iso2", "x.name", "x.geometry", F.col("x.geometry.rings").alias("rings"))


def country_geometries(features: DataFrame, iso2: str) -> DataFrame:
    """Boundaries for viewing: ISO_A2 first, polygons only."""
    rows = features.withColumn("iso2", F.coalesce(_code("ISO_A2"), _code("ISO_A2_EH")))
    return rows.where((F.col("iso2") == iso2) & F.col("f.geometry.type").isin("Polygon", "MultiPolygon"))


def country_table(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """iso2, iso3, name: a small dimension for country_codes()."""
    return spark.createDataFrame(rows, "iso2 string, iso3 string, name string")


def country_codes(df: DataFrame, column: str, table: DataFrame, out: str = "countries") -> DataFrame:
    """A text or array of ISO2, ISO3 or English names as sorted distinct ISO2 codes; the dimension is broadcast."""
    names = table.select("iso2", F.explode(F.array(F.upper("iso2"), F.upper("iso3"), F.upper("name"))).alias("k")).where("k is not null")
    lookup = F.broadcast(names.agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("k", "iso2")))).alias("__codes")))
    parts = F.col(column) if dict(df.dtypes)[column].startswith("array") else F.split(F.coalesce(F.col(column), F.lit("")), r"\s*[,;]\s*")
    return df.crossJoin(lookup).withColumn(out, F.array_sort(F.array_distinct(F.array_compact(F.transform(parts, lambda x: F.try_element_at("__codes", F.upper(F.trim(x)))))))).drop("__codes")
