"""Registered queries over the driver's tables, each with its DuckDB equivalent.

No monitoring data exists in those tables, so events, advisories, evidence, keys, points and snapshots are derived
from them inside each query, in the same way in both languages.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions import arrays, geo, severity, text, time
from eventlens.operators import aggregates as A
from eventlens.operators import filters as X
from eventlens.operators import geo_joins as J
from eventlens.operators import identity as I
from eventlens.operators import ordering as L
from eventlens.plans import pipelines as P
from eventlens.schemas import CATEGORIES, DEFAULT_BASIS, EUROPE, KINDS, SEVERITY_LABELS, SOURCES, EventQuery
from eventlens.sources import sinks
from eventlens.streaming import jobs

NOW = datetime(2024, 1, 31)
CODES = "PL DE FR ES IT GB UA RU TR US BR JP CN IN AU CA MX ZA NO SE FI CZ SK HU RO".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


EV_SQL = f"""ev AS (SELECT 'e' || event_id AS id, event_id AS n, event_type AS source_id, user_id::VARCHAR AS provider_record_id, ts,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 7 = 0 THEN date_trunc('day', ts) ELSE ts END AS occurred_start,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN date_trunc('day', ts) ELSE ts END AS issued_at,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS valid_from, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN NULL ELSE ts + to_hours((event_id % 50 - 2)::INT) END AS valid_to,
  ts + to_minutes((event_id % 72)::INT) AS last_changed_at, {_list(CATEGORIES)}[1 + event_id % 7] AS category, {_list(KINDS)}[1 + event_id % 4] AS kind, (event_id % 5)::INT AS severity,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'level ' || (event_id % 5) END AS original_severity, CASE event_id % 10 WHEN 0 THEN 'expired' WHEN 1 THEN 'withdrawn' WHEN 2 THEN 'unknown' ELSE 'active' END AS lifecycle_status,
  CASE WHEN event_id % 9 = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct([{_list(CODES)}[1 + user_id % 25], {_list(CODES)}[1 + (user_id + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) % 25]])) END AS countries,
  list_sort(list_filter([CASE WHEN event_id % 17 = 0 THEN 'cached_public_data' END, CASE WHEN event_id % 7 = 0 THEN 'date_only_utc_anchor' END, CASE WHEN event_id % 8 = 0 THEN 'until_revoked' END], lambda x: x IS NOT NULL)) AS tags,
  CASE WHEN event_id % 7 = 0 THEN 'day' ELSE 'second' END AS time_precision, ['initial_import', 'new', 'updated', 'withdrawn'][1 + event_id % 4] AS change_type, (1 + event_id % 3)::INT AS independent_source_count,
  CASE WHEN event_id % 4 = 0 THEN [event_type, 'mirror'] ELSE [event_type] END AS source_ids, 'Event ' || (event_id % 50) AS title,
  CASE WHEN event_id % 10 = 3 THEN 'http://10.0.0.1/x' WHEN event_id % 10 = 4 THEN NULL ELSE 'https://x.example.org/' || event_id END AS source_url,
  CASE WHEN event_id % 2 = 0 THEN 'point' ELSE 'country' END AS location_precision, (user_id * 37 % 360) - 180 + 0.5::DOUBLE AS lon, (user_id * 17 % 160) - 80 + 0.25::DOUBLE AS lat, value, props FROM events)"""


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events derived from the driver's `events`."""
    n, u = F.col("event_id"), F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (1 + i).cast("int"))
    mod = lambda k, r=0: n % k == r
    day = F.date_trunc("day", ts)
    code = lambda i: pick(CODES, i % 25)
    lon, lat = (u * 37 % 360 - 180 + 0.5).cast("double"), (u * 17 % 160 - 80 + 0.25).cast("double")
    no_rings = F.array().cast("array<array<struct<lon:double,lat:double>>>")
    point = F.struct(F.lit("Point").alias("type"), F.array(F.struct(lon.alias("lon"), lat.alias("lat"))).alias("points"), no_rings.alias("rings"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("e"), n.cast("string")).alias("id"), n.alias("n"), F.col("event_type").alias("source_id"), u.cast("string").alias("provider_record_id"), ts.alias("ts"),
        F.when(mod(13), None).when(mod(7), day).otherwise(ts).alias("occurred_start"), F.when(mod(11), None).when(mod(7), day).otherwise(ts).alias("issued_at"), F.when(~mod(3), ts).alias("valid_from"),
        F.when(~(mod(3) | mod(5)), ts + F.make_interval(hours=(n % 50 - 2).cast("int"))).alias("valid_to"), (ts + F.make_interval(mins=(n % 72).cast("int"))).alias("last_changed_at"),
        pick(CATEGORIES, n % 7).alias("category"), pick(KINDS, n % 4).alias("kind"), (n % 5).cast("int").alias("severity"), F.when(~mod(6), F.concat(F.lit("level "), (n % 5).cast("string"))).alias("original_severity"),
        F.when(mod(10), "expired").when(mod(10, 1), "withdrawn").when(mod(10, 2), "unknown").otherwise("active").alias("lifecycle_status"),
        F.when(mod(9), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.array(code(u), code(u + F.when(mod(4), 1).otherwise(0)))))).alias("countries"),
        F.array_sort(F.array_compact(F.array(F.when(mod(17), "cached_public_data"), F.when(mod(7), "date_only_utc_anchor"), F.when(mod(8), "until_revoked")))).alias("tags"),
        F.when(mod(7), "day").otherwise("second").alias("time_precision"), pick(("initial_import", "new", "updated", "withdrawn"), n % 4).alias("change_type"), (1 + n % 3).cast("int").alias("independent_source_count"),
        F.when(mod(4), F.array(F.col("event_type"), F.lit("mirror"))).otherwise(F.array("event_type")).alias("source_ids"), F.concat(F.lit("Event "), (n % 50).cast("string")).alias("title"),
        F.when(mod(10, 3), "http://10.0.0.1/x").when(mod(10, 4), None).otherwise(F.concat(F.lit("https://x.example.org/"), n.cast("string"))).alias("source_url"),
        F.when(mod(2), "point").otherwise("country").alias("location_precision"), lon.alias("lon"), lat.alias("lat"), F.when(mod(2), point).alias("geometry"), "value", "props",
    )


def query(sql: str | None = None, uses_ev: bool = True):
    """Register a function under its name; `sql` is the body after the shared CTE."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"WITH {EV_SQL}" + (", " if sql.lstrip().lower().startswith("with ") else " ") + (sql.lstrip()[5:] if sql.lstrip().lower().startswith("with ") else sql)) if uses_ev else sql
        return f

    return add


def _sql_active(now: str = "TIMESTAMP '2024-01-31'") -> str:
    return f"lifecycle_status NOT IN ('expired', 'withdrawn') AND (valid_to IS NULL OR valid_to > {now})"


S, U = "TIMESTAMP '2024-01-24'", "TIMESTAMP '2024-01-31'"
SINCE, UNTIL = datetime(2024, 1, 24), datetime(2024, 1, 31)
_EUROPE = _list(EUROPE)


# --- flagship, filters -------------------------------------------------------------------------------------------


@query(f"""WITH f AS (SELECT * FROM ev WHERE occurred_start >= {S} AND occurred_start < {U} AND severity >= 1 AND list_has_any(countries, {_EUROPE}) AND {_sql_active()})
SELECT id, severity, epoch(date_trunc('second', occurred_start))::BIGINT AS clock, category, (SELECT count(*) FROM f) AS total, least((SELECT count(*) FROM f), 300) AS shown, (SELECT count(*) FROM f) > 300 AS truncated FROM f ORDER BY severity DESC, occurred_start DESC, id LIMIT 300""")
def p01_select_events(spark, sf_dir):
    """Events of the last 168 h, active, severity 1 and up, Europe by country, ordered, with totals."""
    q = EventQuery(window_hours=168, time_basis="occurred", severity_min=1, region="europe")
    out = P.select_events(ev(spark, sf_dir).drop("geometry"), q, NOW)
    return out.select("id", "severity", F.unix_timestamp("occurred_start").alias("clock"), "category", "total", "shown", "truncated")


@query(f"""SELECT 'changed' AS basis, count(*) AS n, sum(n)::BIGINT AS ids FROM ev WHERE last_changed_at >= {S} AND last_changed_at < {U}
UNION ALL SELECT 'occurred', count(*), sum(n)::BIGINT FROM ev WHERE occurred_start >= {S} AND occurred_start < {U}
UNION ALL SELECT 'published', count(*), sum(n)::BIGINT FROM ev WHERE CASE WHEN n % 7 = 0 THEN date_trunc('day', issued_at) < {U} AND date_trunc('day', issued_at) + INTERVAL 1 DAY > {S} ELSE issued_at >= {S} AND issued_at < {U} END
UNION ALL SELECT 'validity', count(*), sum(n)::BIGINT FROM ev WHERE valid_from < {U} AND (valid_to IS NULL OR (valid_to > {S} AND valid_to > valid_from))""")
def f01_f04_time_bases(spark, sf_dir):
    """Half-open windows on four bases; unknown clocks never match."""
    e, out = ev(spark, sf_dir), None
    for basis in ("changed", "occurred", "published", "validity"):
        one = X.filter_time(e, basis, SINCE, UNTIL).agg(F.lit(basis).alias("basis"), F.count("*").alias("n"), F.sum("n").alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT category, count(*) AS n, sum(n)::BIGINT AS ids FROM ev WHERE {_sql_active()} AND severity >= 2 AND independent_source_count >= 2 AND list_contains(countries, 'PL') GROUP BY category")
def f05_f07_active_attributes_country(spark, sf_dir):
    e = X.filter_country(X.filter_attrs(X.filter_active(ev(spark, sf_dir), NOW), EventQuery(severity_min=2, min_sources=2)), "pl")
    return e.groupBy("category").agg(F.count("*").alias("n"), F.sum("n").alias("ids"))


@query(f"""SELECT id FROM ev WHERE list_has_any(countries, {_EUROPE}) OR (list_has_any(countries, ['RU', 'TR']) AND location_precision = 'point' AND lon BETWEEN -25 AND 45 AND lat BETWEEN 34 AND 72)""")
def f08_europe(spark, sf_dir):
    return X.filter_europe(ev(spark, sf_dir)).select("id")


@query("SELECT id FROM ev WHERE location_precision = 'point' AND 2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat - 52.25) / 2), 2) + cos(radians(52.25)) * cos(radians(lat)) * pow(sin(radians(lon - 21.5) / 2), 2))) <= 2500")
def f09_radius(spark, sf_dir):
    """Points within 2500 km of a place on the ellipsoid; no point of the grid lies within a percent of the border."""
    return X.filter_radius(ev(spark, sf_dir), 52.25, 21.5, 2500).select("id")


_BACKGROUND = f"""(change_type = 'initial_import' AND NOT (coalesce(issued_at >= {S} AND issued_at < {U}, false) OR coalesce(n % 7 = 0 AND date_trunc('day', issued_at) < {U} AND date_trunc('day', issued_at) + INTERVAL 1 DAY > {S}, false)
  OR coalesce(kind IN ('incident', 'measurement') AND occurred_start >= {S} AND occurred_start < {U}, false) OR coalesce(kind IN ('incident', 'measurement') AND n % 7 = 0 AND date_trunc('day', occurred_start) < {U} AND date_trunc('day', occurred_start) + INTERVAL 1 DAY > {S}, false)))"""


@query(f"SELECT {_BACKGROUND} AS background, count(*) AS n, sum(n)::BIGINT AS ids FROM ev GROUP BY 1")
def f10_background(spark, sf_dir):
    return ev(spark, sf_dir).groupBy(X.is_background(SINCE, UNTIL).alias("background")).agg(F.count("*").alias("n"), F.sum("n").alias("ids"))


_PUB = f"CASE WHEN coalesce(CASE WHEN n % 7 = 0 THEN date_trunc('day', issued_at) < {U} AND date_trunc('day', issued_at) + INTERVAL 1 DAY > {S} ELSE issued_at >= {S} AND issued_at < {U} END, false) THEN 'published_in_window' END"
_OCC = f"CASE WHEN coalesce(kind IN ('incident', 'measurement') AND CASE WHEN n % 7 = 0 THEN date_trunc('day', occurred_start) < {U} AND date_trunc('day', occurred_start) + INTERVAL 1 DAY > {S} ELSE occurred_start >= {S} AND occurred_start < {U} END, false) THEN 'occurred_in_window' END"
_GROUP = f"CASE change_type WHEN 'initial_import' THEN coalesce({_PUB}, {_OCC}, 'historical') WHEN 'withdrawn' THEN 'withdrawn' WHEN 'updated' THEN 'updated' WHEN 'new' THEN 'new' ELSE 'other' END"


@query(f"SELECT {_GROUP} AS briefing_group, count(*) AS n, sum(n)::BIGINT AS ids FROM ev GROUP BY 1")
def f11_f12_briefing_groups(spark, sf_dir):
    return X.assign_group(ev(spark, sf_dir), False, SINCE, UNTIL).groupBy("briefing_group").agg(F.count("*").alias("n"), F.sum("n").alias("ids"))


_BASIS = "CASE " + " ".join(f"WHEN category = '{c}' THEN '{b}'" for c, b in DEFAULT_BASIS.items()) + " END"
_SPAN = f"""b AS (SELECT *, {_BASIS} AS basis FROM ev), sp AS (SELECT *, CASE basis WHEN 'occurred' THEN occurred_start WHEN 'published' THEN issued_at ELSE valid_from END AS clock FROM b),
span AS (SELECT *, clock IS NOT NULL AND NOT (basis = 'validity' AND valid_to IS NOT NULL AND valid_to <= valid_from) AS dated,
  CASE WHEN basis = 'validity' THEN valid_from WHEN n % 7 = 0 THEN date_trunc('day', clock) ELSE clock END AS s,
  CASE WHEN basis = 'validity' THEN CASE WHEN valid_to IS NOT NULL THEN valid_to WHEN lifecycle_status = 'active' THEN NULL ELSE valid_from END WHEN n % 7 = 0 THEN date_trunc('day', clock) + INTERVAL 1 DAY ELSE clock END AS e,
  CASE WHEN basis = 'validity' THEN valid_to IS NULL AND lifecycle_status <> 'active' ELSE n % 7 <> 0 END AS point, basis = 'validity' AND valid_to IS NULL AND lifecycle_status = 'active' AS open FROM sp)"""
_INSIDE = f"dated AND CASE WHEN point THEN s >= {S} AND s < {U} ELSE s < {U} AND (open OR e > {S}) END"


def _spans(spark, sf_dir):
    return X.default_basis(ev(spark, sf_dir)).withColumn("span", X.event_span())


@query(f"WITH {_SPAN} SELECT basis, count(*) FILTER (WHERE {_INSIDE}) AS inside, count(*) FILTER (WHERE NOT dated) AS undated, count(*) FILTER (WHERE dated AND point) AS points, count(*) FILTER (WHERE dated AND open) AS open_ends FROM span GROUP BY basis")
def f13_f16_spans(spark, sf_dir):
    s = F.col("span")
    inside = F.coalesce(X.span_intersects("span", SINCE, UNTIL), F.lit(False))
    return _spans(spark, sf_dir).groupBy("basis").agg(F.count_if(inside).alias("inside"), F.count_if(s.isNull()).alias("undated"), F.count_if(s["point"]).alias("points"), F.count_if(s["open"]).alias("open_ends"))


@query(f"""WITH sc AS (SELECT 'world' AS scope, n, countries FROM ev UNION ALL SELECT 'europe', n, countries FROM ev WHERE list_has_any(countries, {_EUROPE}) UNION ALL SELECT 'country:PL', n, countries FROM ev WHERE list_contains(countries, 'PL'))
SELECT scope, count(*) AS n, sum(n)::BIGINT AS ids FROM sc GROUP BY scope""")
def f15_scopes(spark, sf_dir):
    e, out = ev(spark, sf_dir), None
    for scope in ("world", "europe", "country:PL"):
        one = X.filter_scope(e, scope).agg(F.lit(scope).alias("scope"), F.count("*").alias("n"), F.sum("n").alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT id FROM ev WHERE category = 'weather' AND valid_from < {U} AND (valid_to IS NULL OR (valid_to > TIMESTAMP '2024-01-30' AND valid_to > valid_from)) AND list_contains(source_ids, 'mirror') AND severity >= 1")
def f17_snapshot_filter(spark, sf_dir):
    q = EventQuery(window_hours=24, time_basis="validity", category="weather", severity_min=1)
    return X.filter_snapshot(ev(spark, sf_dir), q, NOW, "mirror").select("id")


@query("SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'anel') AND contains(lower(strip_accents(text)), 'etre')", uses_ev=False)
def f18_search(spark, sf_dir):
    """Folded words over whole texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("title"))
    return X.search_events(docs, "ÂNEL être").select("doc_id")


@query("SELECT id FROM ev WHERE n % 20 = 0 AND category = 'earthquake' AND list_contains(source_ids, 'mirror')")
def f19_view(spark, sf_dir):
    e = ev(spark, sf_dir)
    return X.filter_view(e, e.where("n % 20 = 0").select("id"), "earthquake", "mirror").select("id")


_STATE = "CASE WHEN lifecycle_status = 'withdrawn' THEN 'withdrawn' WHEN valid_to <= valid_from THEN 'unknown' WHEN lifecycle_status = 'expired' OR valid_to <= {at} THEN 'expired' WHEN valid_from IS NULL THEN 'unknown' WHEN valid_from > {at} THEN 'upcoming' WHEN valid_to IS NOT NULL OR lifecycle_status = 'active' THEN 'active' ELSE 'unknown' END"
_MID = "TIMESTAMP '2024-01-15'"
MID = datetime(2024, 1, 15)


@query(f"SELECT {_STATE.format(at=_MID)} AS state, count(*) AS n, sum(n)::BIGINT AS ids FROM ev GROUP BY 1")
def f21_advisory_state(spark, sf_dir):
    return ev(spark, sf_dir).groupBy(X.advisory_state(MID).alias("state")).agg(F.count("*").alias("n"), F.sum("n").alias("ids"))


@query(f"""WITH {_SPAN} SELECT basis <> 'validity' OR coalesce(issued_at >= {S} AND issued_at < {U}, false) OR coalesce(valid_from >= {S} AND valid_from < {U}, false) AS fresh, coalesce(severity >= 3 AND trim(original_severity) <> '', false) AS high, count(*) AS n FROM span GROUP BY 1, 2""")
def f22_flags(spark, sf_dir):
    return _spans(spark, sf_dir).groupBy(X.is_fresh(SINCE, UNTIL).alias("fresh"), X.high_severity().alias("high")).agg(F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT *, ['meteoalarm', 'noaa_swpc', 'other'][1 + n % 3] AS src FROM ev)
SELECT src AS source_id, CASE WHEN lifecycle_status IN ('withdrawn', 'expired') THEN lifecycle_status
  WHEN src = 'meteoalarm' THEN CASE WHEN valid_to <= {_MID} THEN 'expired' WHEN valid_from <= {_MID} AND valid_to IS NOT NULL THEN 'active' ELSE 'unknown' END
  WHEN src = 'noaa_swpc' AND kind = 'advisory' THEN CASE WHEN valid_to <= {_MID} THEN 'expired' WHEN valid_from <= {_MID} AND valid_to > {_MID} THEN 'active' ELSE 'unknown' END
  WHEN valid_to <= {_MID} THEN 'expired' ELSE lifecycle_status END AS state, count(*) AS n, count(*) FILTER (WHERE src = 'meteoalarm' AND lifecycle_status NOT IN ('withdrawn', 'expired') AND coalesce(valid_from > {_MID}, false)) AS waiting FROM x GROUP BY 1, 2""")
def f23_effective_state(spark, sf_dir):
    e = ev(spark, sf_dir).withColumn("source_id", F.element_at(F.array(F.lit("meteoalarm"), F.lit("noaa_swpc"), F.lit("other")), (1 + F.col("n") % 3).cast("int")))
    return X.effective_state(e, MID).groupBy("source_id", F.col("lifecycle_status").alias("state")).agg(F.count("*").alias("n"), F.count_if(arrays.has_tag("tags", "hazard_onset_in_future")).alias("waiting"))


@query("""WITH v AS (SELECT *, CASE WHEN issued_at > TIMESTAMP '2024-01-20' + INTERVAL 1 DAY THEN 'future_source_clock' END AS a, CASE WHEN category = 'earthquake' AND occurred_start > TIMESTAMP '2024-01-20' + INTERVAL 1 HOUR THEN 'future_quake' END AS b FROM ev)
SELECT concat_ws(',', a, b) AS reasons, count(*) AS n, sum(n)::BIGINT AS ids FROM v GROUP BY 1""")
def f25_quarantine(spark, sf_dir):
    e = ev(spark, sf_dir).withColumn("source_updated_at", F.lit(None).cast("timestamp"))
    good, bad = X.validate_batch(e, datetime(2024, 1, 20))
    rows = good.select(F.lit("").alias("reasons"), "n").unionByName(bad.select(F.array_join("reasons", ",").alias("reasons"), "n"))
    return rows.groupBy("reasons").agg(F.count("*").alias("n"), F.sum("n").alias("ids"))


@query("SELECT severity, CASE severity " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in SEVERITY_LABELS.items()) + " END AS severity_label, len(source_ids)::INT AS source_count, count(*) AS n FROM ev GROUP BY ALL")
def f27_summaries(spark, sf_dir):
    return X.summarize(ev(spark, sf_dir), NOW).groupBy("severity", "severity_label", "source_count").agg(F.count("*").alias("n"))


@query(f"""WITH q AS (SELECT * FROM (VALUES ('a', 'occurred', 24, NULL, 0), ('b', 'published', 168, 'cyber', 2), ('c', 'changed', 72, NULL, 3)) AS t(query_id, basis, hours, cat, sev)), o AS (SELECT unnest([0, 24, 100]) AS off)
SELECT query_id, off AS offset_hours, count(ev.id) AS n FROM q CROSS JOIN o LEFT JOIN ev ON severity >= sev AND (cat IS NULL OR cat = category) AND CASE basis
  WHEN 'occurred' THEN occurred_start >= {U} - to_hours(off + hours) AND occurred_start < {U} - to_hours(off) AND {_sql_active()}
  WHEN 'changed' THEN last_changed_at >= {U} - to_hours(off + hours) AND last_changed_at < {U} - to_hours(off)
  ELSE CASE WHEN n % 7 = 0 THEN date_trunc('day', issued_at) < {U} - to_hours(off) AND date_trunc('day', issued_at) + INTERVAL 1 DAY > {U} - to_hours(off + hours) ELSE issued_at >= {U} - to_hours(off + hours) AND issued_at < {U} - to_hours(off) END END
GROUP BY 1, 2 HAVING count(ev.id) > 0""")
def f30_f32_many_queries(spark, sf_dir):
    """A table of queries at several offsets against one pass of the events."""
    rows = [("a", "occurred", 24, None, 0), ("b", "published", 168, "cyber", 2), ("c", "changed", 72, None, 3)]
    q = spark.createDataFrame(rows, "query_id string, time_basis string, window_hours int, category string, severity_min int")
    q = q.withColumns({"since": F.lit(None).cast("timestamp"), "until": F.lit(None).cast("timestamp"), "country": F.lit(None).cast("string"), "min_sources": F.lit(1), "include_inactive": F.lit(None).cast("boolean")})
    q = X.shift_windows(q, [0, 24, 100], NOW).withColumn("query_id", F.concat_ws("|", "query_id", F.col("offset_hours").cast("string")))
    out = X.run_queries(q, ev(spark, sf_dir), NOW).groupBy("query_id").agg(F.count("*").alias("n"))
    return out.select(F.split("query_id", r"\|")[0].alias("query_id"), F.split("query_id", r"\|")[1].cast("int").alias("offset_hours"), "n")


@query(f"""WITH {_SPAN} SELECT concat_ws(',', basis, CASE WHEN kind = 'advisory' THEN 'state:' || ({_STATE.format(at=_MID)}) END, CASE WHEN coalesce(severity >= 3 AND trim(original_severity) <> '', false) THEN 'severity:' || original_severity END,
  CASE WHEN basis = 'validity' AND valid_to IS NULL THEN 'open_end' END, CASE WHEN n % 8 = 0 THEN 'until_revoked' END) AS reason, count(*) AS n FROM span GROUP BY 1""")
def f35_highlight_reasons(spark, sf_dir):
    return _spans(spark, sf_dir).groupBy(F.array_join(X.highlight_reason(MID), ",").alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT id, CASE WHEN n % 7 = 0 THEN strftime(occurred_start, '%Y-%m-%d') ELSE strftime(occurred_start, '%Y-%m-%d %H:%M:%S UTC') END AS occurred, strftime(valid_from, '%Y-%m-%d %H:%M UTC') AS valid_from, change_type = 'initial_import' AS first_import FROM ev""")
def f36_facts(spark, sf_dir):
    return X.facts(ev(spark, sf_dir).withColumn("source_urls", F.array("source_url"))).select("id", "occurred", "valid_from", "first_import")


# --- aggregates, windows, order --------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, least(count(*), 300) AS shown, count(*) FILTER (WHERE location_precision IN ('point', 'area', 'country')) AS mapped, count(*) FILTER (WHERE location_precision NOT IN ('point', 'area', 'country')) AS unlocated, count(*) > 300 AS truncated FROM ev")
def a01_result_counts(spark, sf_dir):
    return A.result_counts(ev(spark, sf_dir), 300).withColumn("shown", F.col("shown").cast("long"))


@query("WITH c AS (SELECT unnest(" + _list(CATEGORIES) + f") AS category) SELECT c.category, {_BASIS.replace('category =', 'c.category =')} AS basis, count(ev.id) AS n FROM c LEFT JOIN ev ON ev.category = c.category AND severity = 4 AND kind = 'advisory' GROUP BY 1, 2")
def a03_category_counts(spark, sf_dir):
    return A.category_counts(ev(spark, sf_dir).where("severity = 4 AND kind = 'advisory'"))


@query("SELECT kind, count(*) AS n FROM ev GROUP BY kind")
def a04_kind_counts(spark, sf_dir):
    return A.kind_counts(ev(spark, sf_dir))


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE ({_STATE.format(at=_MID)}) = '{s}') AS {s}" for s in ("active", "upcoming", "expired", "withdrawn", "unknown")) + " FROM ev WHERE kind = 'advisory'")
def a05_advisory_counts(spark, sf_dir):
    return A.advisory_counts(ev(spark, sf_dir), MID)


@query(f"WITH {_SPAN} SELECT count(*) FILTER (WHERE NOT dated) AS unknown_time, count(*) FILTER (WHERE len(countries) = 0) AS unknown_country, count(*) FILTER (WHERE n % 17 = 0) AS cached FROM span")
def a06_unknown_counts(spark, sf_dir):
    return A.unknown_counts(_spans(spark, sf_dir))


@query(f"""WITH {_SPAN}, bins AS (SELECT i AS bin, {S} + to_hours(i * 6) AS a, {S} + to_hours(i * 6 + 6) AS b FROM (SELECT unnest(range(0, 28))::INT AS i))
SELECT bin, epoch(a)::BIGINT AS bin_start, count(*) AS n, count(*) FILTER (WHERE basis = 'occurred') AS n_occurred, count(*) FILTER (WHERE basis = 'published') AS n_published, count(*) FILTER (WHERE basis = 'validity') AS n_validity
FROM bins JOIN span ON dated AND CASE WHEN point THEN s >= a AND s < b ELSE s < b AND (open OR e > a) END GROUP BY 1, 2""")
def a07_j16_timeline(spark, sf_dir):
    """Events per 6-hour bin of a week, counted in every bin they meet."""
    out = A.timeline(_spans(spark, sf_dir), SINCE, 168, UNTIL)
    return out.select("bin", F.unix_timestamp("bin_start").alias("bin_start"), "n", "n_occurred", "n_published", "n_validity")


_SRC = "src AS (SELECT 's' || s_suppkey AS source_id, s_suppkey % 13 <> 0 AS enabled, CASE s_suppkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'ok_empty' WHEN 2 THEN 'partial' ELSE 'ok' END AS status, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-01-31' - to_seconds((s_suppkey * 600)::BIGINT) END AS last_success_at, (300 + s_suppkey % 4 * 900)::INT AS poll_seconds FROM supplier)"


def _sources(spark, sf_dir):
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("s"), k.cast("string")).alias("source_id"), (k % 13 != 0).alias("enabled"), F.when(k % 5 == 0, "error").when(k % 5 == 1, "ok_empty").when(k % 5 == 2, "partial").otherwise("ok").alias("status"),
        F.when(k % 7 != 0, F.lit(NOW).cast("timestamp") - F.make_interval(secs=(k * 600).cast("decimal(18,6)"))).alias("last_success_at"), (300 + k % 4 * 900).cast("int").alias("poll_seconds"),
    )


@query(f"WITH {_SRC} SELECT source_id, CASE WHEN enabled AND status IN ('ok', 'ok_empty') AND coalesce(epoch(TIMESTAMP '2024-01-31' - last_success_at) > 3 * poll_seconds + 120, true) THEN 'stale' ELSE status END AS status FROM src", uses_ev=False)
def a10_source_health(spark, sf_dir):
    return A.source_health(_sources(spark, sf_dir), NOW).select("source_id", "status")


@query(f"""WITH {_SRC} SELECT source_id, concat_ws(',', CASE WHEN NOT enabled THEN 'disabled' END, CASE WHEN status NOT IN ('ok', 'ok_empty') THEN 'state' END, CASE WHEN last_success_at IS NULL THEN 'no_success' END,
  CASE WHEN epoch(TIMESTAMP '2024-01-31' - last_success_at) < -300 THEN 'clock_ahead' END, CASE WHEN epoch(TIMESTAMP '2024-01-31' - last_success_at) > greatest(10800, 3 * poll_seconds) THEN 'late' END) AS reasons FROM src""", uses_ev=False)
def a11_source_warnings(spark, sf_dir):
    s = _sources(spark, sf_dir)
    return A.source_warnings(s, s, NOW).select("source_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_SRC} SELECT count(*) FILTER (WHERE enabled) AS active, count(*) FILTER (WHERE enabled AND status IN ('ok', 'ok_empty')) AS responding, CASE WHEN count(*) FILTER (WHERE enabled) = 0 THEN 'none' WHEN count(*) FILTER (WHERE enabled AND status IN ('ok', 'ok_empty')) = count(*) FILTER (WHERE enabled) THEN 'all' WHEN count(*) FILTER (WHERE enabled AND status IN ('ok', 'ok_empty')) = 0 THEN 'down' ELSE 'partial' END AS state FROM src", uses_ev=False)
def a09_source_overview(spark, sf_dir):
    return A.source_overview(_sources(spark, sf_dir))


@query(f"WITH {_SRC} SELECT source_id, status FROM src WHERE enabled AND status NOT IN ('ok', 'ok_empty')", uses_ev=False)
def f31_coverage_warnings(spark, sf_dir):
    return X.coverage_warnings(_sources(spark, sf_dir)).select("source_id", "status")


@query("""WITH r AS (SELECT source_id, count(*) AS records, count(*) FILTER (WHERE n % 17 = 0) AS cached FROM (SELECT unnest(source_ids) AS source_id, n FROM ev) GROUP BY 1),
reg AS (SELECT DISTINCT source_id FROM ev UNION SELECT 'absent' UNION SELECT 'mirror'), rep AS (SELECT DISTINCT source_id, 'ok' AS status FROM ev)
SELECT reg.source_id, coalesce(records, 0) AS records, coalesce(cached, 0) AS cached, CASE WHEN status IS NULL THEN 'missing' WHEN status = 'ok' AND coalesce(records, 0) > 0 THEN 'healthy' WHEN status IN ('ok', 'ok_empty') THEN 'empty' ELSE 'incomplete' END AS state FROM reg LEFT JOIN rep USING (source_id) LEFT JOIN r USING (source_id)""")
def a08_j15_source_coverage(spark, sf_dir):
    e = ev(spark, sf_dir)
    reported = e.select("source_id").distinct().withColumn("status", F.lit("ok"))
    registry = e.select("source_id").distinct().union(spark.createDataFrame([("absent",), ("mirror",)], "source_id string"))
    return A.source_coverage(e, registry, reported).select("source_id", "records", "cached", "state")


@query("SELECT source_id, count(DISTINCT provider_record_id) AS records, epoch(date_trunc('second', max(CASE WHEN greatest(issued_at, occurred_start) <= TIMESTAMP '2024-01-31' THEN greatest(issued_at, occurred_start) END)))::BIGINT AS newest FROM ev GROUP BY source_id")
def a12_batch_stats(spark, sf_dir):
    e = ev(spark, sf_dir).withColumn("source_updated_at", F.lit(None).cast("timestamp"))
    none = e.limit(0).select("source_id", F.lit("x").alias("reason"))
    return A.batch_stats(e, none, NOW).select("source_id", "records", F.unix_timestamp("newest_content_at").alias("newest"))


@query(f"""WITH g AS (SELECT {_GROUP} AS g, source_url IS NOT NULL AS c FROM ev) SELECT count(*) AS processed, count(*) FILTER (WHERE g = 'historical') AS historical, count(*) FILTER (WHERE g <> 'historical' AND NOT c) AS uncitable, count(*) FILTER (WHERE g <> 'historical' AND c) AS citable FROM g""")
def a15_briefing_counts(spark, sf_dir):
    e = X.assign_group(ev(spark, sf_dir), False, SINCE, UNTIL).withColumn("is_citable", F.col("source_url").isNotNull())
    return A.briefing_counts(e)


@query("SELECT count(*) FILTER (WHERE location_precision = 'point') AS points, 0::BIGINT AS areas_only, count(*) FILTER (WHERE location_precision <> 'point') AS unlocated FROM ev")
def a17_geometry_coverage(spark, sf_dir):
    return A.geometry_coverage(ev(spark, sf_dir))


@query("SELECT DISTINCT 'category' AS what, category AS value FROM ev UNION SELECT DISTINCT 'country', unnest(countries) FROM ev")
def a18_present_values(spark, sf_dir):
    return A.present_values(ev(spark, sf_dir))


@query("SELECT min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM ev WHERE location_precision = 'point' AND severity = 3")
def a19_extent(spark, sf_dir):
    return A.extent(ev(spark, sf_dir).where("severity = 3")).select("w", "s", "e", "n")


@query("""WITH l AS (SELECT DISTINCT lon FROM ev WHERE location_precision = 'point' AND (lon > 100 OR lon < -120)), g AS (SELECT lon AS hi, coalesce(lead(lon) OVER (ORDER BY lon), (SELECT min(lon) FROM l) + 360) AS nx FROM l),
m AS (SELECT * FROM g ORDER BY nx - hi DESC, nx DESC LIMIT 1) SELECT nx AS west, CASE WHEN hi < nx THEN hi + 360 ELSE hi END AS east, nx - hi AS gap FROM m""")
def a20_extent_globe(spark, sf_dir):
    """The shortest longitude range across the dateline: all but the widest gap."""
    return A.extent_globe(ev(spark, sf_dir).where((F.col("lon") > 100) | (F.col("lon") < -120)))


@query("""WITH p AS (SELECT id, (lon + 180) / 360 * 256 * 8 AS x, (0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) * 256 * 8 AS y FROM ev WHERE location_precision = 'point')
SELECT floor(x / 48)::BIGINT AS cx, floor(y / 48)::BIGINT AS cy, count(*) AS n, min(id) AS sample_id FROM p GROUP BY 1, 2""")
def a22_clusters(spark, sf_dir):
    return A.cluster_points(ev(spark, sf_dir), 3).select("cx", "cy", "n", "sample_id")


@query("SELECT 'events' AS \"table\", (SELECT count(*) FROM events) AS n UNION ALL SELECT 'orders', (SELECT count(*) FROM orders)", uses_ev=False)
def a23_table_counts(spark, sf_dir):
    return A.table_counts({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "orders")})


@query("SELECT count(*) FILTER (WHERE independent_source_count < 3) AS omitted FROM ev")
def a24_omitted_by_sources(spark, sf_dir):
    return A.omitted_by_sources(ev(spark, sf_dir), 3)


@query("SELECT concat_ws(',', CASE WHEN count(*) > 300 THEN 'truncated' END, CASE WHEN count(*) FILTER (WHERE occurred_start IS NULL) > 0 THEN 'unknown_time' END, CASE WHEN count(*) FILTER (WHERE len(countries) = 0) > 0 THEN 'unknown_country' END, CASE WHEN count(*) FILTER (WHERE independent_source_count < 2) > 0 THEN 'single_source' END, CASE WHEN count(*) FILTER (WHERE category = 'cyber') > 0 THEN 'publication_is_not_occurrence' END) AS codes FROM ev WHERE severity = 2")
def a25_limitation_codes(spark, sf_dir):
    return A.limitation_codes(ev(spark, sf_dir).where("severity = 2"), 300).select(F.array_join("limitations", ",").alias("codes"))


@query("""SELECT source_id, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS runs, round(avg(CASE WHEN n % 5 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(sum(n % 7)::DOUBLE / greatest(sum(n % 7 + n % 11), 1), 6) AS rejected_share FROM ev GROUP BY GROUPING SETS ((source_id, CAST(ts AS DATE)), (source_id), ())""")
def a26_run_stats(spark, sf_dir):
    n = F.col("n")
    runs = ev(spark, sf_dir).select("source_id", F.col("ts").alias("started_at"), F.when(n % 5 != 0, "ok").otherwise("error").alias("status"), (n % 7).alias("rejected"), (n % 11).alias("accepted"))
    return A.run_stats(runs).select("source_id", F.col("day").cast("string").alias("day"), "runs", F.round("success_rate", 6).alias("success_rate"), F.round("rejected_share", 6).alias("rejected_share"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_id, provider_record_id ORDER BY ts DESC, id DESC) AS rn FROM ev) SELECT source_id, provider_record_id, id FROM r WHERE rn <= 3")
def w01_w05_newest_per_key(spark, sf_dir):
    return L.newest_per_key(ev(spark, sf_dir), ["source_id", "provider_record_id"], [F.desc("ts"), F.desc("id")], 3).select("source_id", "provider_record_id", "id")


@query("WITH w AS (SELECT id, row_number() OVER k AS version_no, epoch(date_trunc('second', lead(ts) OVER k)) - epoch(date_trunc('second', ts)) AS seconds_to_next, lead(id) OVER k IS NOT NULL AS has_newer FROM ev WINDOW k AS (PARTITION BY source_id, provider_record_id ORDER BY ts, id)) SELECT * FROM w")
def w06_w12_revision_chain(spark, sf_dir):
    e = ev(spark, sf_dir).withColumn("observation_id", F.col("id"))
    keys = ["source_id", "provider_record_id"]
    return L.has_newer(L.revision_chain(e, keys, "ts"), keys, "ts").select("id", F.col("version_no").cast("long").alias("version_no"), F.col("seconds_to_next").cast("double").alias("seconds_to_next"), "has_newer")


@query("SELECT id, epoch(date_trunc('second', max(issued_at) OVER (PARTITION BY source_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) AS high_water FROM ev")
def w10_high_water(spark, sf_dir):
    return L.high_water(ev(spark, sf_dir), ["source_id"], "issued_at", "n").select("id", F.unix_timestamp("high_water").cast("double").alias("high_water"))


@query(f"WITH {_SPAN} SELECT CAST(clock AS DATE)::VARCHAR AS day, count(*) AS n, max(severity) AS max_severity FROM span GROUP BY 1")
def w13_days(spark, sf_dir):
    return L.timeline_by_day(X.default_basis(ev(spark, sf_dir))).withColumn("day", F.col("day").cast("string"))


@query("SELECT id, epoch(date_trunc('second', issued_at))::BIGINT AS clock FROM ev WHERE severity = 4 ORDER BY severity DESC, issued_at DESC NULLS LAST, id LIMIT 30")
def l02_l03_top_facts(spark, sf_dir):
    return L.top_facts(ev(spark, sf_dir).where("severity = 4"), "published", 30).select("id", F.unix_timestamp("issued_at").alias("clock"))


@query("SELECT id FROM ev WHERE issued_at < TIMESTAMP '2024-01-20' OR issued_at IS NULL OR (issued_at = TIMESTAMP '2024-01-20' AND id > 'e5') ORDER BY issued_at DESC NULLS LAST, id LIMIT 60")
def l04_l05_page(spark, sf_dir):
    """One keyset page in view order."""
    return L.page(ev(spark, sf_dir), (datetime(2024, 1, 20), "e5"), 60).select("id")


@query(f"""WITH {_SPAN}, r AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY (basis <> 'validity' OR coalesce(issued_at >= {S} AND issued_at < {U}, false) OR coalesce(valid_from >= {S} AND valid_from < {U}, false)) DESC,
  coalesce(severity >= 3 AND trim(original_severity) <> '', false) DESC, clock DESC NULLS LAST, id) AS rn FROM span WHERE {_INSIDE}) SELECT id FROM r WHERE rn = 1""")
def w07_l07_highlights(spark, sf_dir):
    """Step one of the highlights: a representative of each category (the greedy rest has tests of its own)."""
    rows = _spans(spark, sf_dir).where(X.span_intersects("span", SINCE, UNTIL))
    return L.highlights(rows, SINCE, UNTIL).where("step = 'category'").select("id")


# --- joins, identity, change data -----------------------------------------------------------------------------------


_PLACED = """placed AS (SELECT id, n, category, occurred_start AS t, CASE n % 3 WHEN 0 THEN CASE WHEN n % 10 < 5 THEN 179.93 ELSE -179.98 END WHEN 1 THEN 45.0 * (n % 8) - 180 ELSE 20.0 + 0.37 * (n % 11) END + 0.0013 * (n % 97) AS lon,
  CASE n % 3 WHEN 0 THEN 10.0 + 0.2 * (n % 7) WHEN 1 THEN 89.6 + 0.05 * (n % 6) ELSE 45.3 + 0.11 * (n % 5) END + 0.0007 * (n % 89) AS lat FROM ev WHERE occurred_start IS NOT NULL)"""
_REDUCED = "atan((1 - 1 / 298.257223563) * tan(radians({0})))"


@query(f"""WITH {_PLACED}, w AS (SELECT *, {_REDUCED.format("lat")} AS lr, floor(epoch_us(t) / 21600000000)::BIGINT AS tb FROM placed),
v AS (SELECT a.id AS a, b.id AS b, abs(epoch_us(a.t) - epoch_us(b.t)) AS dt, a.category AS ca, b.category AS cb, pow(sin((b.lr - a.lr) / 2), 2) + cos(a.lr) * cos(b.lr) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h, (a.lr + b.lr) / 2 AS p, (b.lr - a.lr) / 2 AS q
  FROM w a, (SELECT unnest([-1, 0, 1]) AS o) JOIN w b ON b.tb = a.tb + o AND a.id <> b.id AND abs(epoch_us(a.t) - epoch_us(b.t)) <= 21600000000 AND (a.category <> b.category OR a.category = 'earthquake')),
s AS (SELECT *, 2 * asin(sqrt(least(h, 1.0))) AS s FROM v WHERE h < 0.0001),
d AS (SELECT *, CASE WHEN s < 1e-12 THEN 0 ELSE 6378.137 * (s - 1 / 298.257223563 / 2 * ((s - sin(s)) * pow(sin(p) * cos(q), 2) / greatest(pow(cos(s / 2), 2), 1e-15) + (s + sin(s)) * pow(cos(p) * sin(q), 2) / greatest(pow(sin(s / 2), 2), 1e-15))) END AS km FROM s),
k AS (SELECT *, CASE WHEN ca = 'earthquake' AND cb = 'earthquake' AND dt <= 600000000 AND km <= 25 THEN 'possible_same_event' WHEN ca <> cb AND km <= 100 THEN 'near_in_space_and_time' END AS kind FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dt, km, b) AS rn FROM k WHERE kind IS NOT NULL)
SELECT least(a, b) AS a, greatest(a, b) AS b, kind, round(min(km), 3) AS km, round(min(dt) / 3600000000.0, 6) AS hours FROM r WHERE rn <= 20 GROUP BY 1, 2, 3""")
def j07_relations(spark, sf_dir):
    """Relations over the dateline, round a pole and over borders of cells, by the fixed limits, the 20 nearest in time of each event."""
    lon = F.when(F.col("n") % 3 == 0, F.when(F.col("n") % 10 < 5, 179.93).otherwise(-179.98)).when(F.col("n") % 3 == 1, 45.0 * (F.col("n") % 8) - 180).otherwise(20.0 + 0.37 * (F.col("n") % 11)) + 0.0013 * (F.col("n") % 97)
    lat = F.when(F.col("n") % 3 == 0, 10.0 + 0.2 * (F.col("n") % 7)).when(F.col("n") % 3 == 1, 89.6 + 0.05 * (F.col("n") % 6)).otherwise(45.3 + 0.11 * (F.col("n") % 5)) + 0.0007 * (F.col("n") % 89)
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.struct(lon.alias("lon"), lat.alias("lat"))).alias("points"))
    e = ev(spark, sf_dir).withColumns({"geometry": shape, "location_precision": F.lit("point"), "time_precision": F.lit("second")})
    out = J.relate_events(e)
    digits = lambda c, n: F.round(F.col(c) * 10.0**n) / 10.0**n  # noqa: E731  halves as SQL rounds them: of the scaled number, not of its shortest decimals
    return out.select(F.col("event_a").alias("a"), F.col("event_b").alias("b"), F.col("relation_type").alias("kind"), digits("distance_km", 3).alias("km"), digits("time_delta_hours", 6).alias("hours"))


_BOX = "box AS (SELECT r_regionkey, r_name, -180 + 72.0 * r_regionkey AS w, -180 + 72.0 * (r_regionkey + 1) AS e FROM region)"


@query(f"WITH {_BOX} SELECT ev.id, list_sort(list(r_name)) AS areas FROM ev JOIN box ON lon BETWEEN w AND e WHERE location_precision = 'point' AND n % 9 = 0 GROUP BY ev.id")
def j05_assign_area(spark, sf_dir):
    """Points without a country by the rectangle that covers them."""
    k = F.col("r_regionkey").cast("double")
    at = lambda x, y: F.struct(x.alias("lon"), F.lit(y).alias("lat"))
    w, e = -180 + 72.0 * k, -180 + 72.0 * (k + 1)
    rings = F.array(F.array(at(w, -90.0), at(e, -90.0), at(e, 90.0), at(w, 90.0), at(w, -90.0)))
    areas = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("iso2"), rings.alias("rings"))
    areas = areas.withColumn("geometry", F.struct(F.lit("Polygon").alias("type"), F.array().cast("array<struct<lon:double,lat:double>>").alias("points"), F.col("rings").alias("rings")))
    out = J.assign_country(ev(spark, sf_dir).where("n % 9 = 0"), areas)
    return out.where("location_precision = 'point'").select("id", F.col("countries").alias("areas"))


@query("""SELECT l_orderkey::VARCHAR AS event_id, greatest(1, count(DISTINCT s_nationkey))::INT AS independent_source_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""", uses_ev=False)
def i12_independent_origins(spark, sf_dir):
    """Lineage families of orders: nations of their suppliers."""
    li, s = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey"), spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    m = li.join(s, li.l_suppkey == s.s_suppkey).select(F.col("l_orderkey").cast("string").alias("event_id"), F.array(F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"))).alias("origins"))
    return I.independent_origins(m).select("event_id", "independent_source_count")


@query("""WITH o AS (SELECT source_id, provider_record_id, md5(props) AS payload_hash, 1 AS normalizer_version, n FROM ev) SELECT source_id, count(*) AS n FROM (SELECT DISTINCT source_id, provider_record_id, payload_hash FROM o WHERE n % 2 = 1 EXCEPT SELECT DISTINCT source_id, provider_record_id, payload_hash FROM o WHERE n % 2 = 0) GROUP BY 1""")
def k01_append_observations(spark, sf_dir):
    o = ev(spark, sf_dir).select("source_id", "provider_record_id", F.md5("props").alias("payload_hash"), F.lit(1).alias("normalizer_version"), "n")
    return I.append_observations(o.where("n % 2 = 0"), o.where("n % 2 = 1")).groupBy("source_id").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT l_orderkey AS ev_id, min(l_partkey) AS key FROM lineitem GROUP BY 1)
SELECT 'r' || l.l_orderkey AS record_id, list_sort(list(DISTINCT 'ev' || k.ev_id)) AS matches FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN k ON k.key = l.l_partkey GROUP BY 1""", uses_ev=False)
def j02_match_keys(spark, sf_dir):
    """All orders as owners of their least part and as records with all their parts."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_partkey").alias("k"))
    owned = li.groupBy("l_orderkey").agg(F.min("k").alias("k")).select(F.col("k").cast("string").alias("external_id"), F.concat(F.lit("ev"), F.col("l_orderkey").cast("string")).alias("event_id"))
    recs = li.groupBy(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("record_id")).agg(F.collect_set(F.col("k").cast("string")).alias("keys"))
    return I.match_keys(recs, owned)


_SNAP = "cur AS (SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS st FROM orders WHERE o_orderkey % 7 <> 0), base AS (SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS st FROM orders WHERE o_orderkey % 11 <> 0)"


@query(f"WITH {_SNAP} SELECT CASE WHEN b.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'missing' WHEN c.st <> b.st THEN 'changed' ELSE 'same' END AS status, count(*) AS n FROM cur c FULL JOIN base b ON c.id = b.id GROUP BY 1", uses_ev=False)
def j13_snapshot_delta(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus")
    cur = o.where("k % 7 <> 0").select("id", F.sha2(F.when(F.col("k") % 10 == 0, "X").otherwise(F.col("o_orderstatus")), 256).alias("fp"))
    base = o.where("k % 11 <> 0").select("id", F.sha2("o_orderstatus", 256).alias("fp"))
    return I.compare_snapshots(cur, base, NOW, MID).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey::VARCHAR AS owner, CASE WHEN o_orderkey % 5 = 0 THEN 'accepted' WHEN o_orderdate > DATE '1995-01-01' THEN 'accepted' WHEN o_orderdate < DATE '1995-01-01' THEN 'older' WHEN o_orderstatus = 'O' THEN 'same' ELSE 'conflict' END AS outcome FROM orders""", uses_ev=False)
def i27_advance_baseline(spark, sf_dir):
    """A baseline of each order but each fifth, against the order's own date and status."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("owner"), F.col("o_orderdate").cast("timestamp").alias("generated_at"), F.col("o_orderstatus").alias("set_hash"))
    old = o.where("k % 5 <> 0").select("owner", F.lit("1995-01-01").cast("timestamp").alias("generated_at"), F.lit("O").alias("set_hash"))
    return I.advance_baseline(old, o.drop("k")).select("owner", "outcome")


@query("""WITH p AS (SELECT id, 'public/event/[["' || source_id || '","' || provider_record_id || '"]' || CASE WHEN n % 2 = 0 THEN ',["' || source_id || '","' || provider_record_id || ':x"]' ELSE '' END || ']' AS name FROM ev), h AS (SELECT id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(name)) AS h FROM p)
SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS public_id FROM h""")
def i24_public_ids(spark, sf_dir):
    pair = lambda r: F.struct("source_id", r.alias("provider_record_id"))
    one, two = pair(F.col("provider_record_id")), pair(F.concat("provider_record_id", F.lit(":x")))
    e = ev(spark, sf_dir).withColumn("pairs", F.when(F.col("n") % 2 == 0, F.array(two, one)).otherwise(F.array(one)))
    return I.public_ids(e).select("id", "public_id")


_ROW_MD5 = "md5(event_id || '|' || event_type || '|' || coalesce(props, ''))"


@query("SELECT count(*) AS n, md5(string_agg(md5(event_id || '|' || event_type || '|' || coalesce(props, '')), '' ORDER BY md5(event_id || '|' || event_type || '|' || coalesce(props, '')))) AS digest FROM events", uses_ev=False)
def k09_fingerprint(spark, sf_dir):
    """One digest over every row's md5 in order."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    row = F.concat(F.col("event_id").cast("string"), F.lit("|"), "event_type", F.lit("|"), F.coalesce("props", F.lit("")))
    return sinks.md5_fingerprint(df, row).select("n", F.nullif("digest", F.md5(F.lit(""))).alias("digest"))  # of no rows: null


@query(f"""WITH r AS (SELECT event_id::VARCHAR AS k, {_ROW_MD5} AS h FROM events),
l AS (SELECT 2 AS level, substr(md5(k), 1, 2) AS node, count(*) AS n, md5(count(*) || ':' || sum(('0x' || substr(h, 1, 15))::BIGINT)::HUGEINT || ':' || sum(('0x' || substr(h, 16, 15))::BIGINT)::HUGEINT) AS digest FROM r GROUP BY 2),
m AS (SELECT 1 AS level, substr(node, 1, 1) AS node, sum(n)::BIGINT AS n, md5(string_agg(node || ':' || digest, '|' ORDER BY node)) AS digest FROM l GROUP BY 2),
t AS (SELECT 0 AS level, '' AS node, sum(n)::BIGINT AS n, md5(string_agg(node || ':' || digest, '|' ORDER BY node)) AS digest FROM m)
FROM l UNION ALL FROM m UNION ALL FROM t""", uses_ev=False)
def k09_digest_tree(spark, sf_dir):
    """The digest tree of a table: 256 ranges of its keys, 16 above them, one root."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return sinks.digest_tree(df, F.col("event_id").cast("string"), F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.coalesce("props", F.lit(""))))


@query("""SELECT 'orders' AS "table", CASE WHEN count(*) FILTER (o_orderkey % 7 = 0) = 0 THEN 'same' ELSE 'differs' END AS status FROM orders UNION ALL
SELECT 'lineitem', CASE WHEN count(*) FILTER (l_quantity < 0) = 0 THEN 'same' ELSE 'differs' END FROM lineitem""", uses_ev=False)
def k10_manifest(spark, sf_dir):
    """Manifests of whole tables: one shuffled, one that lacked each seventh order."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem")}
    manifest = sinks.write_manifest({"orders": t["orders"].where("o_orderkey % 7 <> 0"), "lineitem": t["lineitem"].where("l_quantity >= 0").repartition(3)})
    return sinks.compare_manifest(sinks.write_manifest(t), manifest)


@query(f"""WITH c AS (SELECT * FROM (VALUES (NULL, 168, true, {S}), ('PL', 72, false, TIMESTAMP '2024-01-10'), ('DE', 24, true, TIMESTAMP '2024-01-30')) AS t(country, hours, first, since))
SELECT coalesce(c.country, 'world') || '/' || hours AS scope_id, count(*) AS processed FROM c JOIN ev ON last_changed_at >= since AND last_changed_at < {U} AND (c.country IS NULL OR list_contains(countries, c.country)) GROUP BY 1""")
def p04_j21_briefings(spark, sf_dir):
    """Incremental briefings of three scopes, one of them from its saved cursor."""
    scopes = spark.createDataFrame([(None, 168), ("PL", 72), ("DE", 24)], "country string, window_hours int")
    runs = spark.createDataFrame([("r1", "PL", 72, datetime(2024, 1, 9), datetime(2024, 1, 9)), ("r2", "PL", 72, datetime(2024, 1, 10), datetime(2024, 1, 10)), ("r3", "PL", 24, datetime(2024, 1, 30), datetime(2024, 1, 30))], "run_id string, country string, window_hours int, created_at timestamp, until timestamp")
    counts, _ = P.briefing(ev(spark, sf_dir).withColumn("source_urls", F.array("source_url")), scopes, runs, NOW)
    return counts.select("scope_id", "processed")


@query(f"""WITH {_SPAN}, w AS (SELECT 'world' AS scope, 24 AS hours UNION ALL SELECT 'europe', 24 UNION ALL SELECT 'world', 168 UNION ALL SELECT 'europe', 168)
SELECT scope, hours, category, count(*) AS n FROM w JOIN span ON dated AND (scope = 'world' OR list_has_any(countries, {_EUROPE})) AND CASE WHEN point THEN s >= {U} - to_hours(hours) AND s < {U} ELSE s < {U} AND (open OR e > {U} - to_hours(hours)) END GROUP BY ALL""")
def p05_situations(spark, sf_dir):
    scopes = X.scopes_df(spark, [])
    return P.situations(ev(spark, sf_dir), scopes, [24, 168], NOW)


_IN_HOURS = f"dated AND CASE WHEN point THEN s >= {U} - to_hours(hours) AND s < {U} ELSE s < {U} AND (open OR e > {U} - to_hours(hours)) END"


@query(f"""WITH {_SPAN}, w AS (SELECT * FROM (VALUES ('world'), ('europe'), ('country:PL'), ('country:DE')) AS a(scope) CROSS JOIN (VALUES (24, 1), (72, 3), (168, 6), (720, 24)) AS b(hours, width)),
r AS (SELECT scope, hours, width, span.*, coalesce({_IN_HOURS}, false) AS inside FROM w JOIN span ON scope = 'world' OR (scope = 'europe' AND list_has_any(countries, {_EUROPE})) OR list_contains(countries, scope[9:]))
SELECT scope, hours, 'category' AS part, category AS name, count(*) AS n FROM r WHERE inside GROUP BY ALL
UNION ALL SELECT scope, hours, 'kind', kind, count(*) FROM r WHERE inside GROUP BY ALL
UNION ALL SELECT scope, hours, 'advisory', {_STATE.format(at=U)}, count(*) FROM r WHERE inside AND kind = 'advisory' GROUP BY ALL
UNION ALL SELECT scope, hours, 'unknown', 'time', count(*) FROM r WHERE NOT coalesce(dated, false) GROUP BY ALL
UNION ALL SELECT scope, hours, 'unknown', 'country', count(*) FROM r WHERE coalesce(len(countries), 0) = 0 GROUP BY ALL
UNION ALL SELECT scope, hours, 'unknown', 'cached', count(*) FROM r WHERE list_contains(tags, 'cached_public_data') GROUP BY ALL
UNION ALL SELECT scope, hours, 'bin', bin::VARCHAR, count(*) FROM (SELECT *, unnest(range(hours // width)) AS bin FROM r WHERE inside)
  WHERE CASE WHEN point THEN s >= {U} - to_hours(hours - bin * width) AND s < {U} - to_hours(hours - (bin + 1) * width) ELSE s < {U} - to_hours(hours - (bin + 1) * width) AND (open OR e > {U} - to_hours(hours - bin * width)) END GROUP BY ALL""")
def p05_situation_parts(spark, sf_dir):
    """Every part of the situation of four scopes over four windows, timelines by difference counts."""
    return P.situation_parts(ev(spark, sf_dir), X.scopes_df(spark, ["PL", "DE"]), [24, 72, 168, 720], NOW)


@query("SELECT id FROM ev WHERE source_url IS NOT NULL")
def f26_citable(spark, sf_dir):
    return X.citable(ev(spark, sf_dir).withColumn("source_urls", F.array("source_url"))).select("id")


@query("WITH v AS (SELECT event_type, user_id, count(DISTINCT props) AS k FROM events GROUP BY 1, 2) SELECT event_type || '/' || user_id AS key, k > 1 AS rejected FROM v", uses_ev=False)
def i28_s13_duplicates(spark, sf_dir):
    """Identical repeats collapse, conflicting ones all go."""
    from eventlens.sources.feeds import dedupe_feed

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"), F.coalesce("props", F.lit("")).alias("raw_hash"))
    good, bad = dedupe_feed(e, "key")
    return good.select("key", F.lit(False).alias("rejected")).union(bad.select("key", F.lit(True)).distinct())


def _records(spark, sf_dir):
    """One normalized record per (source, user): the user's latest event of a source, sharing the key a:user."""
    from eventlens.schemas import EVENT_COLUMNS

    last = ev(spark, sf_dir).groupBy("source_id", "provider_record_id").agg(F.max_by(F.struct("ts", "title", "n"), F.struct("ts", "n")).alias("x"))
    none = F.array().cast("array<string>")
    values = {
        "source_id": F.col("source_id"), "provider_record_id": F.col("provider_record_id"), "kind": F.lit("incident"), "category": F.lit("internet"), "title": F.col("x.title"), "source_updated_at": F.col("x.ts"), "countries": none,
        "origins": F.array("source_id"), "external_ids": F.array(F.concat(F.lit("a:"), "provider_record_id")), "supersedes": none, "tags": none, "severity": F.lit(1), "lifecycle_status": F.lit("active"), "location_precision": F.lit("unknown"),
        "time_precision": F.lit("second"), "raw_hash": F.md5(F.concat_ws("|", "source_id", "provider_record_id", F.col("x.n").cast("string"))), "source_url": F.lit("https://x.example.org/"), "raw": F.lit("{}"),
    }
    return last.select(*(values.get(c, F.lit(None)).cast(k).alias(c) for c, k in EVENT_COLUMNS.items()))


_PRIORITY = "CASE source_id " + " ".join(f"WHEN '{x[0]}' THEN {x[5]}" for x in SOURCES) + " ELSE 2 END"


@query(f"""WITH r AS (SELECT source_id, provider_record_id AS u, max(ts) AS ts FROM ev GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY {_PRIORITY}, ts, concat(source_id, '|', u)) AS k FROM r)
SELECT concat(source_id, '|', u) AS record, CASE WHEN u::INT % 30 = 0 THEN NULL WHEN u::INT % 3 = 0 THEN 'E' || u WHEN u::INT % 10 = 0 THEN 'F' || u ELSE 'ev:a:' || u END AS event_id, u::INT % 3 <> 0 AND u::INT % 10 <> 0 AND k = 1 AS is_new,
  CASE WHEN u::INT % 30 = 0 THEN 'identity_conflict' END AS reason FROM o""")
def i02_identity(spark, sf_dir):
    """Records of a user share a key; some users are known by one event, some by two (a conflict, never merged): what became of every row."""
    rec = _records(spark, sf_dir).withColumn("external_ids", F.array(F.concat(F.lit("a:"), "provider_record_id"), F.concat(F.lit("b:"), "provider_record_id")))
    users = rec.select(F.col("provider_record_id").alias("u")).distinct()
    known = users.where("u % 3 = 0").select(F.concat(F.lit("a:"), "u").alias("external_id"), F.concat(F.lit("E"), "u").alias("event_id")).union(users.where("u % 10 = 0").select(F.concat(F.lit("b:"), "u"), F.concat(F.lit("F"), "u")))
    good, bad = I.resolve_identity(rec, known, replayed=0)
    record = F.concat_ws("|", "source_id", "provider_record_id").alias("record")
    kept = good.select(record, "event_id", "is_new", F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(bad.select(record, F.lit(None).cast("string").alias("event_id"), F.lit(False).alias("is_new"), "reason"))


@query("""WITH r AS (SELECT source_id, provider_record_id, max(ts) AS ts, arg_max(title, (ts, n)) AS title FROM ev GROUP BY 1, 2)
SELECT 'ev:a:' || provider_record_id AS event_id, arg_max(title, ts) AS title, array_to_string(list_sort(list(source_id)), ',') AS sources, count(*)::INT AS independent_source_count, 'new' AS change_type FROM r GROUP BY provider_record_id""")
def p07_ingest(spark, sf_dir):
    """A first batch into empty tables: identity, observations, projections, changes."""
    tables, _ = P.persist_batch(P.empty_tables(spark), _records(spark, sf_dir), NOW)
    return tables["events"].select("event_id", "title", F.array_join("source_ids", ",").alias("sources"), F.col("independent_source_count").cast("int").alias("independent_source_count"), "change_type")


# --- functions -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents", uses_ev=False)
def t01_fold(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(text.fold("text")).alias("folded"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
 '(?i)</?(address|article|aside|blockquote|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>', ' ', 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&') AS t FROM a)
SELECT page_id, md5(coalesce(rtrim(substr(trim(regexp_replace(t, '[ \t\n\r\f\v]+', ' ', 'g')), 1, 500)), '')) AS plain FROM b""", uses_ev=False)
def t02_plain(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.md5(F.coalesce(text.plain("html", 500, numeric=False), F.lit(""))).alias("plain"))


@query(r"SELECT page_id, regexp_matches(url, '^https?://[^/@\s]+') AND NOT regexp_matches(url, '[\s\\]') AS safe, regexp_matches(url, '^https?://[^/:@]+\.example\.com(:80|:443)?/') AS com FROM pages", uses_ev=False)
def t05_t06_links(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", text.safe_url("url").isNotNull().alias("safe"), (F.col("url").rlike(r"^https?://[^/:@]+\.example\.com") & text.is_public_url("url")).alias("com"))


@query("SELECT doc_id, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 59)) || '…' ELSE t END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM documents)", uses_ev=False)
def t08_one_line(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.one_line("text", 60).alias("line"))


@query("SELECT conv_id, turn, list_sort(list_filter([CASE WHEN contains(t, 'avec') THEN 'with' END, CASE WHEN contains(t, 'mente') THEN 'suffix' END, CASE WHEN contains(t, 'und') THEN 'and' END], lambda x: x IS NOT NULL)) AS tagged FROM (SELECT conv_id, turn, lower(strip_accents(text)) AS t FROM conversations)", uses_ev=False)
def t11_tagging(spark, sf_dir):
    """Alias tags of whole texts."""
    c, t = spark.read.parquet(f"{sf_dir}/conversations.parquet"), text.fold("text")
    tags = F.array_sort(F.array_compact(F.array(*(F.when(F.contains(t, F.lit(a)), F.lit(k)) for a, k in (("avec", "with"), ("mente", "suffix"), ("und", "and"))))))
    return c.select("conv_id", "turn", tags.alias("tagged"))


@query("SELECT id, epoch(date_trunc('day', ts))::BIGINT AS day_start, strftime(ts, '%Y-%m-%d %H:%M UTC') AS shown, CASE WHEN epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', ts)) <= 7200 THEN 'fresh' WHEN epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', ts)) <= 86400 THEN 'recent' ELSE 'old' END AS age, least(720, greatest(1, ceil(epoch_us(TIMESTAMP '2024-01-31' - ts) / 3.6e9)))::INT AS hours FROM ev")
def d06_m03_time_functions(spark, sf_dir):
    e = ev(spark, sf_dir)
    now = F.lit(NOW).cast("timestamp")
    return e.select("id", F.unix_timestamp(time.day_span("ts")["start"]).alias("day_start"), time.display_time("ts", F.lit("minute")).alias("shown"), time.age_bucket("ts", now).alias("age"), severity.window_hours("ts", now).alias("hours"))


@query("SELECT id, epoch(date_trunc('second', ts))::BIGINT AS a, epoch(date_trunc('minute', ts))::BIGINT AS b, epoch(date_trunc('second', ts))::BIGINT - 7200 AS c, true AS ok FROM ev")
def d01_d02_parsing(spark, sf_dir):
    e = ev(spark, sf_dir)
    iso, mail = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("ts", "EEE, dd MMM yyyy HH:mm 'GMT'")
    ahead = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return e.select("id", F.unix_timestamp(time.parse_ts(iso)["ts"]).alias("a"), F.unix_timestamp(time.parse_ts(mail)["ts"]).alias("b"), F.unix_timestamp(time.parse_ts(ahead)["ts"]).alias("c"), time.is_iso_ts(iso).alias("ok"))


@query("""SELECT id, (CASE WHEN value * 0.05 > 15 OR value * 0.05 < -5 THEN 0 WHEN value * 0.05 >= 7 THEN 4 WHEN value * 0.05 >= 5.5 THEN 3 WHEN value * 0.05 >= 4 THEN 2 ELSE 1 END)::INT AS quake, ['usgs', 'nasa:firms', NULL, 'other'][1 + n % 4] AS family FROM ev""")
def m01_r04_ladders(spark, sf_dir):
    e = ev(spark, sf_dir)
    origin = F.element_at(F.array(F.lit("usgs:ci"), F.lit(" GWIS "), F.lit("unknown:x"), F.lit("Other")), (1 + F.col("n") % 4).cast("int"))
    return e.select("id", severity.severity_from_magnitude(F.col("value") * 0.05).alias("quake"), arrays.origin_family(origin).alias("family"))


@query("SELECT vec_id, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(lat - 52.0) / 2), 2) + cos(radians(52.0)) * cos(radians(lat)) * pow(sin(radians(lon - 21.0) / 2), 2))), 3) AS km FROM (SELECT vec_id, greatest(-180, least(180, 400 * embedding[1]::DOUBLE)) AS lon, greatest(-89, least(89, 200 * embedding[2]::DOUBLE)) AS lat FROM embeddings)", uses_ev=False)
def g01_haversine(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    lon, lat = F.greatest(F.lit(-180.0), F.least(F.lit(180.0), 400 * F.get("embedding", 0).cast("double"))), F.greatest(F.lit(-89.0), F.least(F.lit(89.0), 200 * F.get("embedding", 1).cast("double")))
    return e.select("vec_id", F.round(geo.haversine_km(F.lit(21.0), F.lit(52.0), lon, lat), 3).alias("km"))


@query("SELECT id, lon BETWEEN -20 AND 60 AND lat BETWEEN -30 AND 50 AND NOT (lon > 0 AND lon < 10 AND lat > 0 AND lat < 10) AS inside FROM ev")
def g03_covers(spark, sf_dir):
    """Points in a rectangle with a hole."""
    ring = lambda w, s, e, n: F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))))
    return ev(spark, sf_dir).select("id", geo.covers(F.array(ring(-20, -30, 60, 50), ring(0, 0, 10, 10)), F.col("lon"), F.col("lat")).alias("inside"))


# --- stream twins ----------------------------------------------------------------------------------------------------


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, source_id, count(*) AS n FROM ev GROUP BY 1, 2")
def x07_tumbling_counts(spark, sf_dir):
    """Batch twin of the tumbling stream counts."""
    return jobs.count_stream(ev(spark, sf_dir), "ts", "1 hour", keys=("source_id",)).select(F.unix_timestamp("start").alias("start"), "source_id", "n")


@query("SELECT epoch(time_bucket(INTERVAL 6 HOURS, ts))::BIGINT - 21600 * k AS start, count(*) AS n FROM ev, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1")
def x08_sliding_counts(spark, sf_dir):
    return jobs.count_stream(ev(spark, sf_dir), "ts", "24 hours", "6 hours").select(F.unix_timestamp("start").alias("start"), "n")


@query("""WITH g AS (SELECT source_id, ts, CASE WHEN ts >= lag(ts) OVER k + INTERVAL 20 MINUTES THEN 1 ELSE 0 END AS new FROM ev WINDOW k AS (PARTITION BY source_id ORDER BY ts)), s AS (SELECT source_id, ts, sum(new) OVER (PARTITION BY source_id ORDER BY ts) AS sid FROM g)
SELECT source_id, epoch(date_trunc('second', min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY source_id, sid""")
def x09_sessions(spark, sf_dir):
    return jobs.session_stream(ev(spark, sf_dir), "ts", "20 minutes", ("source_id",)).select("source_id", F.unix_timestamp("start").alias("start"), "n")


@query("WITH r AS (SELECT source_id, arg_max(id, (ts, id)) AS id FROM ev WHERE last_changed_at >= TIMESTAMP '2024-01-10' AND last_changed_at < TIMESTAMP '2024-01-20' GROUP BY source_id) SELECT * FROM r")
def x11_changes_since(spark, sf_dir):
    r = ev(spark, sf_dir).where((F.col("last_changed_at") >= datetime(2024, 1, 10)) & (F.col("last_changed_at") < datetime(2024, 1, 20))).select(F.col("source_id").alias("event_id"), F.col("ts").alias("changed_at"), F.col("id").alias("revision_id"))
    return I.changes_since(r, datetime(2023, 1, 1), datetime(2025, 1, 1)).select(F.col("event_id").alias("source_id"), F.col("revision_id").alias("id"))
