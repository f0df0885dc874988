"""Predicates, projections and query tables over events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.arrays import col, has_tag, norm_array, set_tag
from eventlens.functions.geo import bbox, distance_to_rings_km, geodesic_km, intersects_bbox
from eventlens.functions.intervals import tree_cover, tree_path
from eventlens.functions.text import contains_words, fold, is_public_url, label, safe_url, search_words
from eventlens.functions.time import BASIS_CLOCK, DAY_TAG, display_time
from eventlens.schemas import DEFAULT_BASIS, EUROPE, EUROPE_BOX, SEVERITY_LABELS, EventQuery
from eventlens.sources.lineage import small

_DAY = "INTERVAL 1 DAY"


def _ts(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("timestamp")


# --- windows and query tables -------------------------------------------------------------------------------


def validate_query(q: EventQuery) -> list[str]:
    """Reason codes; empty for a valid query."""
    bad = []
    if q.time_basis not in BASIS_CLOCK:
        bad.append("time_basis")
    if not 1 <= q.window_hours <= 720:
        bad.append("window_hours")
    if q.since is not None and q.until is not None and (q.since >= q.until or q.until - q.since > timedelta(hours=720)):
        bad.append("window")
    if len({q.lat is None, q.lon is None, q.radius_km is None}) > 1:
        bad.append("radius_incomplete")
    if not 0 <= q.severity_min <= 4:
        bad.append("severity_min")
    if not 1 <= q.limit <= 1000:
        bad.append("limit")
    return bad


def validate_queries(queries: DataFrame) -> DataFrame:
    """The same rules over a table of queries: `violations` holds the reason codes; duplicate ids are rejected."""
    from pyspark.sql import Window

    c = F.col
    known = (c("lat").isNotNull().cast("int") + c("lon").isNotNull().cast("int") + c("radius_km").isNotNull().cast("int")).isin(0, 3)
    width = F.unix_timestamp("until") - F.unix_timestamp("since")
    rules = {
        "time_basis": ~F.coalesce(c("time_basis").isin(*BASIS_CLOCK), F.lit(False)),
        "window_hours": ~F.coalesce(c("window_hours").between(1, 720), F.lit(False)),
        "window": F.coalesce((width <= 0) | (width > 720 * 3600), F.lit(False)),
        "radius_incomplete": ~known,
        "severity_min": ~F.coalesce(c("severity_min").between(0, 4), F.lit(False)),
        "duplicate": F.count("*").over(Window.partitionBy("query_id")) > 1,
    }
    return queries.withColumn("violations", F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items()))))


def window_bounds(query: EventQuery, now: datetime) -> tuple[datetime, datetime]:
    """(start, end) of one query's window: the end is now, and the width that of the query, unless it names them."""
    end = now if query.until is None else query.until
    start = end - timedelta(hours=query.window_hours) if query.since is None else query.since
    width = end - start
    if width <= timedelta(0) or width > timedelta(days=30):
        raise ValueError("window must be positive and at most 720 hours")
    return start, end


def query_bounds(queries: DataFrame, now) -> DataFrame:
    """since and until of every row of a query table."""
    until = F.coalesce("until", _ts(now))
    return queries.withColumn("until", until).withColumn("since", F.coalesce("since", F.col("until") - F.make_interval(hours=F.col("window_hours"))))


def shift_windows(queries: DataFrame, offsets: list[int], now) -> DataFrame:
    """One row per query and offset of 0 to 168 hours: the window keeps its width and its end moves back."""
    steps = sorted({o for o in offsets if 0 <= o <= 168})
    moved = query_bounds(queries, now).withColumn("offset_hours", F.explode(F.array(*map(F.lit, steps))))
    back = F.make_interval(hours=F.col("offset_hours"))
    return moved.withColumn("since", F.col("since") - back).withColumn("until", F.col("until") - back)


# --- time -----------------------------------------------------------------------------------------------------


def time_predicate(basis: str, since, until, tags: str = "tags") -> Column:
    """Half-open window on a basis clock; an unknown clock never matches."""
    since, until = _ts(since), _ts(until)
    if basis in ("occurred", "changed"):
        c = F.col(BASIS_CLOCK[basis])
        return (c >= since) & (c < until)
    if basis == "published":
        c, day = F.col("issued_at"), F.date_trunc("day", F.col("issued_at"))
        return F.when(has_tag(tags, DAY_TAG), (day < until) & (day + F.expr(_DAY) > since)).otherwise((c >= since) & (c < until))
    if basis == "validity":
        a, b = F.col("valid_from"), F.col("valid_to")
        return (a < until) & (b.isNull() | ((b > since) & (b > a)))
    raise ValueError(basis)


def filter_time(df: DataFrame, basis: str, since, until) -> DataFrame:
    return df.where(time_predicate(basis, since, until))


def filter_active(df: DataFrame, now) -> DataFrame:
    return df.where(~F.col("lifecycle_status").isin("expired", "withdrawn") & (F.col("valid_to").isNull() | (F.col("valid_to") > _ts(now))))


def inactive_by_default(basis: str) -> bool:
    return basis != "occurred"


# --- attributes and places --------------------------------------------------------------------------------------


def filter_attrs(df: DataFrame, query: EventQuery) -> DataFrame:
    if query.category:
        df = df.where(F.col("category") == query.category)
    if query.severity_min > 0:
        df = df.where(F.col("severity") >= query.severity_min)
    return df.where(F.col("independent_source_count") >= query.min_sources) if query.min_sources > 1 else df


def filter_country(df: DataFrame, iso2: str) -> DataFrame:
    return df.where(F.array_contains("countries", iso2.upper()))


def filter_europe(df: DataFrame) -> DataFrame:
    """European countries; Russia and Turkey only where an exact geometry meets the box."""
    return df.where(in_europe("geometry" in df.columns))


def in_europe(geometry: bool = True) -> Column:
    listed = F.arrays_overlap("countries", F.array(*map(F.lit, EUROPE)))
    if not geometry:
        return _false(listed)
    edge = F.arrays_overlap("countries", F.array(F.lit("RU"), F.lit("TR"))) & F.col("location_precision").isin("point", "area") & intersects_bbox("geometry", *EUROPE_BOX)
    return _false(listed) | _false(edge)


def filter_radius(df: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Exact points and areas within a distance on the ellipsoid; country areas and representative points are left out."""
    return df.where(within_radius(F.lit(float(lat)), F.lit(float(lon)), F.lit(float(km))))


def within_radius(lat: Column, lon: Column, km: Column) -> Column:
    g, box = F.col("geometry"), bbox("geometry")
    margin = km / 110.0
    near = (box["s"] <= lat + margin) & (box["n"] >= lat - margin)
    x, y = lon, lat
    to_points = F.array_min(F.transform(g["points"], lambda p: geodesic_km(x, y, p["lon"], p["lat"])))
    distance = F.when(F.size(g["rings"]) > 0, F.least(distance_to_rings_km(g["rings"], x, y), to_points)).otherwise(to_points)
    exact = ((F.col("location_precision") == "point") & (g["type"] == "Point")) | ((F.col("location_precision") == "area") & (F.size(g["rings"]) > 0))
    return _false(exact & near & (distance <= km))


def filter_scope(df: DataFrame, scope: str) -> DataFrame:
    """world, europe or country:XX, by explicit codes alone."""
    if scope == "world":
        return df
    codes = EUROPE if scope == "europe" else [scope.removeprefix("country:").upper()]
    return df.where(F.arrays_overlap("countries", F.array(*map(F.lit, codes))))


def country_labels(spark: SparkSession, language: str = "en") -> dict[str, str]:
    """Code and label of every country that the JVM's locale data list, and of XK."""
    locale = spark._jvm.java.util.Locale
    shown = locale.forLanguageTag(language)
    return {c: locale.forLanguageTag(f"und-{c}").getDisplayCountry(shown) for c in sorted({*locale.getISOCountries(), "XK"})}


def scopes_df(spark: SparkSession, countries: list[str] | None = None, language: str = "en") -> DataFrame:
    """scope, label, countries (null for the world): a small static dimension; all countries unless some are named."""
    labels = country_labels(spark, language)
    rows = [("world", "World", None), ("europe", "Europe", EUROPE), *((f"country:{c}", labels.get(c, c), [c]) for c in (labels if countries is None else countries))]
    return spark.createDataFrame(rows, "scope string, label string, codes array<string>")


def normalize_scope(c: Column | str) -> Column:
    """Legacy names and bare country codes as scope ids; null for anything else."""
    s = F.lower(F.trim(col(c)))
    code = F.upper(F.regexp_extract(s, r"^(?:country:)?([a-z]{2})$", 1))
    return F.when(s.isin("world", "europe"), s).when(s.isin("pl", "poland", "country:pl"), "country:PL").when(s == "turkey", "country:TR").when(s.isin("eu"), "europe").when(code != "", F.concat(F.lit("country:"), code))


# --- background and briefing groups ----------------------------------------------------------------------------


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _day_overlap(c: str, since: Column, until: Column) -> Column:
    day = F.date_trunc("day", F.col(c))
    return (day < until) & (day + F.expr(_DAY) > since)


def is_background(since, until) -> Column:
    """An initially imported record that neither was published nor happened in the window."""
    since, until = _ts(since), _ts(until)
    instant = lambda c: (F.col(c) >= since) & (F.col(c) < until)
    fact = F.col("kind").isin("incident", "measurement")
    recent = _false(instant("issued_at")) | _false(has_tag("tags", DAY_TAG) & _day_overlap("issued_at", since, until))
    recent = recent | _false(fact & instant("occurred_start")) | _false(fact & (F.col("time_precision") == "day") & _day_overlap("occurred_start", since, until))
    return _false(F.col("change_type") == "initial_import") & ~recent


def split_background(df: DataFrame, since, until) -> tuple[DataFrame, DataFrame]:
    """(current, background)."""
    b = is_background(since, until)
    return df.where(~b), df.where(b)


def publication_scope(since, until) -> Column:
    """today_published or null: whether the publication falls into the window."""
    since, until = _ts(since), _ts(until)
    hit = F.when(has_tag("tags", DAY_TAG), _day_overlap("issued_at", since, until)).otherwise((F.col("issued_at") >= since) & (F.col("issued_at") < until))
    return F.when(_false(hit), "published_in_window")


def occurrence_scope(since, until) -> Column:
    since, until = _ts(since), _ts(until)
    hit = F.when(F.col("time_precision") == "day", _day_overlap("occurred_start", since, until)).otherwise((F.col("occurred_start") >= since) & (F.col("occurred_start") < until))
    return F.when(_false(hit & F.col("kind").isin("incident", "measurement")), "occurred_in_window")


def group_column(first: bool | Column, since, until) -> Column:
    scope = F.coalesce(publication_scope(since, until), occurrence_scope(since, until))
    first = first if isinstance(first, Column) else F.lit(first)
    kind, or_old = F.col("change_type"), F.coalesce(scope, F.lit("historical"))
    return F.when(kind == "initial_import", or_old).when(kind == "withdrawn", "withdrawn").when(kind == "updated", "updated").when(first, or_old).when(kind == "new", "new").otherwise("other")


def assign_group(df: DataFrame, first: bool, since, until) -> DataFrame:
    return df.withColumn("briefing_group", group_column(first, since, until))


# --- spans, states and flags --------------------------------------------------------------------------------------


def category_map(values: dict) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))


def default_basis(df: DataFrame) -> DataFrame:
    return df.withColumn("basis", F.try_element_at(category_map(DEFAULT_BASIS), F.col("category")))


def basis_value() -> Column:
    """The clock of the row's own basis."""
    out = F.lit(None).cast("timestamp")
    for name, c in BASIS_CLOCK.items():
        out = F.when(F.col("basis") == name, F.col(c)).otherwise(out)
    return out


def event_span() -> Column:
    """struct<start, end, point, open> by the row's basis; null without a clock. An open end has a null `end`."""
    start, a, b = basis_value(), F.col("valid_from"), F.col("valid_to")
    day = F.date_trunc("day", start)
    span = lambda s, e, point, is_open: F.struct(s.alias("start"), e.alias("end"), F.lit(point).alias("point"), F.lit(is_open).alias("open"))
    none = F.lit(None).cast("timestamp")
    validity = F.when(b.isNotNull() & (b <= a), None).when(b.isNotNull(), span(a, b, False, False)).when(F.col("lifecycle_status") == "active", span(a, none, False, True)).otherwise(span(a, a, True, False))
    by_day = (F.col("time_precision") == "day") | has_tag("tags", DAY_TAG)
    return F.when(start.isNull(), None).when(F.col("basis") == "validity", validity).when(by_day, span(day, day + F.expr(_DAY), False, False)).otherwise(span(start, start, True, False))


def span_intersects(span: Column | str, a, b) -> Column:
    s, a, b = col(span), _ts(a), _ts(b)
    return F.when(s["point"], (s["start"] >= a) & (s["start"] < b)).otherwise((s["start"] < b) & (s["open"] | (s["end"] > a)))


def undated(df: DataFrame) -> DataFrame:
    return df.where(event_span().isNull())


def advisory_state(at) -> Column:
    a, b, status, at = F.col("valid_from"), F.col("valid_to"), F.col("lifecycle_status"), _ts(at)
    return (
        F.when(status == "withdrawn", "withdrawn").when(b <= a, "unknown").when((status == "expired") | (b <= at), "expired").when(a.isNull(), "unknown").when(a > at, "upcoming").when(b.isNotNull() | (status == "active"), "active").otherwise("unknown")
    )


def is_fresh(since, until) -> Column:
    """Not on the validity basis, or issued or in force from inside the window."""
    since, until = _ts(since), _ts(until)
    inside = lambda c: _false((F.col(c) >= since) & (F.col(c) < until))
    return (F.col("basis") != "validity") | inside("issued_at") | inside("valid_from")


def high_severity() -> Column:
    return _false((F.col("severity") >= 3) & (F.trim("original_severity") != ""))


def highlight_reason(until) -> Column:
    state = advisory_state(until)
    parts = [
        F.col("basis"), F.when(F.col("kind") == "advisory", F.concat(F.lit("state:"), state)), F.when(high_severity(), F.concat(F.lit("severity:"), F.col("original_severity"))),
        F.when((F.col("basis") == "validity") & F.col("valid_to").isNull(), F.lit("open_end")), F.when(has_tag("tags", "until_revoked"), F.lit("until_revoked")),
    ]
    return F.array_compact(F.array(*parts))


def effective_state(df: DataFrame, now) -> DataFrame:
    """lifecycle_status and tags as they stand at a clock; withdrawn and expired are final."""
    now, status, a, b = _ts(now), F.col("lifecycle_status"), F.col("valid_from"), F.col("valid_to")
    cap, space, final = F.col("source_id") == "meteoalarm", (F.col("source_id") == "noaa_swpc") & (F.col("kind") == "advisory"), status.isin("withdrawn", "expired")
    begun = _false(a <= now)
    by_cap = F.when(_false(b <= now), "expired").when(begun & b.isNotNull(), "active").otherwise("unknown")
    by_space = F.when(_false(b <= now), "expired").when(begun & _false(b > now), "active").otherwise("unknown")
    other = F.when(status.isin("active", "unknown") & _false(b <= now), "expired").otherwise(status)
    state = F.when(final, status).when(cap, by_cap).when(space, by_space).otherwise(other)
    waiting = _false(a > now) & ~final
    return df.withColumns({"lifecycle_status": state, "tags": F.when(cap, set_tag("tags", "hazard_onset_in_future", waiting)).otherwise(F.col("tags"))})


def apply_absence(df: DataFrame, state: DataFrame) -> DataFrame:
    """Open-ended active hydro advisories that the last complete list lacks become unknown; those in it recover."""
    s = state.select(F.col("source_id"), F.col("current_list_ingested_at").alias("__list"))
    listed = has_tag("tags", "current_list_not_archive") & has_tag("tags", "until_revoked")
    subject = (F.col("source_id") == "imgw_hydro") & (F.col("kind") == "advisory") & F.col("valid_to").isNull() & listed
    gone = _false(subject & (F.col("last_seen_at") < F.col("__list")))
    marked = has_tag("tags", "not_in_current_source_list")
    status = F.when(gone & (F.col("lifecycle_status") == "active"), "unknown").when(subject & marked & ~gone & (F.col("lifecycle_status") == "unknown"), "active").otherwise(F.col("lifecycle_status"))
    return df.join(small(s), "source_id", "left").withColumns({"lifecycle_status": status, "tags": F.when(subject, set_tag("tags", "not_in_current_source_list", gone)).otherwise(F.col("tags"))}).drop("__list")


def backed_by_evidence(until, sources: list[str] | None = None) -> Column:
    """Some evidence row names a source of the event (and one of `sources`, if given) and was retrieved no later than five minutes after the clock."""
    known = lambda e: e["source_id"].isin(sources) if sources is not None else F.lit(True)
    return _false(F.exists("evidence", lambda e: F.array_contains(F.col("source_ids"), e["source_id"]) & known(e) & (e["retrieved_at"] <= _ts(until) + F.expr("INTERVAL 5 MINUTES"))))


# --- quarantine, search, views, projections ---------------------------------------------------------------------


def validate_batch(df: DataFrame, now, source_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with `reasons`)."""
    now = _ts(now)
    late = lambda c, tolerance: _false(F.col(c) > now + F.expr(f"INTERVAL {tolerance}"))
    rules = {
        "future_source_clock": late("source_updated_at", "1 DAY") | late("issued_at", "1 DAY"),
        "future_quake": (F.col("category") == "earthquake") & late("occurred_start", "1 HOUR"),
        "wrong_source": F.col("source_id") != source_id if source_id else F.lit(False),
        "bad_withdrawal": _false(has_tag("tags", "withdraw_only_if_known") & (F.col("lifecycle_status") != "withdrawn")),
        "no_title": F.col("title").isNull() | (F.trim("title") == ""),
        "no_record_id": F.col("provider_record_id").isNull(),
    }
    out = df.withColumn("reasons", F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items()))))
    return out.where(F.size("reasons") == 0).drop("reasons"), out.where(F.size("reasons") > 0)


def citable(df: DataFrame, url: str = "source_urls") -> DataFrame:
    """Rows with an id, a title and at least one safe link; `links` holds those."""
    links = F.array_compact(F.transform(url, lambda u: safe_url(u)))
    return df.withColumn("links", F.array_distinct(links)).where(F.col("id").isNotNull() & (F.trim("title") != "") & (F.size("links") > 0))


def search_column(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """`search` holds title, description, country codes and source ids; country and source names too where given."""
    parts = [F.col(c) for c in ("title", "description") if c in df.columns] + [F.array_join(c, " ") for c in ("countries", "source_ids") if c in df.columns]
    if names is None:
        return df.withColumn("search", F.concat_ws(" ", *parts))
    table = F.broadcast(names.agg(F.map_from_entries(F.collect_list(F.struct("code", "name"))).alias("__names")))
    named = [F.array_join(F.transform(c, lambda x: F.coalesce(F.try_element_at("__names", x), x)), " ") for c in ("countries", "source_ids") if c in df.columns]
    return df.crossJoin(table).withColumn("search", F.concat_ws(" ", *parts, *named)).drop("__names")


def search_events(df: DataFrame, text: str, names: DataFrame | None = None) -> DataFrame:
    return search_column(df, names).where(contains_words("search", search_words(text))).drop("search")


def filter_view(df: DataFrame, ids: DataFrame | None = None, category: str | None = None, source: str | None = None) -> DataFrame:
    """ids: a table; an empty one gives nothing, none at all gives everything."""
    if ids is not None:
        df = df.join(ids.select("id").distinct(), "id", "left_semi")
    if category:
        df = df.where(F.col("category") == category)
    return df.where(F.array_contains("source_ids", source)) if source else df


def filter_snapshot(df: DataFrame, query: EventQuery, generated_at: datetime, source_id: str | None = None) -> DataFrame:
    """The same contract at a snapshot's clock."""
    since, until = window_bounds(query, generated_at)
    out = filter_attrs(filter_time(df, query.time_basis, since, until), query)
    if query.country:
        out = filter_country(out, query.country)
    if source_id:
        out = out.where(F.array_contains("source_ids", source_id))
    inactive = query.include_inactive if query.include_inactive is not None else inactive_by_default(query.time_basis)
    return out if inactive else filter_active(out, generated_at)


def coverage_warnings(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("enabled") & ~F.col("status").isin("ok", "ok_empty"))


def allowlisted(df: DataFrame, source: str) -> Column:
    """Which raw entries of a feed are in its allowlist."""
    if source == "cisa_kev":
        return F.col("record_id").rlike(r"^CVE-\d{4}-\d{4,}$")
    if source == "nasa_eonet":
        return F.arrays_overlap("category_ids", F.array(*map(F.lit, ("severeStorms", "volcanoes", "wildfires", "floods", "landslides", "dustHaze", "tempExtremes"))))
    return F.exists("categories", lambda c: fold(c).isin("uzytkownicy", "users", "user"))


def summarize(df: DataFrame, now) -> DataFrame:
    out = effective_state(df, now).withColumns({"severity_label": label("severity", SEVERITY_LABELS), "source_count": F.size("source_ids")})
    return out.drop(*(c for c in ("raw", "normalized") if c in out.columns))


def sanitize(df: DataFrame, id_map: DataFrame) -> DataFrame:
    """Public rows: public ids, no raw and no revisions, private links removed, relations to unpublished events dropped."""
    ids = id_map.select("id", "public_id")
    out = df.drop("raw", "revisions", "normalized").join(ids, "id").withColumn("source_url", F.when(is_public_url("source_url"), F.col("source_url")))
    if "relations" not in df.columns:
        return out.drop("id").withColumnRenamed("public_id", "id")
    targets = out.select("id", F.explode("relations").alias("r")).select("id", F.col("r.other").alias("other"), "r")
    known = targets.join(ids.select(F.col("id").alias("other"), F.col("public_id").alias("public_other")), "other")
    known = known.groupBy("id").agg(F.array_sort(F.collect_list(F.col("r").withField("other", F.col("public_other")))).alias("relations"))
    return out.drop("relations").join(known, "id", "left").drop("id").withColumnRenamed("public_id", "id")


def facts(df: DataFrame) -> DataFrame:
    """Typed facts of events: every clock with no more digits than it has, state, independence and links."""
    day = F.when(has_tag("tags", DAY_TAG), F.lit("day")).otherwise(F.lit("second"))
    return df.select(
        "id", "title", "category", "severity", "lifecycle_status", "independent_source_count", (F.col("change_type") == "initial_import").alias("first_import"),
        display_time("occurred_start", "time_precision").alias("occurred"), display_time("issued_at", day).alias("published"), display_time("valid_from", F.lit("minute")).alias("valid_from"),
        display_time("valid_to", day, exclusive_end=False).alias("valid_to"), norm_array("source_urls").alias("links"),
    )


def run_queries(queries: DataFrame, events: DataFrame, now, most: int = 2000) -> DataFrame:
    """(query_id, id) matches of a table of queries on all four bases: one pass over the events.

    The query table is counted, and broadcast only within `most` rows; beyond that events meet the days of windows by
    their first day, and the first days of windows by tree nodes of the days they hold, two a level at most: a validity
    period without an end has a logarithm of rows. region, lat, lon and radius_km are read where the query table has them.
    """
    q = query_bounds(queries, now)
    optional = {"region": "string", "lat": "double", "lon": "double", "radius_km": "double"}
    q = q.withColumns({c: F.lit(None).cast(k) for c, k in optional.items() if c not in q.columns})
    geometry = "geometry" in events.columns
    period = lambda b: F.col("valid_to") if b == "validity" else F.lit(None).cast("timestamp")
    clocks = F.array(*(F.struct(F.lit(b).alias("time_basis"), F.col(c).alias("clock"), period(b).alias("end")) for b, c in BASIS_CLOCK.items()))
    ev = events.select("id", "category", "severity", "independent_source_count", "countries", "lifecycle_status", "valid_to", "tags", *(("geometry", "location_precision") if geometry else ()), F.explode(clocks).alias("c")).select("*", "c.time_basis", "c.clock", "c.end").drop("c").where("clock is not null")
    by_day, valid = has_tag("tags", DAY_TAG) & (F.col("time_basis") == "published"), F.col("time_basis") == "validity"
    ev = ev.withColumn("from", F.when(by_day, F.date_trunc("day", "clock")).otherwise(F.col("clock"))).withColumn("to", F.when(by_day, F.date_trunc("day", "clock") + F.expr(_DAY)).when(valid, F.col("end")).otherwise(F.col("clock")))
    ev = ev.where(~valid | F.col("to").isNull() | (F.col("to") > F.col("from")))
    # points match since <= t < until, days and periods by overlap; a period without an end is open
    overlap = (F.col("from") < F.col("until")) & (F.col("to").isNull() | (F.col("to") > F.col("since")))
    hit = F.when(by_day | valid, overlap).otherwise((F.col("from") >= F.col("since")) & (F.col("from") < F.col("until")))
    q = q.select("query_id", F.col("time_basis").alias("q_basis"), "since", "until", F.col("category").alias("q_category"), "country", "severity_min", "min_sources", F.coalesce("include_inactive", F.col("time_basis") != "occurred").alias("inactive"), *optional)
    active = ~F.col("lifecycle_status").isin("expired", "withdrawn") & (F.col("valid_to").isNull() | (F.col("valid_to") > _ts(now)))
    near = within_radius(F.col("lat"), F.col("lon"), F.col("radius_km")) if geometry else F.lit(False)
    rest = (
        (F.col("q_category").isNull() | (F.col("q_category") == F.col("category"))) & (F.col("country").isNull() | F.array_contains("countries", F.col("country")))
        & (F.col("severity") >= F.coalesce("severity_min", F.lit(0))) & (F.col("independent_source_count") >= F.coalesce("min_sources", F.lit(1))) & (F.col("inactive") | active)
        & (~F.col("region").eqNullSafe("europe") | in_europe(geometry)) & (F.col("radius_km").isNull() | near)
    )
    if q.limit(most + 1).count() <= most:  # each event has one row a basis, so a pair comes once
        return ev.join(F.broadcast(q), (F.col("time_basis") == F.col("q_basis")) & hit & rest).select("query_id", "id")
    # a pair meets once: the event begins on a day of the window, or holds the window's first day and began before it
    low, high = q.agg(F.unix_date(F.to_date(F.min("since"))), F.unix_date(F.to_date(F.max("since")))).first()
    day = lambda c: F.unix_date(F.to_date(c))
    days = q.withColumn("q_day", F.explode(F.sequence(F.to_date("since"), F.to_date("until"))))
    begun = ev.withColumn("day", F.to_date("from")).join(days, (F.col("day") == F.col("q_day")) & (F.col("time_basis") == F.col("q_basis")))
    levels = (high - low).bit_length()
    held = tree_cover(F.greatest(day("from") + 1 - low, F.lit(0)), F.least(F.coalesce(day("to"), F.lit(high)), F.lit(high)) + 1 - low, levels)
    nodes = ev.where(F.col("to").isNull() | (day("to") > day("from"))).withColumn("at", F.explode(held))
    starts = q.withColumn("q_at", F.explode(tree_path(day("since") - low, levels)))
    running = nodes.join(starts, (F.col("at") == F.col("q_at")) & (F.col("time_basis") == F.col("q_basis")))
    return begun.where(hit & rest).select("query_id", "id").unionByName(running.where(hit & rest).select("query_id", "id"))
