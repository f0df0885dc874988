"""Counts, coverage and extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.arrays import has_tag
from eventlens.functions.geo import lon_ranges, mercator_pixel, positions
from eventlens.operators.filters import _ts, advisory_state
from eventlens.schemas import CATEGORIES, DEFAULT_BASIS


def result_counts(df: DataFrame, limit: int) -> DataFrame:
    """total, shown, mapped, unlocated, truncated in one pass."""
    mapped = F.count_if(F.col("location_precision").isin("point", "area", "country"))
    return df.agg(F.count("*").alias("total"), F.least(F.count("*"), F.lit(limit)).alias("shown"), mapped.alias("mapped"), (F.count("*") - mapped).alias("unlocated"), (F.count("*") > limit).alias("truncated"))


def background_count(df: DataFrame, is_background: Column) -> DataFrame:
    return df.agg(F.count_if(is_background).alias("background"))


def category_counts(df: DataFrame) -> DataFrame:
    """Every category with its basis, zeros included."""
    names = df.sparkSession.createDataFrame([(c, DEFAULT_BASIS[c]) for c in CATEGORIES], "category string, basis string")
    return F.broadcast(names).join(df.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", "basis", F.coalesce("n", F.lit(0)).alias("n"))


def kind_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def advisory_counts(df: DataFrame, until) -> DataFrame:
    s = advisory_state(until)
    return df.where("kind = 'advisory'").agg(*(F.count_if(s == x).alias(x) for x in ("active", "upcoming", "expired", "withdrawn", "unknown")))


def unknown_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("span").isNull()).alias("unknown_time"), F.count_if(F.size("countries") <= 0).alias("unknown_country"), F.count_if(has_tag("tags", "cached_public_data")).alias("cached"))


def bin_hours(window_hours: int) -> int:
    return 1 if window_hours <= 24 else 3 if window_hours <= 72 else 6 if window_hours <= 168 else 24


def bins_of(span: Column, since: Column, until: Column, hours: Column, last: Column) -> tuple[Column, Column]:
    """(first, final) number of the bins of so many hours that a span meets which lies in the window or reaches into it."""
    us, width = F.unix_micros(since), hours.cast("long") * F.lit(3_600_000_000)
    stop = F.least(F.coalesce(span["end"], until), until)
    start = F.floor((F.unix_micros(span["start"]) - us) / width)
    final = F.when(span["point"], start).otherwise(F.floor((F.unix_micros(stop) - us - 1) / width))
    return F.greatest(start, F.lit(0)).cast("int"), F.least(final, last).cast("int")


def timeline(df: DataFrame, since, window_hours: int, until=None) -> DataFrame:
    """Counts per bin, in total and per basis; an event counts in each bin it meets, open ends run to the window's end.

    Needs `span` and `basis`. Bins are found by arithmetic, so nothing is joined.
    """
    h = bin_hours(window_hours)
    since = _ts(since)
    end = _ts(until) if until is not None else since + F.make_interval(hours=F.lit(window_hours))
    last = -(-window_hours // h) - 1
    s = F.col("span")
    stop = F.least(F.coalesce(s["end"], end), end)
    first, final = bins_of(s, since, end, F.lit(h), F.lit(last))
    inside = F.when(s["point"], (s["start"] >= since) & (s["start"] < end)).otherwise((s["start"] < end) & (stop > since))
    bins = df.where(s.isNotNull() & inside).select("basis", F.explode(F.sequence(first, final)).alias("bin"))
    out = bins.groupBy("bin").agg(F.count("*").alias("n"), *(F.count_if(F.col("basis") == b).alias(f"n_{b}") for b in ("occurred", "published", "validity")))
    start = since + F.make_interval(hours=F.col("bin") * h)
    return out.select("bin", start.alias("bin_start"), F.least(start + F.make_interval(hours=F.lit(h)), end).alias("bin_end"), "n", "n_occurred", "n_published", "n_validity")


def source_coverage(events: DataFrame, registry: DataFrame, reported: DataFrame) -> DataFrame:
    """Every expected source, even a missing one: records, cached ones, state."""
    per = events.select(F.explode(F.array_distinct("source_ids")).alias("source_id"), has_tag("tags", "cached_public_data").alias("cached")).groupBy("source_id").agg(F.count("*").alias("records"), F.count_if("cached").alias("cached"))
    out = registry.select("source_id").join(reported.select("source_id", "status"), "source_id", "left").join(per, "source_id", "left")
    out = out.withColumns({"records": F.coalesce("records", F.lit(0)), "cached": F.coalesce("cached", F.lit(0))})
    state = F.when(F.col("status").isNull(), "missing").when((F.col("status") == "ok") & (F.col("records") > 0), "healthy").when(F.col("status").isin("ok", "ok_empty"), "empty").otherwise("incomplete")
    return out.withColumn("state", state)


def source_overview(sources: DataFrame) -> DataFrame:
    active, ok = F.count_if("enabled"), F.count_if(F.col("enabled") & F.col("status").isin("ok", "ok_empty"))
    return sources.agg(active.alias("active"), ok.alias("responding"), F.when(active == 0, "none").when(ok == active, "all").when(ok == 0, "down").otherwise("partial").alias("state"))


def source_health(state: DataFrame, now) -> DataFrame:
    """status at a clock: `stale` where the last success is older than three polls and two minutes."""
    age = F.unix_timestamp(_ts(now)) - F.unix_timestamp("last_success_at")
    late = F.col("enabled") & F.col("status").isin("ok", "ok_empty") & F.coalesce(age > 3 * F.col("poll_seconds") + 120, F.lit(True))
    return state.withColumns({"age_seconds": age, "status": F.when(late, "stale").otherwise(F.col("status"))})


def source_warnings(registry: DataFrame, sources: DataFrame, clock) -> DataFrame:
    """Reason codes per expected source: missing, disabled, bad state, no success, clock ahead, late."""
    clock = _ts(clock)
    s = registry.select("source_id", "poll_seconds").join(sources.select("source_id", "enabled", "status", "last_success_at"), "source_id", "left")
    age = F.unix_timestamp(clock) - F.unix_timestamp("last_success_at")
    missing = F.col("enabled").isNull()
    codes = {
        "missing": missing, "disabled": ~missing & ~F.col("enabled"), "state": ~missing & ~F.col("status").isin("ok", "ok_empty"), "no_success": ~missing & F.col("last_success_at").isNull(),
        "clock_ahead": age < -300, "late": age > F.greatest(F.lit(3 * 3600), 3 * F.col("poll_seconds")),
    }
    return s.select("source_id", F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in codes.items()))).alias("reasons"))


def batch_stats(norm: DataFrame, quarantine: DataFrame, now) -> DataFrame:
    """Per source: distinct records, newest accepted content up to now, rejected rows and their first 100 reasons."""
    clock = F.greatest("source_updated_at", "issued_at", "occurred_start")
    good = norm.groupBy("source_id").agg(F.count_distinct("provider_record_id").alias("records"), F.max(F.when(clock <= _ts(now), clock)).alias("newest_content_at"))
    bad = quarantine.groupBy("source_id").agg(F.count("*").alias("rejected"), F.slice(F.array_sort(F.collect_set("reason")), 1, 100).alias("reasons"))
    return good.join(bad, "source_id", "full_outer").withColumns({"records": F.coalesce("records", F.lit(0)), "rejected": F.coalesce("rejected", F.lit(0)), "reasons": F.coalesce("reasons", F.array().cast("array<string>"))})


def feed_metadata(norm: DataFrame) -> DataFrame:
    """Per source: rows seen, distinct events, revisions beyond the first, updates without a link, provider clock."""
    return norm.groupBy("source_id").agg(
        F.count("*").alias("seen"), F.count_distinct("provider_record_id").alias("events"), (F.count("*") - F.count_distinct("provider_record_id")).alias("revisions"),
        F.count_if(has_tag("tags", "unresolved_source_reference")).alias("unlinked"), F.max("source_snapshot_at").alias("provider_clock"),
    )


def briefing_counts(df: DataFrame) -> DataFrame:
    """processed = historical + uncitable + citable; needs briefing_group and is_citable."""
    old = F.col("briefing_group") == "historical"
    return df.agg(F.count("*").alias("processed"), F.count_if(old).alias("historical"), F.count_if(~old & ~F.col("is_citable")).alias("uncitable"), F.count_if(~old & F.col("is_citable")).alias("citable"))


def group_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("briefing_group").agg(F.count("*").alias("n"))


def evidence_range() -> list[Column]:
    at = F.transform("evidence", lambda e: e["retrieved_at"])
    return [F.array_min(at).alias("oldest"), F.array_max(at).alias("newest")]


def geometry_coverage(df: DataFrame) -> DataFrame:
    g = F.col("geometry")
    points, areas = F.coalesce(F.size(g["points"]) > 0, F.lit(False)), F.coalesce(F.size(g["rings"]) > 0, F.lit(False))
    return df.agg(F.count_if(points).alias("points"), F.count_if(areas & ~points).alias("areas_only"), F.count_if(~points & ~areas).alias("unlocated"))


def present_values(df: DataFrame) -> DataFrame:
    return df.select(F.lit("category").alias("what"), F.col("category").alias("value")).union(df.select(F.lit("country"), F.explode("countries"))).distinct()


def extent(df: DataFrame) -> DataFrame:
    """Bounding box of all positions, and its span in web-mercator pixels at zoom 0."""
    p = df.select(F.explode(positions("geometry")).alias("p")).agg(F.min("p.lon").alias("w"), F.min("p.lat").alias("s"), F.max("p.lon").alias("e"), F.max("p.lat").alias("n"))
    a, b = mercator_pixel(F.col("w"), F.col("n"), 0), mercator_pixel(F.col("e"), F.col("s"), 0)
    return p.withColumn("span", F.greatest(b["x"] - a["x"], b["y"] - a["y"]))


def merged_ranges(ranges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Overlapping [lo, hi] rows joined into one each. Distinct rounded ranges first, so the window stays small."""
    by = by or []
    part = Window.partitionBy(*by).orderBy("lo", "hi")
    before = F.max("hi").over(part.rowsBetween(Window.unboundedPreceding, -1))
    out = ranges.select(*by, "lo", "hi").distinct().withColumn("new", F.coalesce((F.col("lo") > before).cast("int"), F.lit(1)))
    out = out.withColumn("run", F.sum("new").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*by, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def extent_globe(df: DataFrame, digits: int = 3) -> DataFrame:
    """Shortest longitude range that holds everything, across the dateline if need be: all but the widest gap.

    Longitudes are rounded outward to `digits`, which bounds the rows of the window to 360,000 whatever the input.
    """
    step = 10.0**digits
    r = df.select(F.explode(lon_ranges("geometry")).alias("r")).select((F.floor(F.col("r.lo") * step) / step).alias("lo"), (F.ceil(F.col("r.hi") * step) / step).alias("hi"))
    r = r.groupBy("lo").agg(F.max("hi").alias("hi"))
    m = merged_ranges(r.withColumn("all", F.lit(1)), ["all"])
    order = Window.partitionBy("all").orderBy("lo")
    whole = Window.partitionBy("all")
    nxt = F.coalesce(F.lead("lo").over(order), F.min("lo").over(whole) + 360)
    gap = m.withColumns({"next": nxt, "gap": nxt - F.col("hi")})
    return gap.agg(F.max(F.struct("gap", "next", "hi")).alias("g")).select(F.col("g.next").alias("west"), F.when(F.col("g.hi") < F.col("g.next"), F.col("g.hi") + 360).otherwise(F.col("g.hi")).alias("east"), F.col("g.gap").alias("gap"))


def country_extent(boundaries: DataFrame, events: DataFrame, iso2: str) -> DataFrame:
    """Extent of a country: its boundary, else its records, else the world."""
    one = extent(boundaries.where(F.col("iso2") == iso2)).select(F.struct("w", "s", "e", "n").alias("a"), F.col("w").isNotNull().alias("has_a"))
    two = extent(events.where(F.array_contains("countries", iso2))).select(F.struct("w", "s", "e", "n").alias("b"), F.col("w").isNotNull().alias("has_b"))
    world = F.struct(F.lit(-180.0).alias("w"), F.lit(-85.0).alias("s"), F.lit(180.0).alias("e"), F.lit(85.0).alias("n"))
    return one.crossJoin(two).select(F.when(F.col("has_a"), F.col("a")).when(F.col("has_b"), F.col("b")).otherwise(world).alias("x")).select("x.*")


def cluster_points(df: DataFrame, zoom: int, radius: int = 48, max_zoom: int = 12) -> DataFrame:
    """Counts and mean positions per pixel cell: a grid approximation of map clustering; single rows beyond max_zoom."""
    p = df.select("id", F.explode("geometry.points").alias("p")).select("id", "p.lon", "p.lat")
    if zoom > max_zoom:
        return p.select(F.lit(1).cast("long").alias("n"), "lon", "lat", F.col("id").alias("sample_id"))
    px = mercator_pixel(F.col("lon"), F.col("lat"), zoom)
    cell = p.withColumns({"cx": F.floor(px["x"] / radius), "cy": F.floor(px["y"] / radius)})
    return cell.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.min("id").alias("sample_id"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def omitted_by_sources(df: DataFrame, min_sources: int) -> DataFrame:
    return df.agg(F.count_if(F.col("independent_source_count") < min_sources).alias("omitted"))


def limitation_codes(df: DataFrame, limit: int, bad_sources: Column | bool = False) -> DataFrame:
    """Ordered codes that qualify a result."""
    bad = bad_sources if isinstance(bad_sources, Column) else F.lit(bad_sources)
    codes = [
        F.when(F.count("*") > limit, F.lit("truncated")), F.when(F.count_if(F.col("occurred_start").isNull()) > 0, F.lit("unknown_time")), F.when(F.count_if(F.size("countries") <= 0) > 0, F.lit("unknown_country")),
        F.when(F.count_if(F.col("independent_source_count") < 2) > 0, F.lit("single_source")), F.when(F.count_if(F.col("category") == "cyber") > 0, F.lit("publication_is_not_occurrence")), F.when(bad, F.lit("source_health")),
    ]
    return df.agg(F.array_distinct(F.array_compact(F.array(*codes))).alias("limitations"))


def run_stats(runs: DataFrame) -> DataFrame:
    """Runs, success rate and rejected share per source and day, with totals by grouping sets."""
    per = runs.withColumn("day", F.to_date("started_at")).groupingSets([["source_id", "day"], ["source_id"], []], "source_id", "day")
    return per.agg(F.count("*").alias("runs"), F.avg((F.col("status").isin("ok", "ok_empty")).cast("double")).alias("success_rate"), (F.sum("rejected") / F.greatest(F.sum(F.col("accepted") + F.col("rejected")), F.lit(1))).alias("rejected_share"), F.grouping_id().alias("level"))


def publication_status(sources: DataFrame) -> DataFrame:
    """One row: whether a snapshot may be published; partial sources without rows count as errors, repeats are counted."""
    status = F.when((F.col("status") == "partial") & (F.col("record_count") == 0), "error").otherwise(F.col("status"))
    s = sources.withColumn("status", status)
    return s.agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "error").alias("errors"), (F.count("*") - F.count_distinct("source_id")).alias("repeated"), (F.count_if(F.col("status") != "error") > 0).alias("publishable"))
