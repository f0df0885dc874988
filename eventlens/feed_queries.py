"""Registered queries of the feed normalizers: documents written from the driver's `events`, one a row, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.queries import NOW, ev, query
from eventlens.sources import feeds

def documents(rows: DataFrame, source: str, body: Column, url: Column | None = None) -> DataFrame:
    """One raw document a row, dealt to tasks by number: a few bytes of a table become a whole document, and reading it is the work."""
    rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "n")
    link = F.concat(F.lit("https://feed.example.org/"), F.col("n").cast("string")) if url is None else url
    return rows.select(F.lit(source).alias("source_id"), link.alias("url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("content_type"), F.lit(NOW).cast("timestamp").alias("fetched_at"), F.lit(False).alias("not_modified"), body.alias("body"))


def _shown(batch: feeds.Batch, clock: str, more: Column) -> DataFrame:
    """Accepted and rejected records in one table."""
    events, bad = batch
    none = F.lit(None)
    good = events.select(F.col("provider_record_id").alias("record"), none.cast("string").alias("reason"), "severity", F.col("lifecycle_status").alias("state"), F.unix_timestamp(clock).alias("clock"), F.array_join("external_ids", ",").alias("keys"), more.alias("more"))
    return good.unionByName(bad.select(F.col("record_id").alias("record"), "reason", none.cast("int").alias("severity"), none.cast("string").alias("state"), none.cast("long").alias("clock"), none.cast("string").alias("keys"), none.cast("string").alias("more")))


def _iso(c: str = "ts") -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _pick(xs: list, by: int, shift: int = 0) -> Column:
    return F.element_at(F.array(*map(F.lit, xs)), (1 + (F.col("n") + shift) % by).cast("int"))


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


_N = "n::VARCHAR"


def _tags() -> Column:
    return F.array_join("tags", ",")



def _sql(reason: str, record: str, severity: str, state: str, clock: str, keys: str, more: str, source: str = "ev", bad_record: str | None = None) -> str:
    """The same table in SQL: rejected rows show their reason and record alone."""
    return f"""WITH d AS (SELECT *, {reason} AS reason FROM {source}) SELECT CASE WHEN reason IS NULL THEN {record} ELSE {bad_record or record} END AS record, reason, CASE WHEN reason IS NULL THEN ({severity})::INT END AS severity, CASE WHEN reason IS NULL THEN {state} END AS state,
CASE WHEN reason IS NULL THEN epoch({clock})::BIGINT END AS clock, CASE WHEN reason IS NULL THEN {keys} END AS keys, CASE WHEN reason IS NULL THEN {more} END AS more FROM d"""


_SEC = "date_trunc('second', ts)"
_QUAKE = "CASE WHEN value * 0.05 > 15 OR value * 0.05 < -5 THEN 0 WHEN value * 0.05 >= 7 THEN 4 WHEN value * 0.05 >= 5.5 THEN 3 WHEN value * 0.05 >= 4 THEN 2 ELSE 1 END"


@query(_sql("CASE WHEN n % 17 = 0 THEN 'bad_id' WHEN n % 19 = 0 THEN 'bad_type' END", "'q' || n", f"CASE WHEN n % 10 = 0 THEN 0 ELSE {_QUAKE} END", "CASE WHEN n % 10 = 0 THEN 'withdrawn' ELSE 'active' END", _SEC, "'usgs:alt' || provider_record_id || ',usgs:q' || n", "CASE WHEN n % 10 = 0 THEN 'instantaneous_event,withdraw_only_if_known' ELSE 'instantaneous_event,magnitude_not_damage' END", bad_record="CASE WHEN n % 17 <> 0 THEN 'q' || n END"))
def s03_s05_quakes(spark, sf_dir):
    """Quake feeds: bad ids and types are rejected, other event types withdraw."""
    return _shown(feeds.normalize_usgs(quake_documents(ev(spark, sf_dir))), "occurred_start", _tags())


def quake_documents(e: DataFrame) -> DataFrame:
    n, u = F.col("n").cast("string"), F.col("provider_record_id")
    kind = F.when(F.col("n") % 19 == 0, "").when(F.col("n") % 10 == 0, "quarry blast").otherwise("earthquake")
    ms = (F.unix_timestamp("ts") * 1000).cast("string")
    p = F.struct((F.col("value") * 0.05).alias("mag"), F.lit("Somewhere").alias("place"), ms.alias("time"), ms.alias("updated"), _text(",q", n, ",alt", u, ",").alias("ids"), F.lit("us").alias("net"), kind.alias("type"))
    g = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    rid = F.when(F.col("n") % 17 == 0, _text("bad id ", n)).otherwise(_text("q", n))
    f = F.struct(F.lit("Feature").alias("type"), rid.alias("id"), p.alias("properties"), g.alias("geometry"))
    body = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.struct(F.lit(1).alias("count")).alias("metadata"), F.array(f).alias("features")))
    return documents(e, "usgs", body)


@query(_sql("CASE WHEN n % 7 = 0 THEN 'bad_cve' WHEN nth = 2 THEN 'duplicate_cve' END", "'CVE-2024-' || lpad(n::VARCHAR, 7, '0')", "0", "'active'", "date_trunc('day', ts)", "'cve:CVE-2024-' || lpad(n::VARCHAR, 7, '0')", "'catalog_date_added,date_only_utc_anchor,no_incident_location,not_an_attack_report' || CASE WHEN n % 4 = 0 THEN ',ransomware_use_reported' ELSE '' END",
       "(SELECT ev.*, unnest(range(1, CASE WHEN n % 5 = 0 THEN 3 ELSE 2 END)) AS nth FROM ev)", "CASE WHEN n % 7 = 0 THEN 'CVE-' || n ELSE 'CVE-2024-' || lpad(n::VARCHAR, 7, '0') END"))
def s11_vulnerabilities(spark, sf_dir):
    """Catalogs of exploited vulnerabilities: a day of publication, repeats within a document rejected."""
    e, n = ev(spark, sf_dir), F.col("n").cast("string")
    cve = F.when(F.col("n") % 7 == 0, _text("cve-", n)).otherwise(_text("CVE-2024-", F.lpad(n, 7, "0")))
    v = F.struct(cve.alias("cveID"), _text("Flaw ", n).alias("vulnerabilityName"), F.date_format("ts", "yyyy-MM-dd").alias("dateAdded"), F.when(F.col("n") % 4 == 0, "Known").otherwise("Unknown").alias("knownRansomwareCampaignUse"))
    body = F.to_json(F.struct(F.lit("1").alias("catalogVersion"), _iso().alias("dateReleased"), F.lit(1).alias("count"), F.when(F.col("n") % 5 == 0, F.array(v, v)).otherwise(F.array(v)).alias("vulnerabilities")))
    return _shown(feeds.normalize_kev(documents(e, "cisa_kev", body)), "issued_at", _tags())


_END = "date_trunc('day', ts) + to_days((n % 40)::INT) + INTERVAL 1 DAY"


@query(_sql("CASE WHEN n % 23 = 0 THEN 'no_title' END", _N, "0", f"CASE WHEN n % 6 = 0 THEN 'withdrawn' WHEN {_END} <= TIMESTAMP '2024-01-31' THEN 'expired' WHEN n % 6 = 1 THEN 'unknown' ELSE 'active' END", _END, "'easa:czib:' || n", "'DE,PL'"))
def s10_bulletins(spark, sf_dir):
    """Aviation bulletins: the named last day is still valid, so the exclusive end is the next midnight."""
    e, n = ev(spark, sf_dir), F.col("n").cast("string")
    end = F.date_format(F.date_add(F.to_date("ts"), (F.col("n") % 40).cast("int")), "dd/MM/yyyy")
    status = F.when(F.col("n") % 6 == 0, "Withdrawn").when(F.col("n") % 6 == 1, "Draft").otherwise("Active")
    z = F.struct(n.alias("Nid"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("issued_date"), end.alias("valid_until_date"), F.when(F.col("n") % 23 == 0, " ").otherwise(_text("Zone ", n)).alias("name"), status.alias("status"), F.lit("pl, DE; X").alias("country"))
    body = F.to_json(F.struct(F.array(z).alias("conflict_zones")))
    return _shown(feeds.normalize_easa(documents(e, "easa_czib", body)), "valid_to", F.array_join("countries", ","))


@query(_sql("CASE WHEN n % 13 = 0 THEN 'bad_id' END", "'s' || n", "[1, 2, 3, 4, 0][1 + n % 5]", "['expired', 'active', 'active', 'unknown'][1 + n % 4]", _SEC, "'github_status:s' || n", "'Second, Other'", bad_record="'S-' || n"))
def s17_status_pages(spark, sf_dir):
    """Incidents of a status page: impact ladder, state, the last entry of a component id wins."""
    e, n = ev(spark, sf_dir), F.col("n").cast("string")
    part = lambda i, x: F.struct(F.lit(i).alias("id"), F.lit(x).alias("name"))
    rid = F.when(F.col("n") % 13 == 0, _text("S-", n)).otherwise(_text("s", n))
    i = F.struct(rid.alias("id"), _text("Trouble ", n).alias("name"), _pick(["resolved", "investigating", "monitoring", "odd"], 4).alias("status"), _pick(["none", "minor", "major", "critical", "huge"], 5).alias("impact"), _iso().alias("started_at"), _iso().alias("created_at"), _iso().alias("updated_at"), F.array(part("c1", "First"), part("c2", "Other"), part("c1", "Second"), part("BAD", "x")).alias("components"))
    return _shown(feeds.normalize_status(documents(e, "github_status", F.to_json(F.struct(F.array(i).alias("incidents")))), "github_status"), "occurred_start", F.col("description"))


@query(_sql("CASE WHEN n % 11 = 0 THEN 'unknown_type' WHEN nth = 2 THEN 'repeated_on_later_page' END", "'r' || n", "0", f"CASE WHEN n % 3 = 0 THEN 'expired' WHEN {_SEC} <= TIMESTAMP '2024-01-31' THEN 'active' ELSE 'unknown' END", _SEC, "'cloudflare:outage:r' || n", "CASE WHEN n % 2 = 0 THEN 'incident' ELSE 'measurement' END", "(SELECT ev.*, unnest(range(1, CASE WHEN n % 5 = 0 THEN 3 ELSE 2 END)) AS nth FROM ev)"))
def s19_outages(spark, sf_dir):
    """Outage pages: an id that a later page repeats is rejected there."""
    e = ev(spark, sf_dir).withColumn("page", F.explode(F.when(F.col("n") % 5 == 0, F.array(F.lit(0), F.lit(100))).otherwise(F.array(F.lit(100)))))
    kind = F.when(F.col("n") % 11 == 0, "OTHER").when(F.col("n") % 2 == 0, "outage").otherwise("ANOMALY")
    end = F.when(F.col("n") % 3 == 0, _iso())
    a = F.struct(_text("r", F.col("n").cast("string")).alias("id"), kind.alias("eventType"), _iso().alias("startDate"), end.alias("endDate"), F.array(F.lit("pl"), F.lit("X1")).alias("locations"), F.lit("net").alias("scope"))
    body = F.to_json(F.struct(F.struct(F.array(a).alias("annotations")).alias("result"), F.lit(True).alias("success")))
    url = _text("https://feed.example.org/?d=", F.col("n").cast("string"), "&offset=", F.col("page").cast("string"))
    return _shown(feeds.normalize_radar(documents(e, "cloudflare_radar", body, url)), "occurred_start", F.col("kind"))


@query(_sql("CASE WHEN n % 7 = 0 THEN 'category' WHEN ts < TIMESTAMP '2024-01-01' AND n % 3 <> 0 THEN 'outside_window' END", "'EONET_' || n", "0", "CASE WHEN n % 3 = 0 THEN 'expired' ELSE 'active' END", _SEC, "'eonet:EONET_' || n || CASE WHEN n % 2 = 0 THEN ',usgs:us' || n ELSE '' END", "CASE WHEN n % 2 = 0 THEN 'usgs' ELSE 'unknown:eonet' END"))
def s14_natural_events(spark, sf_dir):
    """Natural events: allowed categories, hard ids from source links, closed means expired."""
    e, n = ev(spark, sf_dir), F.col("n").cast("string")
    g = F.array(F.struct(_iso().alias("date"), F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    link = F.struct(F.lit("USGS_EHP").alias("id"), _text("https://earthquake.usgs.gov/earthquakes/eventpage/us", n).alias("url"))
    x = F.struct(_text("EONET_", n).alias("id"), _text("Event ", n).alias("title"), F.when(F.col("n") % 3 == 0, F.lit("2024-01-30T00:00:00Z")).alias("closed"), F.array(F.struct(F.when(F.col("n") % 7 == 0, "snow").otherwise("volcanoes").alias("id"))).alias("categories"), F.when(F.col("n") % 2 == 0, F.array(link)).otherwise(F.array()).alias("sources"), g.alias("geometry"))
    body = F.to_json(F.struct(F.array(x).alias("events")))
    return _shown(feeds.normalize_eonet(documents(e, "nasa_eonet", body)), "occurred_start", F.array_join("origins", ","))


_MIN = "date_trunc('minute', ts)"


def _bulletin_id(shift: str = "ts", serial: str = "n") -> str:
    return f"'WARK04:' || ({serial}) || ':' || strftime({shift}, '%Y%m%dT%H%MZ')"


@query(_sql("CASE WHEN n % 13 = 0 THEN 'code_or_serial' WHEN date_trunc('minute', ts) < TIMESTAMP '2024-01-01' THEN 'outside_window' WHEN n % 17 = 0 THEN 'validity' END", _bulletin_id(), "0",
       f"CASE WHEN n % 5 = 0 THEN 'withdrawn' WHEN {_MIN} + INTERVAL 6 HOURS <= TIMESTAMP '2024-01-31' THEN 'expired' WHEN {_MIN} + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-31' THEN 'active' ELSE 'unknown' END", _MIN,
       f"CASE WHEN n % 3 = 0 THEN array_to_string(list_sort(['swpc:' || {_bulletin_id()}, 'swpc:' || {_bulletin_id('ts - INTERVAL 2 HOURS', 'n + 1')}]), ',') ELSE 'swpc:' || {_bulletin_id()} END",
       "CASE WHEN n % 5 = 0 THEN 'forecast,source_cancellation,swpc_bulletin,unlocated_space_weather' ELSE 'forecast,swpc_bulletin,unlocated_space_weather' END", bad_record=f"CASE WHEN n % 13 = 0 THEN 'WARK04:x:' || strftime(ts, '%Y%m%dT%H%MZ') ELSE {_bulletin_id()} END"))
def s15_s16_d03_bulletins(spark, sf_dir):
    """Space-weather bulletins: fields of the message text, references with an explicit original time become keys."""
    e, n = ev(spark, sf_dir), F.col("n").cast("string")
    at = lambda hours: F.date_format(F.date_trunc("minute", "ts") + F.make_interval(hours=hours), "yyyy MMM dd HHmm 'UTC'")
    head = F.when(F.col("n") % 5 == 0, "CANCEL WARNING: Geomagnetic K-index of 4").otherwise("WARNING: Geomagnetic K-index of 4")
    ref = F.when(F.col("n") % 3 == 0, _text("Extension to Serial Number: ", (F.col("n") + 1).cast("string"), "\nOriginal Issue Time: ", at(F.lit(-2)), "\n")).otherwise("")
    message = _text("Space Weather Message Code: WARK04\nSerial Number: ", F.when(F.col("n") % 13 == 0, "x").otherwise(n), "\nIssue Time: ", at(F.lit(0)), "\n\n", head, "\n", ref, "Valid From: ", at(F.lit(1)), "\nValid To: ", F.when(F.col("n") % 17 == 0, at(F.lit(0))).otherwise(at(F.lit(6))), "\n")
    body = F.to_json(F.array(F.struct(F.lit("K04W").alias("product_id"), message.alias("message"))))
    events, bad = feeds.normalize_swpc(documents(e, "noaa_swpc", body))
    return _shown((feeds.resolve_swpc_refs(events), bad), "issued_at", _tags())


@query(_sql("CASE WHEN n % 5 = 0 THEN 'category' WHEN n % 7 = 0 THEN 'guid_disagrees' END", "'2024/' || n", "0", "'unknown'", _SEC, "'cert_pl:2024/' || n", "'end_user_notice,no_incident_location,publication_index,validity_unknown'"))
def s04_s18_notices(spark, sf_dir):
    """Notices of an RSS index: allowed categories, link and guid of one article."""
    e, n = ev(spark, sf_dir), F.col("n").cast("string")
    link = _text("https://moje.cert.pl/komunikaty/2024/", n, "/")
    guid = F.when(F.col("n") % 7 == 0, "https://moje.cert.pl/komunikaty/2024/1x/").otherwise(link)
    item = _text("<item><title>t</title><link>", link, "</link><pubDate>", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), " +0000</pubDate><guid>", guid, "</guid><category>", F.when(F.col("n") % 5 == 0, "firms").otherwise("users"), "</category><category>x</category></item>")
    body = _text('<?xml version="1.0"?><rss><channel><title>c</title><link>https://moje.cert.pl/</link>', item, "</channel></rss>")
    return _shown(feeds.normalize_cert(documents(e, "cert_pl", body)), "issued_at", _tags())


@query(_sql("CASE WHEN n % 11 = 0 THEN 'unconfirmed' WHEN n % 13 = 0 THEN 'bad_degree' END", "(n + 1)::VARCHAR", "[2, 3, 4, 0][1 + n % 4]", f"CASE WHEN n % 6 = 0 THEN 'withdrawn' WHEN n % 5 = 0 THEN 'active' WHEN {_SEC} + INTERVAL 12 HOURS <= TIMESTAMP '2024-01-31' THEN 'expired' ELSE 'active' END", _SEC, "'imgw:hydro:' || (n + 1)", "CASE WHEN n % 5 = 0 THEN 'open' ELSE epoch(date_trunc('second', ts) + INTERVAL 12 HOURS)::BIGINT::VARCHAR END", "(SELECT * FROM ev WHERE ts < TIMESTAMP '2024-01-31')"))
def s12_s13_hydro(spark, sf_dir):
    """Hydrological warnings with a clock before the read: degrees, flags, until revoked; exact repeats collapse."""
    e = ev(spark, sf_dir).where("ts < timestamp '2024-01-31'")
    no = F.lit(False)
    open_ = F.col("n") % 5 == 0
    w = F.struct((F.col("n") + 1).alias("id"), F.lit(1).alias("number"), F.when(F.col("n") % 13 != 0, _pick([1, 2, 3, -1], 4)).alias("degree"), _iso().alias("releaseDate"), _iso().alias("dateFrom"), F.when(open_, "9999-12-31T00:00:00Z").otherwise(F.date_format(F.col("ts") + F.expr("INTERVAL 12 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("dateTo"),
                 F.lit("Flood").alias("eventDescription"), F.lit("River").alias("areaDescription"), F.lit(True).alias("statusIsCurrent"), (F.col("n") % 6 == 0).alias("isDelete"), open_.alias("isUntilRevoke"), (F.col("n") % 11 == 0).alias("statusIsToConfirm"), no.alias("statusIsPast"))
    events, bad = feeds.normalize_hydro(documents(e, "imgw_hydro", F.to_json(F.array(w, w))))
    kept, clash = feeds.hydro_batch(events)
    return _shown((kept, bad.unionByName(clash).dropDuplicates(["record_id", "reason"])), "valid_from", F.coalesce(F.unix_timestamp("valid_to").cast("string"), F.lit("open")))


@query(_sql("CASE WHEN n % 13 = 0 THEN 'bad_id' END", "['EQ', 'TC', 'WF'][1 + n % 3] || ':' || n", "[1, 2, 3, 4][1 + n % 4]", "CASE WHEN n % 2 = 0 THEN 'active' ELSE 'unknown' END", _SEC, "'gdacs:' || ['EQ', 'TC', 'WF'][1 + n % 3] || ':' || n", "CASE WHEN n % 3 = 0 THEN 'earthquake' ELSE 'disaster' END || '/' || CASE WHEN n % 3 = 0 THEN 'point' ELSE 'area' END || '/' || CASE WHEN n % 3 = 2 THEN 'nasa:firms' ELSE 'unknown:gdacs' END", bad_record="['EQ', 'TC', 'WF'][1 + n % 3] || ':x' || n"))
def s06_disasters(spark, sf_dir):
    """Disaster items: kind and number make the record, alert level the severity, the current flag the state."""
    e, n = ev(spark, sf_dir), F.col("n").cast("string")
    rfc = _text(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), " GMT")
    tag = lambda name, x: _text(f"<gdacs:{name}>", x, f"</gdacs:{name}>")
    item = _text("<item><title>Event ", n, "</title><link>https://x.example.org/</link>", tag("eventtype", _pick(["EQ", "TC", "WF"], 3)), tag("eventid", F.when(F.col("n") % 13 == 0, _text("x", n)).otherwise(n)), tag("episodeid", "1"), tag("version", "1"),
                 tag("fromdate", rfc), tag("datemodified", rfc), tag("iscurrent", F.when(F.col("n") % 2 == 0, "true").otherwise("false")), tag("alertlevel", _pick(["Green", "Yellow", "Orange", "Red"], 4)), "<georss:point>", F.col("lat").cast("string"), " ", F.col("lon").cast("string"), "</georss:point></item>")
    body = _text('<rss xmlns:gdacs="http://www.gdacs.org" xmlns:georss="http://www.georss.org/georss"><channel><pubDate>', rfc, "</pubDate>", item, "</channel></rss>")
    return _shown(feeds.normalize_gdacs(documents(e, "gdacs", body)), "occurred_start", F.concat_ws("/", "category", "location_precision", F.array_join("origins", ",")))


_CAP_REASON = "CASE WHEN n % 11 = 0 THEN 'not_operational' WHEN n % 13 = 0 THEN 'message_type' END"


@query(_sql(_CAP_REASON, "'id' || n", "[1, 2, 3, 4][1 + n % 4]", f"CASE WHEN n % 5 = 0 THEN 'withdrawn' WHEN {_SEC} + INTERVAL 6 HOURS <= TIMESTAMP '2024-01-31' THEN 'expired' WHEN {_SEC} <= TIMESTAMP '2024-01-31' THEN 'active' ELSE 'unknown' END", _SEC, "'cap:s' || n % 3 || ':id' || n",
       "CASE WHEN n % 5 = 0 THEN 'id' || (n + 3) ELSE '' END || '/' || CASE WHEN n % 2 = 0 THEN 'Strong wind' ELSE 'Wiatr' END || '/' || CASE WHEN n % 2 = 0 THEN '5' ELSE '0' END"))
def s07_s09_warnings(spark, sf_dir):
    """CAP warnings: one language, references of the same sender, polygons; merged, one row an identifier."""
    e, n = ev(spark, sf_dir), F.col("n").cast("string")
    sender, at = _text("s", (F.col("n") % 3).cast("string")), lambda h: F.date_format(F.date_trunc("second", "ts") + F.make_interval(hours=F.lit(h)), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    info = lambda lang, headline, area: _text("<info><language>", lang, "</language><event>wind</event><severity>", _pick(["Minor", "Moderate", "Severe", "Extreme"], 4), "</severity><effective>", at(0), "</effective><expires>", at(6), "</expires><headline>", headline, "</headline><area><areaDesc>a</areaDesc>", area, "</area></info>")
    ring = "<polygon>50,10 50,11 51,11 51,10 50,10</polygon>"
    infos = _text(info("pl-PL", "Wiatr", ""), F.when(F.col("n") % 2 == 0, info("en-GB", "Strong wind", ring)).otherwise(""))
    kind = F.when(F.col("n") % 13 == 0, "Error").when(F.col("n") % 5 == 0, "Cancel").otherwise("Alert")
    refs = F.when(F.col("n") % 5 == 0, _text("<references>", sender, ",id", (F.col("n") + 3).cast("string"), ",", at(0), " other,idx,", at(0), "</references>")).otherwise("")
    body = _text('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>id', n, "</identifier><sender>", sender, "</sender><sent>", at(0), "</sent><status>", F.when(F.col("n") % 11 == 0, "Test").otherwise("Actual"), "</status><msgType>", kind, "</msgType><scope>Public</scope>", refs, infos, "</alert>")
    events, bad = feeds.normalize_cap(documents(e, "meteoalarm", body), "DE")
    one, other = feeds.merge_cap(events)
    more = F.concat_ws("/", F.array_join("supersedes", ","), F.col("title"), F.coalesce(F.size(F.flatten("geometry.rings")), F.lit(0)).cast("string"))
    return _shown((one, bad.unionByName(other)), "valid_from", more)
