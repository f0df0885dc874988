"""Feed normalization: raw documents to (events, quarantine). Each feed is one declarative job over all its documents.

A bad record is routed to the quarantine with a reason code; a bad document never counts as an empty feed. `now` is
the fetch clock of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.arrays import norm_array
from eventlens.functions.geo import ring_valid
from eventlens.functions.severity import severity_from_alert, severity_from_cap, severity_from_degree, severity_from_impact, severity_from_magnitude
from eventlens.functions.text import identifier, plain, required_title, safe_url
from eventlens.functions.time import DAY_TAG, epoch_ms, parse_bulletin_ts, parse_ts
from eventlens.schemas import EVENT_COLUMNS, GEOMETRY
from eventlens.sources.documents import decode_json_feed, decode_xml_feed
from eventlens.sources.lineage import cut, once

Batch = tuple[DataFrame, DataFrame]


def _tags(*parts: Column | str) -> Column:
    return norm_array(F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def _when(on: Column, tag: str) -> Column:
    return F.when(on, F.lit(tag))


def _point(lon: Column, lat: Column) -> Column:
    """A Point struct; null off the globe or where a coordinate is missing."""
    x, y = lon.try_cast("double"), lat.try_cast("double")
    none = F.array().cast("array<array<struct<lon:double,lat:double>>>")
    g = F.struct(F.lit("Point").alias("type"), F.array(F.struct(x.alias("lon"), y.alias("lat"))).alias("points"), none.alias("rings"))
    return F.when(x.between(-180, 180) & y.between(-90, 90), g)


def _area(rings: Column) -> Column:
    none = F.array().cast("array<struct<lon:double,lat:double>>")
    return F.when(F.size(rings) > 0, F.struct(F.when(F.size(rings) == 1, "Polygon").otherwise("MultiPolygon").alias("type"), none.alias("points"), rings.alias("rings")))


def _finish(rows: DataFrame, source: str, columns: dict, reason: Column, keep: tuple[str, ...] = ()) -> Batch:
    """Events with the contract's columns, and the quarantine."""
    raw = columns.get("raw", F.col("raw"))
    columns = {"source_id": F.lit(source), "raw": raw, "raw_hash": F.sha2(raw, 256), "lifecycle_status": F.lit("unknown"), "location_precision": F.lit("unknown"), "severity": F.lit(0)} | columns
    out = rows.withColumn("__reason", reason)
    selected = [(columns[c] if c in columns else F.lit(None)).cast(GEOMETRY if c == "geometry" else kind).alias(c) for c, kind in EVENT_COLUMNS.items()]
    lists = ("countries", "origins", "external_ids", "supersedes", "tags")
    events = out.where("__reason is null").select(*selected, *keep).withColumns({c: norm_array(c) for c in lists})
    bad = out.where("__reason is not null").select(F.lit(source).alias("source_id"), "url", columns["provider_record_id"].cast("string").alias("record_id"), F.col("__reason").alias("reason"), F.col("raw"))
    return events, bad


def _failed(failed: DataFrame) -> DataFrame:
    return failed.select("source_id", "url", F.lit(None).cast("string").alias("record_id"), "reason", F.lit(None).cast("string").alias("raw"))


def dedupe_feed(df: DataFrame, key: str, payload: str = "raw_hash") -> Batch:
    """Identical repeats collapse; a key with different payloads loses all of them."""
    w = Window.partitionBy(key)
    marked = df.where(F.col(key).isNotNull()).withColumns({"__least": F.min(payload).over(w), "__most": F.max(payload).over(w)})
    one = marked.where("__least = __most").drop("__least", "__most").dropDuplicates([key, payload])
    return one, marked.where("__least <> __most").drop("__least", "__most")


def normalize_usgs(docs: DataFrame) -> Batch:
    """Quakes. Records that are no earthquake any more become withdrawals that apply to known events only."""
    element = "struct<type:string,id:string,properties:struct<mag:double,place:string,time:string,updated:string,url:string,status:string,net:string,ids:string,sources:string,magType:string,type:string,title:string>,geometry:struct<type:string,coordinates:array<double>>>"
    rec, failed = decode_json_feed(docs, "usgs", element, "features", "type:string,metadata:struct<generated:string,count:int>")
    p, g = F.col("rec.properties"), F.col("rec.geometry")
    rid, other = identifier("rec.id"), F.lower(F.trim(p["type"])) != "earthquake"
    other = F.coalesce(other, F.lit(False))
    ids = F.filter(F.transform(F.split(F.coalesce(p["ids"], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Za-z0-9._-]{1,128}$"))
    nets = F.filter(F.when(p["net"].isNotNull(), F.array(p["net"])).otherwise(F.split(F.coalesce(p["sources"], F.lit("")), ",")), lambda x: F.trim(x).rlike(r"^[A-Za-z0-9_-]{1,24}$"))
    origins = F.transform(nets, lambda x: F.concat(F.lit("usgs:"), F.lower(F.trim(x))))
    geometry = F.when(g["type"] == "Point", _point(F.get(g["coordinates"], 0), F.get(g["coordinates"], 1)))
    title = F.coalesce(required_title(p["title"]), F.concat(F.lit("Earthquake: "), F.coalesce(plain(p["place"], 700), rid)))
    time = epoch_ms(p["time"])
    columns = {
        "provider_record_id": rid, "kind": F.lit("incident"), "category": F.lit("earthquake"), "title": F.when(other, F.concat(F.lit("Withdrawn report: "), rid)).otherwise(title),
        "description": plain(p["place"]), "source_url": safe_url(p["url"], F.concat(F.lit("https://earthquake.usgs.gov/earthquakes/eventpage/"), rid)), "occurred_start": time, "occurred_end": time,
        "source_updated_at": epoch_ms(p["updated"]), "geometry": geometry, "location_precision": F.when(geometry.isNotNull(), "point").otherwise("unknown"), "time_precision": F.when(time.isNotNull(), "second").otherwise("unknown"),
        "severity": F.when(other, 0).otherwise(severity_from_magnitude(p["mag"])), "original_severity": F.when(other, p["type"]).otherwise(F.when(p["mag"].isNotNull(), F.trim(F.concat_ws(" ", F.lit("M"), p["mag"].cast("string"), p["magType"])))),
        "severity_reason": F.lit("magnitude"), "verification_status": F.when(other, "reclassified").otherwise(F.coalesce(p["status"], F.lit("reported"))), "lifecycle_status": F.when(other, "withdrawn").otherwise("active"),
        "origins": F.when(F.size(origins) > 0, origins).otherwise(F.array(F.lit("usgs"))), "external_ids": F.transform(F.array_union(F.array(rid), ids), lambda x: F.concat(F.lit("usgs:"), x)),
        "tags": F.when(other, _tags("withdraw_only_if_known", "instantaneous_event")).otherwise(_tags("magnitude_not_damage", "instantaneous_event")),
    }
    reason = F.when(F.col("rec.type") != "Feature", "not_a_feature").when(p.isNull(), "no_properties").when(~F.coalesce(rid.rlike(r"^[A-Za-z0-9._-]{1,128}$"), F.lit(False)), "bad_id").when(F.trim(p["type"]) == "", "bad_type")
    events, bad = _finish(rec, "usgs", columns, reason)
    return events, bad.unionByName(_failed(failed))


def normalize_kev(docs: DataFrame) -> Batch:
    """Exploited vulnerabilities: a day of publication, no occurrence; a CVE that comes twice in a document is rejected after its first row."""
    element = "struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,dateAdded:string,shortDescription:string,requiredAction:string,dueDate:string,knownRansomwareCampaignUse:string,notes:string,cwes:array<string>>"
    rec, failed = decode_json_feed(docs, "cisa_kev", element, "vulnerabilities", "catalogVersion:string,dateReleased:string,count:int")
    cve = F.upper(identifier("rec.cveID"))
    rec = rec.withColumn("cve", cve).withColumn("nth", F.row_number().over(Window.partitionBy("url", "fetched_at", "cve").orderBy("index")))
    added, released = parse_ts("rec.dateAdded", date_only=True), parse_ts(F.col("env.dateReleased"))
    columns = {
        "provider_record_id": F.col("cve"), "kind": F.lit("publication"), "category": F.lit("cyber"), "title": F.coalesce(required_title("rec.vulnerabilityName"), F.col("cve")),
        "description": F.concat_ws(" ", plain("rec.shortDescription"), plain("rec.requiredAction")), "source_url": F.lit("https://www.cisa.gov/known-exploited-vulnerabilities-catalog"), "issued_at": added["ts"], "time_precision": added["precision"],
        "lifecycle_status": F.lit("active"), "verification_status": F.lit("catalogued"), "origins": F.array(F.lit("cisa")), "external_ids": F.array(F.concat(F.lit("cve:"), F.col("cve"))),
        "tags": _tags("catalog_date_added", "not_an_attack_report", "no_incident_location", _when(added["precision"] == "day", DAY_TAG), _when(F.lower("rec.knownRansomwareCampaignUse") == "known", "ransomware_use_reported")),
        "source_snapshot_at": F.when(released["precision"] == "second", released["ts"]),
    }
    reason = F.when(~F.coalesce(F.col("cve").rlike(r"^CVE-\d{4}-\d{4,}$"), F.lit(False)), "bad_cve").when(F.col("nth") > 1, "duplicate_cve")
    events, bad = _finish(rec, "cisa_kev", columns, reason)
    return events, bad.unionByName(_failed(failed))


def catalog_warnings(docs: DataFrame) -> DataFrame:
    """Per catalog document: whether its declared count and clock hold."""
    env = F.from_json("body", "struct<count:int,dateReleased:string,vulnerabilities:array<struct<cveID:string>>>")
    rows = docs.where("source_id = 'cisa_kev'").select("url", "fetched_at", env.alias("e"))
    return rows.select("url", "fetched_at", (F.col("e.count") != F.size("e.vulnerabilities")).alias("count_mismatch"), (parse_ts("e.dateReleased")["precision"] != "second").alias("clock_unusable"))


def normalize_easa(docs: DataFrame) -> Batch:
    """Aviation bulletins: issue and end are calendar days of the text; the named end day is still valid."""
    element = "struct<Nid:string,issued_date:string,valid_until_date:string,field_easa_valid_until_descr:string,name:string,status:string,country:string,coordinates:string,updated:string>"
    rec, failed = decode_json_feed(docs, "easa_czib", element, "conflict_zones")
    nid = identifier("rec.Nid")
    rec = rec.withColumn("nid", nid).withColumn("nth", F.row_number().over(Window.partitionBy("url", "fetched_at", "nid").orderBy("index")))
    issued = parse_ts(F.regexp_extract("rec.issued_date", r"^(\d{4}-\d{2}-\d{2})(?=T|$)", 1), date_only=True)["ts"]
    updated = parse_ts(F.coalesce(F.nullif(F.regexp_extract("rec.updated", r'datetime="([^"]+)"', 1), F.lit("")), F.col("rec.updated")))["ts"]
    end = parse_ts("rec.valid_until_date", date_only=True, day_first=True)["ts"] + F.expr("INTERVAL 1 DAY")
    status = F.lower(plain("rec.status", 80))
    state = F.when(status.isin("withdrawn", "cancelled", "canceled"), "withdrawn").when(status.isin("expired", "inactive") | (end <= F.col("fetched_at")), "expired").when(status == "active", "active").otherwise("unknown")
    countries = F.transform(F.split(F.coalesce("rec.country", F.lit("")), r"\s*[,;]\s*"), F.upper)
    codes = F.filter(countries, lambda x: x.rlike("^[A-Z]{2}$"))
    columns = {
        "provider_record_id": F.col("nid"), "kind": F.lit("advisory"), "category": F.lit("aviation"), "title": required_title("rec.name"), "description": plain("rec.field_easa_valid_until_descr"),
        "source_url": F.concat(F.lit("https://www.easa.europa.eu/en/node/"), F.col("nid")), "issued_at": issued, "source_updated_at": updated, "valid_from": issued, "valid_to": end, "countries": codes,
        "location_precision": F.when(F.size(codes) > 0, "country").otherwise("unknown"), "time_precision": F.when(issued.isNotNull() | end.isNotNull(), "day").otherwise("unknown"), "lifecycle_status": state,
        "verification_status": F.lit("official_advisory"), "origins": F.array(F.lit("easa")), "external_ids": F.array(F.concat(F.lit("easa:czib:"), F.col("nid"))),
        "tags": _tags("country_not_fir_boundary", _when(issued.isNotNull() | end.isNotNull(), DAY_TAG), _when(end.isNotNull(), "valid_to_exclusive_day_boundary"), _when(F.col("rec.coordinates") != "", "provider_reference_point_not_used")),
    }
    reason = F.when(~F.coalesce(F.col("nid").rlike("^[0-9]+$"), F.lit(False)), "bad_id").when(F.col("nth") > 1, "duplicate_id").when(required_title("rec.name").isNull(), "no_title")
    events, bad = _finish(rec, "easa_czib", columns, reason)
    return events, bad.unionByName(_failed(failed))


def normalize_status(docs: DataFrame, source: str) -> Batch:
    """Incidents of an operator's status page; only the identity and name of components are kept."""
    element = "struct<id:string,name:string,status:string,impact:string,started_at:string,created_at:string,updated_at:string,resolved_at:string,components:array<struct<id:string,name:string>>>"
    rec, failed = decode_json_feed(docs, source, element, "incidents")
    rec = rec.withColumn("nth", F.row_number().over(Window.partitionBy("url", "fetched_at", "rec.id").orderBy("index")))
    start, end = parse_ts("rec.started_at"), parse_ts("rec.resolved_at")["ts"]
    end = F.when(~F.coalesce(end < start["ts"], F.lit(False)), end)
    status, origin = F.col("rec.status"), source.removesuffix("_status")
    good = F.filter("rec.components", lambda c: c["id"].rlike("^[a-z0-9]{1,64}$") & (F.trim(c["name"]) != ""))
    # the last entry of an id wins, in order of ids
    parts = F.array_sort(F.filter(good, lambda c, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda d: d["id"] == c["id"])))
    impact = F.when(F.col("rec.impact").isin("none", "minor", "major", "critical"), F.col("rec.impact"))
    raw = F.to_json(F.struct("rec.id", "rec.name", "rec.status", impact.alias("impact"), "rec.started_at", "rec.created_at", "rec.updated_at", "rec.resolved_at", parts.alias("components")))
    columns = {
        "provider_record_id": F.col("rec.id"), "kind": F.lit("incident"), "category": F.lit("internet"), "title": required_title("rec.name"), "description": F.concat_ws(", ", F.transform(parts, lambda c: c["name"])),
        "source_url": F.concat(F.lit("https://www.githubstatus.com/incidents/" if origin == "github" else "https://www.cloudflarestatus.com/incidents/"), F.col("rec.id")), "occurred_start": start["ts"], "occurred_end": end,
        "issued_at": parse_ts("rec.created_at")["ts"], "source_updated_at": parse_ts("rec.updated_at")["ts"], "time_precision": start["precision"],
        "lifecycle_status": F.when(status.isin("resolved", "postmortem"), "expired").when(status.isin("investigating", "identified", "monitoring"), "active").otherwise("unknown"),
        "severity": severity_from_impact(impact), "original_severity": impact, "verification_status": F.lit(f"reported_by_{origin}"), "origins": F.array(F.lit(origin)),
        "external_ids": F.array(F.concat(F.lit(f"{source}:"), F.col("rec.id"))), "tags": _tags("operator_reported_service_incident", "no_incident_location", "status_metadata_only"), "raw": raw,
    }
    reason = F.when(~F.coalesce(F.col("rec.id").rlike("^[a-z0-9]{1,64}$"), F.lit(False)), "bad_id").when(F.col("nth") > 1, "duplicate_id").when(required_title("rec.name").isNull(), "no_title")
    events, bad = _finish(rec, source, columns, reason)
    return events, bad.unionByName(_failed(failed))


def normalize_radar(docs: DataFrame) -> Batch:
    """Outage annotations over pages: the first page of an id wins."""
    element = "struct<id:string,eventType:string,startDate:string,endDate:string,locations:array<string>,scope:string,description:string,outage:struct<outageCause:string,outageType:string>,asns:array<int>,origins:array<string>,linkedUrl:string>"
    rec, failed = decode_json_feed(docs, "cloudflare_radar", element, "result.annotations", "success:boolean")
    page = F.coalesce(F.regexp_extract("url", r"[?&]offset=(\d+)", 1).try_cast("int"), F.lit(0))
    rid, kind = identifier("rec.id"), F.upper(plain("rec.eventType", 60))
    start, end = parse_ts("rec.startDate"), parse_ts("rec.endDate")["ts"]
    end = F.when(~F.coalesce(end < start["ts"], F.lit(False)), end)
    codes = F.filter(F.transform("rec.locations", F.upper), lambda x: x.rlike("^[A-Z]{2}$"))
    columns = {
        "provider_record_id": rid, "kind": F.when(kind == "OUTAGE", "incident").otherwise("measurement"), "category": F.lit("internet"),
        "title": F.substring(F.concat_ws(": ", F.when(kind == "OUTAGE", "Internet outage").otherwise("Traffic anomaly"), F.coalesce(plain("rec.scope", 300), F.nullif(F.array_join(codes, ", "), F.lit("")))), 1, 800),
        "description": plain("rec.description"), "source_url": F.lit("https://radar.cloudflare.com/outage-center"), "occurred_start": start["ts"], "occurred_end": end, "time_precision": start["precision"], "countries": codes,
        "location_precision": F.when(F.size(codes) > 0, "country").otherwise("unknown"), "lifecycle_status": F.when(end <= F.col("fetched_at"), "expired").when(start["ts"] <= F.col("fetched_at"), "active").otherwise("unknown"),
        "verification_status": F.lit("reported_by_cloudflare"), "origins": F.array(F.lit("cloudflare")), "external_ids": F.array(F.concat(F.lit("cloudflare:outage:"), rid)),
        "tags": _tags("cloudflare_visibility_only", F.concat(F.lit("reported_type:"), F.lower(kind)), _when(kind == "ANOMALY", "anomaly_is_not_an_outage"), _when(F.col("rec.outage.outageCause") != "", "cause_is_provider_attribution")),
    }
    rec = rec.withColumn("page", page).withColumn("nth", F.row_number().over(Window.partitionBy("rec.id").orderBy("page", "index")))
    reason = F.when(rid.isNull(), "bad_id").when(~F.coalesce(kind.isin("OUTAGE", "ANOMALY"), F.lit(False)), "unknown_type").when(F.col("nth") > 1, "repeated_on_later_page")
    events, bad = _finish(rec, "cloudflare_radar", columns, reason)
    return events, bad.unionByName(_failed(failed))


def radar_pages(docs: DataFrame, page_size: int = 100, most_pages: int = 5) -> DataFrame:
    """Whether a paged read is partial (a page without new ids) or truncated (all pages full)."""
    rec, _ = decode_json_feed(docs, "cloudflare_radar", "struct<id:string>", "result.annotations")
    page = F.coalesce(F.regexp_extract("url", r"[?&]offset=(\d+)", 1).try_cast("int"), F.lit(0))
    rows = rec.withColumn("page", page).withColumn("new", F.row_number().over(Window.partitionBy("rec.id").orderBy("page", "index")) == 1)
    per = rows.groupBy("page").agg(F.count("*").alias("n"), F.count_if("new").alias("new"))
    return per.agg(F.coalesce(F.bool_or((F.col("new") == 0) & (F.col("n") >= page_size)), F.lit(False)).alias("partial"), ((F.count("*") >= most_pages) & F.coalesce(F.min("n") >= page_size, F.lit(False))).alias("truncated"))


_RSS_ITEM = "title string, description string, link string, pubDate string, `gdacs:dateadded` string, `gdacs:datemodified` string, `gdacs:iscurrent` string, `gdacs:fromdate` string, `gdacs:todate` string, `gdacs:eventtype` string, `gdacs:eventid` string, `gdacs:episodeid` string, `gdacs:version` string, `gdacs:alertlevel` string, `gdacs:iso3` string, `gdacs:country` string, `gdacs:glide` string, `geo:Point` struct<`geo:lat`:string,`geo:long`:string>, `georss:point` string, `gdacs:resources` struct<`gdacs:resource`:array<struct<_source:string,_url:string>>>"


def normalize_gdacs(docs: DataFrame) -> Batch:
    """Disasters: episodes are revisions of type:eventid; the republisher is not an origin of its own."""
    fields = ",".join(f"{name}:{kind}" for name, kind in (x.split(" ", 1) for x in _RSS_ITEM.split(", ")))
    xml, failed = decode_xml_feed(docs, "gdacs", "rss", f"channel struct<pubDate:string,item:array<struct<{fields}>>>")
    rec = xml.select("url", "fetched_at", "xml.channel.pubDate", F.posexplode("xml.channel.item").alias("index", "rec")).withColumn("raw", F.to_json("rec"))
    g = lambda name: F.col(f"rec.`gdacs:{name}`")
    rec = once(rec, {"eventtype": F.upper(identifier(g("eventtype"))), "number": identifier(g("eventid")), "start": parse_ts(g("fromdate")), "end": parse_ts(g("todate"))["ts"], "updated": parse_ts(g("datemodified"))["ts"], "pair": F.split(F.trim(F.col("rec.`georss:point`")), r"\s+")})
    kind, number, start, end, updated, pair = (F.col(c) for c in ("eventtype", "number", "start", "end", "updated", "pair"))
    rid = F.concat(kind, F.lit(":"), number)
    end = F.when(~F.coalesce(end < start["ts"], F.lit(False)), end)
    geometry = F.coalesce(_point(F.col("rec.`geo:Point`.`geo:long`"), F.col("rec.`geo:Point`.`geo:lat`")), _point(F.get(pair, 1), F.get(pair, 0)))
    links = F.coalesce(F.transform(F.col("rec.`gdacs:resources`.`gdacs:resource`"), lambda r: r["_url"]), F.array().cast("array<string>"))
    upstream = F.array_compact(F.transform(F.array_append(links, F.col("rec.link")), lambda u: F.nullif(F.regexp_extract(u, r"^https?://earthquake\.usgs\.gov/(?:earthquakes/eventpage/|fdsnws/event/[^?]*\?(?:[^#]*&)?eventid=)([A-Za-z0-9._-]{1,128})", 1), F.lit(""))))
    named = F.transform(F.col("rec.`gdacs:resources`.`gdacs:resource`"), lambda r: F.lower(F.trim(r["_source"])))
    named = F.transform(F.coalesce(named, F.array().cast("array<string>")), lambda s: F.when(s.isin("usgs", "u.s. geological survey"), "usgs").when(s.isin("emsc", "emsc/csem", "emsc-csem"), "emsc"))
    origins = norm_array(F.concat(named, F.array(_when(kind == "WF", "nasa:firms"), _when(F.size(upstream) > 0, "usgs"))))
    glide, current = F.trim(g("glide")), F.lower(F.trim(g("iscurrent"))) == "true"
    daily = kind.isin("WF", "DR", "FL") & (start["ts"] == F.date_trunc("day", start["ts"]))
    daily = F.coalesce(daily, F.lit(False))
    codes = F.filter(F.split(F.upper(F.concat_ws(",", g("iso3"), g("country"))), r"[,;\s]+"), lambda x: x.rlike("^[A-Z]{2}$"))
    columns = {
        "provider_record_id": rid, "kind": F.lit("incident"), "category": F.when(kind == "EQ", "earthquake").otherwise("disaster"), "title": required_title("rec.title"), "description": plain("rec.description"),
        "source_url": safe_url("rec.link", F.concat(F.lit("https://www.gdacs.org/report.aspx?eventtype="), kind, F.lit("&eventid="), number)), "occurred_start": start["ts"], "occurred_end": end,
        "issued_at": parse_ts(F.coalesce(g("dateadded"), F.col("rec.pubDate")))["ts"], "source_updated_at": updated, "countries": codes, "geometry": geometry,
        "location_precision": F.when(geometry.isNotNull(), F.when(kind == "EQ", "point").otherwise("area")).when(F.size(codes) > 0, "country").otherwise("unknown"), "time_precision": F.when(daily, "day").otherwise(start["precision"]),
        "severity": severity_from_alert(g("alertlevel")), "original_severity": g("alertlevel"), "lifecycle_status": F.when(current, "active").otherwise("unknown"), "verification_status": F.lit("modelled_impact"),
        "origins": F.when(F.size(origins) > 0, origins).otherwise(F.array(F.lit("unknown:gdacs"))),
        "external_ids": F.concat(F.array(F.concat(F.lit("gdacs:"), rid)), F.transform(upstream, lambda x: F.concat(F.lit("usgs:"), x)), F.array(F.when(glide.rlike(r"^[A-Z]{2}-\d{4}-\d{6}-[A-Z]{3}$"), F.concat(F.lit("glide:"), glide)))),
        "tags": _tags("gdacs_impact_model", F.concat(F.lit("gdacs_type:"), kind), _when((kind != "EQ") & geometry.isNotNull(), "representative_point_not_extent"), _when(kind == "WF", "derived_from_firms"), _when(daily, "daily_event_bounds")),
        "is_current": current, "episode_id": g("episodeid"), "source_snapshot_at": F.lit(None),
    }
    reason = F.when(~F.coalesce(kind.rlike("^[A-Z]{2,3}$"), F.lit(False)), "bad_type").when(~F.coalesce(number.rlike("^[0-9]+$"), F.lit(False)), "bad_id").when(required_title("rec.title").isNull(), "no_title")
    rec = rec.withColumn("__revision", F.struct(g("version").alias("v"), g("episodeid").alias("e"), updated.alias("u")))
    events, bad = _finish(rec, "gdacs", columns, reason, keep=("__revision",))
    return events.dropDuplicates(["provider_record_id", "__revision"]).drop("__revision"), bad.unionByName(_failed(failed))


_CAP_INFO = "struct<language:string,category:string,event:string,urgency:string,severity:string,certainty:string,effective:string,onset:string,expires:string,senderName:string,headline:string,description:string,instruction:string,area:array<struct<areaDesc:string,polygon:array<string>,circle:array<string>>>>"


def _of_language(prefix: str):
    return lambda x: F.lower(F.split(x, "-")[0]) == prefix


def normalize_cap(docs: DataFrame, country: str) -> Batch:
    """CAP 1.2 warnings: one language, references of the same sender, polygons from lat,lon text."""
    xml, failed = decode_xml_feed(docs, "meteoalarm", "alert", f"identifier string, sender string, sent string, status string, msgType string, scope string, references string, info array<{_CAP_INFO}>")
    rec = xml.select("url", "fetched_at", "body", F.col("xml").alias("rec"), F.to_json("xml").alias("raw"))
    rec = once(rec, {"rid": identifier("rec.identifier"), "from": identifier("rec.sender"), "infos": F.coalesce("rec.info", F.array().cast(f"array<{_CAP_INFO}>"))})
    rid, sender, kind, infos = F.col("rid"), F.col("from"), F.col("rec.msgType"), F.col("infos")
    language = lambda i: F.coalesce(F.trim(i["language"]), F.lit("unknown"))
    rec = once(rec, {"languages": F.array_distinct(F.transform(infos, language))})
    languages = F.col("languages")
    chosen = F.get(languages, 0)
    for prefix in ("en", "pl") if country == "PL" else ("en",):
        chosen = F.coalesce(F.get(F.filter(languages, _of_language(prefix)), 0), chosen)
    rec = once(rec, {"chosen": chosen})
    rec = once(rec, {"selected": F.filter(infos, lambda i: language(i) == F.col("chosen"))})
    s = F.col("selected")
    clock = lambda name: F.transform(s, lambda i: parse_ts(i[name])["ts"])
    rec = once(rec, {"sent": parse_ts("rec.sent"), "onset": F.array_min(F.array_compact(clock("onset"))), "effective": F.array_min(F.array_compact(clock("effective"))), "ends": clock("expires")})
    sent, onset, ends = F.col("sent"), F.col("onset"), F.col("ends")
    start = F.coalesce("effective", sent["ts"])
    end = F.when((F.size(s) > 0) & F.forall(ends, lambda x: x.isNotNull()), F.array_max(ends))
    rec = once(rec, {"until": F.when(~F.coalesce((end < start) | (end < onset), F.lit(False)), end)})
    end = F.col("until")
    refs = F.transform(F.split(F.trim(F.coalesce("rec.references", F.lit(""))), r"\s+"), lambda r: F.split(r, ","))
    refs = F.transform(F.filter(refs, lambda r: (F.size(r) == 3) & (F.get(r, 0) == sender)), lambda r: identifier(F.get(r, 1)))
    refs = F.filter(norm_array(refs), lambda r: r != rid)
    point = lambda p: F.struct(F.get(F.split(p, ","), 1).try_cast("double").alias("lon"), F.get(F.split(p, ","), 0).try_cast("double").alias("lat"))
    polygons = F.flatten(F.transform(F.flatten(F.transform(s, lambda i: F.coalesce(i["area"], F.array().cast("array<struct<areaDesc:string,polygon:array<string>,circle:array<string>>>")))), lambda a: F.coalesce(a["polygon"], F.array().cast("array<string>"))))
    rings = F.array_distinct(F.filter(F.transform(polygons, lambda p: F.transform(F.split(F.trim(p), r"\s+"), point)), ring_valid))
    update, now = kind.isin("Update", "Cancel"), F.col("fetched_at")
    state = F.when(kind == "Cancel", "withdrawn").when(end <= now, "expired").when(end.isNotNull() & (start <= now), "active").otherwise("unknown")
    titles = F.array_distinct(F.filter(F.transform(s, lambda i: F.trim(F.coalesce(F.nullif(F.trim(i["headline"]), F.lit("")), i["event"]))), lambda x: x != ""))
    texts = F.array_distinct(F.filter(F.flatten(F.transform(s, lambda i: F.array(F.trim(i["description"]), F.trim(i["instruction"])))), lambda x: x != ""))
    title = F.coalesce(F.nullif(F.substring(F.array_join(titles, " / "), 1, 800), F.lit("")), F.concat(F.when(kind == "Cancel", "Cancelled warning: ").otherwise("Warning: "), rid))
    original = F.array_join(norm_array(F.transform(s, lambda i: i["severity"])), ", ")
    columns = {
        "provider_record_id": rid, "kind": F.lit("advisory"), "category": F.lit("weather"), "title": plain(title, 800), "description": plain(F.array_join(texts, " ")), "source_url": safe_url("url"), "occurred_start": onset,
        "issued_at": sent["ts"], "source_updated_at": sent["ts"], "valid_from": start, "valid_to": end, "countries": F.array(F.lit(country)), "geometry": _area(rings), "location_precision": F.when(F.size(s) > 0, "area").otherwise("country"),
        "time_precision": sent["precision"], "severity": F.coalesce(F.array_max(F.transform(s, lambda i: severity_from_cap(i["severity"]))), F.lit(0)), "original_severity": F.nullif(original, F.lit("")), "lifecycle_status": state,
        "verification_status": F.lit("official_warning"), "origins": F.array(F.concat(F.lit("cap:"), F.lower(sender))), "external_ids": F.array(F.concat(F.lit("cap:"), sender, F.lit(":"), rid)), "supersedes": F.when(update, refs),
        "tags": _tags("cap", F.concat(F.lit("cap_message:"), F.lower(kind)), _when(onset > now, "hazard_onset_in_future"), _when(end.isNull() & (kind != "Cancel"), "expiry_not_known")), "sender": sender,
    }
    reason = F.when(rid.isNull() | sender.isNull(), "bad_id").when(~F.coalesce((F.col("rec.status") == "Actual") & (F.col("rec.scope") == "Public"), F.lit(False)), "not_operational").when(~F.coalesce(kind.isin("Alert", "Update", "Cancel"), F.lit(False)), "message_type").when((F.size(infos) == 0) & (kind != "Cancel"), "no_info")
    events, bad = _finish(rec, "meteoalarm", columns, reason, keep=("languages", "fetched_at"))
    return events, bad.unionByName(_failed(failed))


def cap_links(atom_docs: DataFrame, limit: int = 200, host: str = "feeds.meteoalarm.org") -> DataFrame:
    """Unique CAP links of Atom documents, on the approved host; `truncated` where a document holds more than the limit."""
    xml, _ = decode_xml_feed(atom_docs, "meteoalarm", "feed", "id string, updated string, entry array<struct<id:string,title:string,updated:string,link:array<struct<_type:string,_href:string>>>>")
    rows = xml.select("url", F.posexplode("xml.entry").alias("pos", "e")).select("url", "pos", F.explode("e.link").alias("l"))
    rows = rows.where((F.col("l._type") == "application/cap+xml") & (F.try_parse_url("l._href", F.lit("HOST")) == host) & F.col("l._href").startswith("https://"))
    rows = rows.groupBy("url", F.col("l._href").alias("href")).agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("url").orderBy("pos", "href")
    return rows.withColumns({"n": F.row_number().over(w), "truncated": F.count("*").over(Window.partitionBy("url")) > limit}).where(F.col("n") <= limit).select("url", "href", "n", "truncated")


def merge_cap(events: DataFrame) -> Batch:
    """One row per identifier: Polish first, then more languages, then the newest; rows of a second sender are rejected."""
    w = Window.partitionBy("provider_record_id")
    first = F.first("sender").over(w.orderBy("fetched_at", "source_url").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = events.withColumn("__first", first)
    polish = F.exists("languages", lambda x: F.lower(F.split(x, "-")[0]) == "pl")
    same = rows.where("sender = __first").withColumn("__nth", F.row_number().over(w.orderBy(polish.desc(), F.size("languages").desc(), F.desc_nulls_last("source_updated_at"), "raw_hash")))
    other = rows.where("sender <> __first").select("source_id", F.col("source_url").alias("url"), F.col("provider_record_id").alias("record_id"), F.lit("sender_collision").alias("reason"), "raw")
    return same.where("__nth = 1").drop("__first", "__nth"), other


def normalize_hydro(docs: DataFrame, most: int = 500) -> Batch:
    """Hydrological warnings: degrees, flag precedence for the state, year 9999 as no end, contradictory validity as unknown."""
    flags = ("statusIsCurrent", "statusIsFuture", "statusIsPast", "statusIsRevoked", "statusIsToConfirm", "isUntilRevoke", "isUpdate", "isDelete", "statusIsChanged")
    element = "struct<id:bigint,number:int,degree:int,releaseDate:string,dateFrom:string,dateTo:string,referenceDate:string,office:string,eventDescription:string,run:string,comment:string,areaDescription:string,probability:int,provinces:array<struct<name:string,areas:array<string>>>," + ",".join(f"{f}:boolean" for f in flags) + ">"
    rec, failed = decode_json_feed(docs, "imgw_hydro", element, None)
    flag = lambda name: F.coalesce(F.col(f"rec.{name}"), F.lit(False))
    now = F.col("fetched_at")
    rid, issued = F.col("rec.id").cast("string"), parse_ts("rec.releaseDate")
    released = F.when(issued["ts"] <= now + F.expr("INTERVAL 5 MINUTES"), issued["ts"])
    start, end = parse_ts("rec.dateFrom"), F.when(~F.startswith("rec.dateTo", F.lit("9999-")), parse_ts("rec.dateTo")["ts"])
    bad_span = F.coalesce(end <= start["ts"], F.lit(False)) | (flag("isUntilRevoke") & end.isNotNull())
    start_ok, end_ok = F.when(~bad_span, start["ts"]), F.when(~bad_span, end)
    conflicting = sum((flag(f).cast("int") for f in flags[:4]), F.lit(0)) > 1
    state = (
        F.when(flag("isDelete") | flag("statusIsRevoked"), "withdrawn").when(bad_span | conflicting, "unknown").when((end_ok <= now) | flag("statusIsPast"), "expired")
        .when(flag("statusIsCurrent") & (start_ok <= now) & (end_ok.isNotNull() | flag("isUntilRevoke")), "active").otherwise("unknown")
    )
    area, name = plain("rec.areaDescription", 1000), required_title("rec.eventDescription")
    provinces = norm_array(F.transform("rec.provinces", lambda p: F.trim(p["name"])))
    catchments = norm_array(F.flatten(F.transform("rec.provinces", lambda p: F.coalesce(p["areas"], F.array().cast("array<string>")))))
    raw = F.to_json(F.struct("rec.id", "rec.number", "rec.office", "rec.degree", "rec.releaseDate", "rec.dateFrom", "rec.dateTo", "rec.referenceDate", "rec.probability", *(f"rec.{f}" for f in flags), provinces.alias("province_names"), catchments.alias("catchment_codes")))
    columns = {
        "provider_record_id": rid, "kind": F.lit("advisory"), "category": F.lit("weather"), "title": F.substring(F.concat_ws(": ", name, area), 1, 800), "description": F.concat_ws(" ", F.array_join(provinces, ", "), plain("rec.run", 4000), plain("rec.comment", 4000)),
        "source_url": F.lit("https://hydro.imgw.pl/"), "issued_at": released, "source_updated_at": released, "valid_from": start_ok, "valid_to": end_ok, "countries": F.array(F.lit("PL")), "location_precision": F.lit("country"),
        "time_precision": F.when(start_ok.isNotNull(), start["precision"]).when(released.isNotNull(), issued["precision"]).otherwise("unknown"), "severity": severity_from_degree("rec.degree"), "original_severity": F.col("rec.degree").cast("string"),
        "lifecycle_status": state, "verification_status": F.lit("official_warning"), "origins": F.array(F.lit("imgw")), "external_ids": F.array(F.concat(F.lit("imgw:hydro:"), rid)), "raw": raw,
        "tags": _tags("current_list_not_archive", "area_description_no_geometry", _when(F.col("rec.degree") == -1, "hydrological_drought"), _when(flag("isUntilRevoke"), "until_revoked"), _when(flag("isUpdate") | F.col("rec.referenceDate").isNotNull(), "update_reference_unresolved"), _when(start_ok > now, "hazard_onset_in_future"), _when(end_ok.isNull() & ~flag("isUntilRevoke"), "expiry_not_known")),
    }
    reason = F.when(F.col("index") >= most, "beyond_list_limit").when(~F.coalesce(F.col("rec.id") > 0, F.lit(False)), "bad_id").when(flag("statusIsToConfirm"), "unconfirmed").when(name.isNull(), "no_title").when(F.col("rec.degree").isNull(), "bad_degree")
    events, bad = _finish(rec, "imgw_hydro", columns, reason)
    return events, bad.unionByName(_failed(failed))


def hydro_batch(events: DataFrame) -> Batch:
    """Exact repeats collapse; versions of one id and clock with different payloads all go."""
    keyed = events.withColumn("__key", F.concat_ws("|", "provider_record_id", F.coalesce(F.col("source_updated_at").cast("string"), F.lit("-"))))
    kept, dropped = dedupe_feed(keyed, "__key")
    bad = dropped.select("source_id", F.col("source_url").alias("url"), F.col("provider_record_id").alias("record_id"), F.lit("conflicting_revision").alias("reason"), "raw")
    return kept.drop("__key"), bad


#: Categories of natural events (fixed values).
EONET_CATEGORIES = ("severeStorms", "volcanoes", "wildfires", "floods", "landslides", "drought", "earthquakes")


def normalize_eonet(docs: DataFrame, days: int = 30) -> Batch:
    """Natural events: the first dated geometry is the start, the latest one the position; closed means expired."""
    element = "struct<id:string,title:string,description:string,link:string,closed:string,categories:array<struct<id:string,title:string>>,sources:array<struct<id:string,url:string>>,geometry:array<struct<date:string,type:string,coordinates:string>>>"
    rec, failed = decode_json_feed(docs, "nasa_eonet", element, "events")
    now = F.col("fetched_at")
    limit = now + F.expr("INTERVAL 5 MINUTES")
    sample = lambda g: F.struct(parse_ts(g["date"], date_only=True)["ts"].alias("ts"), g["type"].alias("type"), g["coordinates"].alias("coordinates"))
    dated = F.array_sort(F.filter(F.transform("rec.geometry", sample), lambda g: g["ts"].isNotNull() & (g["ts"] <= limit)))
    rec = rec.withColumn("dated", dated).withColumn("undated", F.filter("rec.geometry", lambda g: F.coalesce(g["date"], F.lit("")) == ""))
    first, last = F.get("dated", 0), F.try_element_at("dated", F.lit(-1))
    where = F.coalesce(F.struct(last["type"].alias("type"), last["coordinates"].alias("coordinates")), F.try_element_at(F.transform("undated", lambda g: F.struct(g["type"].alias("type"), g["coordinates"].alias("coordinates"))), F.lit(-1)))
    where = F.when(F.size("dated") > 0, F.struct(last["type"].alias("type"), last["coordinates"].alias("coordinates"))).otherwise(where)
    flat, nested = F.from_json(where["coordinates"], "array<double>"), F.from_json(where["coordinates"], "array<array<array<double>>>")
    rings = F.filter(F.transform(nested, lambda r: F.transform(r, lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat")))), ring_valid)
    geometry = F.when(where["type"] == "Point", _point(F.get(flat, 0), F.get(flat, 1))).when((where["type"] == "Polygon") & (F.size(rings) == F.size(nested)), _area(rings))
    closed = parse_ts("rec.closed", date_only=True)["ts"]
    closed = F.when(closed <= limit, closed)
    categories = norm_array(F.filter(F.transform("rec.categories", lambda c: c["id"]), lambda c: c.isin(*EONET_CATEGORIES)))
    latest = F.greatest(last["ts"], closed)
    by_day = first["ts"] == F.date_trunc("day", first["ts"])
    fires = F.array_contains(categories, "wildfires")
    origins = F.transform("rec.sources", lambda s: F.when(s["id"] == "USGS_EHP", "usgs").when((s["id"] == "GDACS") & fires, "nasa:firms").when(s["id"].rlike("^[A-Za-z0-9_-]{1,64}$"), F.concat(F.lit("unknown:eonet:"), F.lower(s["id"]))))
    quake = lambda u: F.nullif(F.regexp_extract(u, r"^https?://earthquake\.usgs\.gov/earthquakes/eventpage/([A-Za-z0-9._-]{1,128})/?$", 1), F.lit(""))
    report = lambda u: F.when(u.rlike(r"^https?://(www\.)?gdacs\.org/report\.aspx\?"), F.concat_ws(":", F.lit("gdacs"), F.try_parse_url(u, F.lit("QUERY"), F.lit("eventtype")), F.try_parse_url(u, F.lit("QUERY"), F.lit("eventid"))))
    hard = F.transform("rec.sources", lambda s: F.coalesce(F.concat(F.lit("usgs:"), quake(s["url"])), report(s["url"])))
    columns = {
        "provider_record_id": F.col("rec.id"), "kind": F.lit("incident"), "category": F.lit("disaster"), "title": required_title("rec.title"), "description": plain("rec.description"), "source_url": F.concat(F.lit("https://eonet.gsfc.nasa.gov/api/v3/events/"), F.col("rec.id")),
        "occurred_start": first["ts"], "geometry": geometry, "location_precision": F.when(geometry["type"] == "Point", "point").when(geometry.isNotNull(), "area").otherwise("unknown"), "time_precision": F.when(by_day, "day").when(first["ts"].isNotNull(), "second").otherwise("unknown"),
        "lifecycle_status": F.when(closed.isNotNull(), "expired").when(F.col("rec.closed").isNull(), "active").otherwise("unknown"), "verification_status": F.lit("curated_reference"),
        "origins": F.when(F.size(F.array_compact(origins)) > 0, origins).otherwise(F.array(F.lit("unknown:eonet"))), "external_ids": F.concat(F.array(F.concat(F.lit("eonet:"), F.col("rec.id"))), F.coalesce(hard, F.array().cast("array<string>"))),
        "tags": F.array_union(F.transform(categories, lambda c: F.concat(F.lit("eonet_category:"), c)), _tags("eonet_curated_reference", "source_geometry_time_not_onset", _when(by_day, DAY_TAG), _when(geometry["type"] == "Point", "representative_point_not_extent"), _when(F.size("dated") > 1, "latest_geometry_not_full_track"), _when(closed.isNotNull(), "curator_closed_not_verified_physical_end"))),
    }
    reason = F.when(~F.coalesce(F.col("rec.id").rlike("^EONET_[A-Za-z0-9_-]{1,80}$"), F.lit(False)), "bad_id").when(F.size(categories) == 0, "category").when(required_title("rec.title").isNull(), "no_title").when(latest < now - F.expr(f"INTERVAL {days} DAYS"), "outside_window")
    events, bad = _finish(rec, "nasa_eonet", columns, reason)
    kept, dropped = dedupe_feed(events, "provider_record_id")
    conflict = dropped.select("source_id", F.col("source_url").alias("url"), F.col("provider_record_id").alias("record_id"), F.lit("conflicting_duplicate").alias("reason"), "raw")
    return kept, bad.unionByName(conflict).unionByName(_failed(failed))


#: Fields of a bulletin that hold times, and all that are read (fixed values).
_SWPC_CLOCKS = ("Issue Time", "Valid From", "Valid To", "Now Valid Until", "Threshold Reached", "Begin Time", "End Time", "Original Issue Time")
_SWPC_FIELDS = (*_SWPC_CLOCKS, "Space Weather Message Code", "Serial Number", "Continuation of Serial Number", "Extension to Serial Number", "Cancel Serial Number", "NOAA Scale")


def _field_values(name: str) -> Column:
    """The distinct values of `Name: value` lines."""
    return F.array_distinct(F.transform(F.regexp_extract_all("message", F.lit(rf"(?im)^{name}:[ \t]*([^\n]*)$"), F.lit(1)), lambda x: F.trim(x)))


def normalize_swpc(docs: DataFrame, days: int = 30) -> Batch:
    """Space-weather bulletins. Keeps `code`, `serial`, `minute` and `refs` for resolve_swpc_refs()."""
    rec, failed = decode_json_feed(docs, "noaa_swpc", "struct<product_id:string,issue_datetime:string,message:string>", None)
    rec = once(rec, {"message": F.regexp_replace("rec.message", "\r\n?", "\n")})
    rec = once(rec, {f"found:{name}": _field_values(name) for name in _SWPC_FIELDS})
    field = lambda name: F.when(F.size(F.col(f"found:{name}")) == 1, F.col(f"found:{name}")[0])  # noqa: E731  null without one value or with several
    rec = once(rec, {f"at:{name}": parse_bulletin_ts(field(name)) for name in _SWPC_CLOCKS})
    at = lambda name: F.col(f"at:{name}")
    clock = F.try_to_timestamp(F.concat(F.regexp_replace(F.regexp_extract("rec.issue_datetime", r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})", 1), " ", "T"), F.lit("Z")))
    lines = F.regexp_extract_all("message", F.lit(r"(?im)^((?:(?:EXTENDED|CONTINUED|CANCEL|CANCELLED)\s+)?(?:WARNING|WATCH|ALERT|SUMMARY):[^\n]*)$"), F.lit(1))
    rec = once(rec, {"code": field("Space Weather Message Code"), "serial": field("Serial Number"), "minute": at("Issue Time"), "headlines": lines, "clock": clock})
    clock, head = F.col("clock"), F.upper(F.get("headlines", 0))
    rec = once(rec, {"cancelled": head.rlike("^CANCEL"), "type": F.regexp_extract(head, "(WARNING|WATCH|ALERT|SUMMARY):", 1)})
    cancelled, kind = F.col("cancelled"), F.col("type")
    forecast, now = kind.isin("WARNING", "WATCH"), F.col("fetched_at")
    seen = lambda name: F.when(at(name) <= F.col("minute") + F.expr("INTERVAL 5 MINUTES"), at(name))
    a, b = F.when(forecast, at("Valid From")), F.when(forecast, F.coalesce(at("Now Valid Until"), at("Valid To")))
    start, end = F.when(~forecast, F.coalesce(seen("Threshold Reached"), seen("Begin Time"))), F.when(~forecast, seen("End Time"))
    state = F.when(cancelled, "withdrawn").when(forecast & (b <= now), "expired").when(forecast & (a <= now) & (b > now), "active").when(~forecast & end.isNotNull(), "expired").otherwise("unknown")
    rid = F.concat_ws(":", "code", "serial", F.date_format("minute", "yyyyMMdd'T'HHmm'Z'"))
    ref = lambda name: F.when(field(name).rlike(r"^\d{1,12}$"), F.struct(field(name).alias("serial"), at("Original Issue Time").alias("minute")))
    refs = F.array_compact(F.array(*(ref(n) for n in ("Continuation of Serial Number", "Extension to Serial Number", "Cancel Serial Number"))))
    rec = once(rec, {"refs": refs, "rid": rid})
    columns = {
        "provider_record_id": F.col("rid"), "kind": F.when(forecast, "advisory").otherwise("measurement"), "category": F.lit("space_weather"), "title": plain(F.get("headlines", 0), 800), "description": plain("message"), "source_url": F.lit("https://services.swpc.noaa.gov/products/alerts.json"),
        "occurred_start": start, "occurred_end": end, "issued_at": F.col("minute"), "source_updated_at": F.col("minute"), "valid_from": a, "valid_to": b, "time_precision": F.lit("minute"), "original_severity": field("NOAA Scale"),
        "lifecycle_status": state, "verification_status": F.lit("official_bulletin"), "origins": F.array(F.lit("noaa:swpc")), "external_ids": F.array(F.concat(F.lit("swpc:"), F.col("rid"))),
        "tags": _tags("swpc_bulletin", "unlocated_space_weather", _when(forecast, "forecast"), _when(kind == "ALERT", "observed_alert"), _when(kind == "SUMMARY", "observed_summary"), _when(cancelled, "source_cancellation")),
    }
    apart = F.unix_timestamp(clock) - F.unix_timestamp("minute")
    reason = (
        F.when(~F.coalesce(F.col("rec.product_id").rlike("^[A-Z0-9]{1,16}$"), F.lit(False)), "product_id").when(~F.coalesce(F.char_length("message").between(1, 20000), F.lit(False)), "message")
        .when(~F.coalesce(F.col("code").rlike("^[A-Z0-9]{1,20}$"), F.lit(False)) | ~F.coalesce(F.col("serial").rlike(r"^\d{1,12}$"), F.lit(False)), "code_or_serial").when(F.col("minute").isNull(), "issue_time")
        .when((F.coalesce("rec.issue_datetime", F.lit("")) != "") & ~F.coalesce((apart >= 0) & (apart < 300), F.lit(False)), "clocks_disagree").when(F.size("headlines") != 1, "headline")
        .when(F.col("minute") > now + F.expr("INTERVAL 5 MINUTES"), "future_publication").when(F.col("minute") < now - F.expr(f"INTERVAL {days} DAYS"), "outside_window").when(forecast & (a >= b), "validity").when(start > end, "observation_interval")
        .when(F.exists("refs", lambda r: (r["serial"] == F.col("serial")) | F.coalesce(r["minute"] >= F.col("minute"), F.lit(False))), "reference")
    )
    events, bad = _finish(rec, "noaa_swpc", columns, reason, keep=("code", "serial", "minute", "refs"))
    kept, dropped = dedupe_feed(events, "provider_record_id")
    conflict = dropped.select("source_id", F.col("source_url").alias("url"), F.col("provider_record_id").alias("record_id"), F.lit("conflicting_duplicate").alias("reason"), "raw")
    return kept, bad.unionByName(conflict).unionByName(_failed(failed))


def resolve_swpc_refs(events: DataFrame) -> DataFrame:
    """Adds the keys of bulletins that a bulletin names: an explicit original time, or the only earlier one of that serial."""
    stamp = lambda r: F.concat_ws(":", F.col("code"), r["serial"], F.date_format(r["minute"], "yyyyMMdd'T'HHmm'Z'"))
    none = F.array().cast("array<string>")
    explicit = F.transform(F.filter("refs", lambda r: r["minute"].isNotNull()), lambda r: F.concat(F.lit("swpc:"), stamp(r)))
    out = events.withColumn("external_ids", F.array_sort(F.array_union("external_ids", F.coalesce(explicit, none))))
    # only bulletins without an original time are looked up; the rest know their keys
    r = events.select(F.col("provider_record_id").alias("id"), "code", "minute", F.explode(F.filter("refs", lambda r: r["minute"].isNull())).alias("r"))
    r = cut(r.select("id", "code", "minute", F.col("r.serial").alias("serial")))
    if r.isEmpty():
        return out
    prior = events.select("code", "serial", F.col("minute").alias("m2"), F.col("provider_record_id").alias("target"))
    found = r.join(prior, ["code", "serial"], "left").groupBy("id", "serial").agg(F.count_if(F.col("m2") < F.col("minute")).alias("n"), F.min(F.when(F.col("m2") < F.col("minute"), F.col("target"))).alias("t"))
    found = found.select("id", F.when(F.col("n") == 1, F.col("t")).alias("target"))
    per = found.groupBy("id").agg(F.collect_set(F.concat(F.lit("swpc:"), F.col("target"))).alias("__keys"), F.bool_or(F.col("target").isNull()).alias("__open"))
    out = out.join(per.withColumnRenamed("id", "provider_record_id"), "provider_record_id", "left")
    return out.withColumns({"external_ids": F.array_sort(F.array_union("external_ids", F.coalesce("__keys", none))), "tags": F.when(F.col("__open"), F.array_sort(F.array_union("tags", F.array(F.lit("unresolved_source_reference"))))).otherwise(F.col("tags"))}).drop("__keys", "__open")


def normalize_cert(docs: DataFrame, most: int = 10, user_category: str = "users") -> Batch:
    """CERT index: facts and links only, the first ten items, guid and link of one article."""
    item = "struct<title:string,link:string,description:string,pubDate:string,guid:string,category:array<string>>"
    xml, failed = decode_xml_feed(docs, "cert_pl", "rss", f"channel struct<title:string,link:string,lastBuildDate:string,item:array<{item}>>")
    rec = xml.select("url", "fetched_at", F.posexplode("xml.channel.item").alias("index", "rec")).withColumn("raw", F.to_json("rec"))
    article = lambda c: F.nullif(F.regexp_extract(c, r"^https://moje\.cert\.pl/(?:[a-z-]+/)*(\d{4}/\d+)(?:/[A-Za-z0-9_-]*/?)?$", 1), F.lit(""))
    rec = once(rec, {"rid": article("rec.link"), "guid": article("rec.guid"), "issued": parse_ts("rec.pubDate")})
    issued = F.col("issued")
    rec = rec.withColumn("nth", F.row_number().over(Window.partitionBy("url", "fetched_at", "rid").orderBy("index")))
    raw = F.to_json(F.struct(F.col("rid").alias("publication_id"), issued["ts"].alias("published_at"), issued["precision"].alias("time_precision")))
    columns = {
        "provider_record_id": F.col("rid"), "kind": F.lit("advisory"), "category": F.lit("cyber"), "title": F.concat(F.lit("CERT notice "), F.col("rid")), "source_url": F.col("rec.link"), "issued_at": issued["ts"], "time_precision": issued["precision"],
        "verification_status": F.lit("published_by_cert_pl"), "origins": F.array(F.lit("cert_pl")), "external_ids": F.array(F.concat(F.lit("cert_pl:"), F.col("rid"))), "tags": _tags("publication_index", "end_user_notice", "no_incident_location", "validity_unknown"), "raw": raw,
    }
    listed = F.coalesce(F.exists("rec.category", lambda c: F.lower(F.trim(c)) == user_category), F.lit(False))
    reason = F.when(F.col("index") >= most, "beyond_list_limit").when(~listed, "category").when(F.col("rid").isNull(), "article_link").when(F.col("rec.guid").isNotNull() & ~F.col("guid").eqNullSafe(F.col("rid")), "guid_disagrees").when(F.col("nth") > 1, "duplicate_id")
    events, bad = _finish(rec, "cert_pl", columns, reason)
    return events, bad.unionByName(_failed(failed))


def normalize_all(docs: DataFrame, country: str = "PL") -> Batch:
    """All feeds of a table of raw documents; every feed reads its own documents only."""
    cap, cap_bad = normalize_cap(docs, country)
    merged, collided = merge_cap(cap)
    hydro, hydro_bad = normalize_hydro(docs)
    kept, conflicting = hydro_batch(hydro)
    space, space_bad = normalize_swpc(docs)
    parts = [
        normalize_usgs(docs), normalize_gdacs(docs), (merged, cap_bad.unionByName(collided)), normalize_easa(docs), normalize_kev(docs), normalize_cert(docs), (kept, hydro_bad.unionByName(conflicting)),
        normalize_eonet(docs), (resolve_swpc_refs(space), space_bad), normalize_status(docs, "github_status"), normalize_status(docs, "cloudflare_status"), normalize_radar(docs),
    ]
    names = list(EVENT_COLUMNS)
    events, bad = parts[0][0].select(*names), parts[0][1]
    for e, b in parts[1:]:
        events, bad = events.unionByName(e.select(*names)), bad.unionByName(b)
    return events, bad


def feed_order(df: DataFrame) -> DataFrame:
    """Source clock, withdrawals last, then record id."""
    return df.orderBy(F.asc_nulls_first(F.coalesce("source_updated_at", "issued_at", "occurred_start")), F.col("lifecycle_status") == "withdrawn", "provider_record_id")
