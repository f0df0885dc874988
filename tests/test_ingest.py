"""Feeds, identity, ingest, snapshots and retention on small fixtures of our own."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlens.operators import filters as X
from eventlens.operators import geo_joins as J
from eventlens.operators import identity as I
from eventlens.operators import ordering as L
from eventlens.plans import pipelines as P
from eventlens.schemas import EVENT_COLUMNS, RAW_DOCUMENT, EventQuery
from eventlens.sources import documents as D
from eventlens.sources import feeds, sinks

NOW = datetime(2024, 5, 1, 12)


def docs(spark, *bodies, at=NOW):
    rows = [(s, url, 200, "x", at, False, b if isinstance(b, str) else json.dumps(b)) for s, url, b in bodies]
    return spark.createDataFrame(rows, RAW_DOCUMENT)


def quake(i, mag=5.0, kind="earthquake", updated=1714550000000, title=None):
    return {"type": "Feature", "id": i, "properties": {"mag": mag, "place": "Somewhere", "time": 1714540000000, "updated": updated, "url": "https://earthquake.usgs.gov/x", "net": "us", "ids": f",{i},alt{i},", "type": kind, "title": title or f"M {mag} {i}"}, "geometry": {"type": "Point", "coordinates": [21.0, 52.0, 10.0]}}


def usgs(*features):
    return {"type": "FeatureCollection", "metadata": {"count": len(features)}, "features": list(features)}


def by(df, key="provider_record_id"):
    return {r[key]: r for r in df.collect()}


def test_admission_and_envelopes(spark):
    rows = [("usgs", "a", 200, None, NOW, False, "{}"), ("usgs", "b", 500, None, NOW, False, "{}"), ("usgs", "c", 200, None, NOW, False, " "), ("cert_pl", "d", 200, None, NOW, False, "x" * 600_000), ("usgs", "e", 304, None, NOW, True, "{}")]
    ok, failed = D.admit_documents(spark.createDataFrame(rows, RAW_DOCUMENT))
    assert {r.url for r in ok.collect()} == {"a", "e"} and {(r.url, r.reason) for r in failed.collect()} == {("b", "status"), ("c", "empty_body"), ("d", "too_large")}
    bad = docs(spark, ("usgs", "nan", '{"features":[{"type":"Feature","id":"x","properties":{"mag": NaN}}]}'), ("usgs", "none", "{}"), ("usgs", "cut", '{"features":['))
    events, q = feeds.normalize_usgs(bad)
    assert events.count() == 0 and {r.url for r in q.collect()} == {"nan", "none", "cut"}


def test_quakes(spark):
    events, bad = feeds.normalize_usgs(docs(spark, ("usgs", "u", usgs(quake("a1", 7.1), quake("b2", 4.0, "explosion"), quake("bad id"), {"type": "Other"}))))
    e = by(events)
    assert e["a1"].severity == 4 and e["a1"].external_ids == ["usgs:a1", "usgs:alta1"] and e["a1"].origins == ["usgs:us"] and e["a1"].location_precision == "point"
    assert e["b2"].lifecycle_status == "withdrawn" and "withdraw_only_if_known" in e["b2"].tags
    assert {r.reason for r in bad.collect()} == {"bad_id", "not_a_feature"}


def test_other_json_feeds(spark):
    kev = {"dateReleased": "2024-04-30T10:00:00Z", "count": 2, "vulnerabilities": [{"cveID": "CVE-2024-1234", "vulnerabilityName": "Hole", "dateAdded": "2024-04-30", "knownRansomwareCampaignUse": "Known"}, {"cveID": "CVE-2024-1234"}, {"cveID": "x"}]}
    easa = {"conflict_zones": [{"Nid": "7", "issued_date": "2024-04-01T00:00:00+02:00", "valid_until_date": "30/04/2024", "name": "Area", "status": "Active", "country": "UA, XX1"}]}
    status = {"incidents": [{"id": "ab1", "name": "Down", "status": "resolved", "impact": "major", "started_at": "2024-04-30T10:00:00Z", "resolved_at": "2024-04-30T09:00:00Z", "components": [{"id": "c1", "name": "A"}, {"id": "c1", "name": "B"}]}]}
    radar = lambda *i: {"success": True, "result": {"annotations": [{"id": x, "eventType": "OUTAGE", "startDate": "2024-04-30T10:00:00Z", "locations": ["PL"]} for x in i]}}
    hydro = [{"id": 5, "degree": 2, "eventDescription": "Flood", "releaseDate": "2024-04-30T10:00:00Z", "dateFrom": "2024-04-30T10:00:00Z", "dateTo": "9999-12-31T00:00:00Z", "isUntilRevoke": True, "statusIsCurrent": True, "provinces": [{"name": "B", "areas": ["x", "a"]}]}, {"id": 6, "degree": 1, "eventDescription": "X", "statusIsToConfirm": True}]
    eonet = {"events": [{"id": "EONET_1", "title": "Fire", "closed": None, "categories": [{"id": "wildfires"}], "sources": [{"id": "GDACS", "url": "https://www.gdacs.org/report.aspx?eventtype=WF&eventid=9"}], "geometry": [{"date": "2024-04-30T12:00:00Z", "type": "Point", "coordinates": [1, 2]}, {"date": "2024-04-28T00:00:00Z", "type": "Point", "coordinates": [3, 4]}]}, {"id": "EONET_2", "title": "Ice", "categories": [{"id": "seaLakeIce"}]}]}
    raw = docs(spark, ("cisa_kev", "k", kev), ("easa_czib", "e", easa), ("github_status", "g", status), ("cloudflare_radar", "r?offset=0", radar("1", "2")), ("cloudflare_radar", "r?offset=100", radar("2", "3")), ("imgw_hydro", "h", hydro), ("nasa_eonet", "n", eonet))
    events, bad = feeds.normalize_all(raw)
    assert events.columns == list(EVENT_COLUMNS)
    e = by(events)
    assert e["CVE-2024-1234"].time_precision == "day" and "ransomware_use_reported" in e["CVE-2024-1234"].tags and e["CVE-2024-1234"].occurred_start is None
    assert e["7"].issued_at == datetime(2024, 4, 1) and e["7"].valid_to == datetime(2024, 5, 1) and e["7"].lifecycle_status == "expired" and e["7"].countries == ["UA"]
    assert e["ab1"].occurred_end is None and e["ab1"].severity == 3 and json.loads(e["ab1"].raw)["components"] == [{"id": "c1", "name": "B"}]
    assert {"1", "2", "3"} <= set(e) and e["5"].lifecycle_status == "active" and e["5"].valid_to is None and e["5"].severity == 3
    assert e["EONET_1"].occurred_start == datetime(2024, 4, 28) and e["EONET_1"].geometry.points[0].lon == 1.0 and e["EONET_1"].origins == ["nasa:firms"] and "gdacs:WF:9" in e["EONET_1"].external_ids
    assert {(r.source_id, r.reason) for r in bad.collect()} >= {("cisa_kev", "duplicate_cve"), ("cisa_kev", "bad_cve"), ("cloudflare_radar", "repeated_on_later_page"), ("imgw_hydro", "unconfirmed"), ("nasa_eonet", "category")}


CAP = """<?xml version="1.0"?><alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>{id}</identifier><sender>s@x</sender><sent>2024-05-01T08:00:00+00:00</sent><status>Actual</status><msgType>{kind}</msgType><scope>Public</scope>{refs}
<info><language>en</language><event>Wind</event><severity>Severe</severity><effective>2024-05-01T08:00:00Z</effective><onset>2024-05-01T20:00:00Z</onset><expires>2024-05-02T08:00:00Z</expires><headline>Strong wind</headline><area><areaDesc>A</areaDesc><polygon>50,20 50,21 51,21 50,20</polygon></area></info>
<info><language>pl</language><event>Wiatr</event><severity>Severe</severity><expires>2024-05-02T08:00:00Z</expires><headline>Silny wiatr</headline></info></alert>"""
RSS = """<rss version="2.0" xmlns:gdacs="http://www.gdacs.org" xmlns:geo="http://www.w3.org/2003/01/geo/wgs84_pos#" xmlns:georss="http://www.georss.org/georss"><channel><pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate>
<item><title>Quake</title><link>https://www.gdacs.org/report.aspx?eventid=1</link><pubDate>Wed, 01 May 2024 09:00:00 GMT</pubDate><gdacs:eventtype>EQ</gdacs:eventtype><gdacs:eventid>1</gdacs:eventid><gdacs:episodeid>2</gdacs:episodeid><gdacs:version>1</gdacs:version><gdacs:alertlevel>Red</gdacs:alertlevel><gdacs:iscurrent>true</gdacs:iscurrent><gdacs:fromdate>Wed, 01 May 2024 08:00:00 GMT</gdacs:fromdate><gdacs:datemodified>Wed, 01 May 2024 09:30:00 GMT</gdacs:datemodified><gdacs:iso3>CHL</gdacs:iso3><gdacs:glide>EQ-2024-000001-CHL</gdacs:glide><georss:point>52.0 21.0</georss:point><gdacs:resources><gdacs:resource source="USGS" url="https://earthquake.usgs.gov/earthquakes/eventpage/a1"/></gdacs:resources></item></channel></rss>"""


def test_xml_feeds(spark):
    raw = docs(spark, ("meteoalarm", "https://feeds.meteoalarm.org/1", CAP.format(id="w1", kind="Alert", refs="")), ("meteoalarm", "https://feeds.meteoalarm.org/2", CAP.format(id="w2", kind="Cancel", refs="<references>s@x,w1,2024-05-01T07:00:00Z other,w9,x</references>")), ("meteoalarm", "evil", '<!DOCTYPE a [<!ENTITY b "c">]><alert/>'), ("gdacs", "g", RSS))
    events, bad = feeds.normalize_cap(raw, "PL")
    e = by(events)
    assert e["w1"].title == "Silny wiatr" and e["w1"].valid_to == datetime(2024, 5, 2, 8) and e["w1"].lifecycle_status == "active" and e["w1"].severity == 3
    assert e["w2"].lifecycle_status == "withdrawn" and e["w2"].supersedes == ["w1"]
    assert {(r.url, r.reason) for r in bad.collect()} == {("evil", "declares_entities")}
    e = by(feeds.normalize_cap(raw, "DE")[0])
    assert e["w1"].title == "Strong wind" and e["w1"].geometry.rings[0][0].lon == 20.0 and "hazard_onset_in_future" in e["w1"].tags
    g = by(feeds.normalize_gdacs(raw)[0])["EQ:1"]
    assert g.severity == 4 and g.origins == ["usgs"] and "usgs:a1" in g.external_ids and "glide:EQ-2024-000001-CHL" in g.external_ids and g.geometry.points[0].lat == 52.0


def test_bulletins(spark):
    body = lambda serial, extra="", kind="WARNING", at="2024 May 01 0800 UTC": f"Space Weather Message Code: WARK04\r\nSerial Number: {serial}\r\nIssue Time: {at}\r\n\r\n{kind}: Geomagnetic K-index of 4 expected\r\nValid From: 2024 May 01 0900 UTC\r\nValid To: 2024 May 01 2100 UTC\r\n{extra}"
    rec = lambda text, at="2024-05-01 08:01:00": {"product_id": "K04W", "issue_datetime": at, "message": text}
    raw = docs(spark, ("noaa_swpc", "s", [rec(body(10)), rec(body(11, "Extension to Serial Number: 10\r\n", "EXTENDED WARNING", "2024 May 01 1000 UTC"), "2024-05-01 10:00:30"), rec(body(12), "2024-05-01 09:00:00"), rec(body(13, "Cancel Serial Number: 99\r\n"))]))
    events, bad = feeds.normalize_swpc(raw)
    e = {r.serial: r for r in feeds.resolve_swpc_refs(events).collect()}
    assert e["10"].lifecycle_status == "active" and e["10"].valid_from == datetime(2024, 5, 1, 9)
    assert e["11"].external_ids == ["swpc:WARK04:10:20240501T0800Z", "swpc:WARK04:11:20240501T1000Z"]
    assert "unresolved_source_reference" in e["13"].tags and {r.reason for r in bad.collect()} == {"clocks_disagree"}


def norm(spark, *rows):
    base = dict.fromkeys(EVENT_COLUMNS)
    out = []
    for r in rows:
        x = base | {"source_id": "usgs", "kind": "incident", "category": "earthquake", "title": "t", "severity": 1, "lifecycle_status": "active", "countries": [], "origins": ["usgs:us"], "external_ids": [], "supersedes": [], "tags": [], "location_precision": "unknown", "time_precision": "second"} | r
        x["raw"] = x["raw"] or json.dumps({k: str(v) for k, v in r.items()})
        x["raw_hash"] = str(hash(x["raw"]))
        out.append(tuple(x[c] for c in EVENT_COLUMNS))
    return spark.createDataFrame(out, ", ".join(f"{c} {k}" for c, k in EVENT_COLUMNS.items()))


def frozen(tables):
    return {k: v.checkpoint() for k, v in tables.items()}


def test_ingest_is_idempotent_and_never_promotes_old_evidence(spark):
    t0 = P.empty_tables(spark)
    a = {"provider_record_id": "r1", "external_ids": ["usgs:r1"], "source_updated_at": NOW - timedelta(hours=5), "title": "A"}
    t1, bad = P.persist_batch(t0, norm(spark, a, {"provider_record_id": "r2", "external_ids": ["usgs:r2"], "title": "Two"}), NOW)
    t1 = frozen(t1)
    assert bad.count() == 0 and t1["events"].count() == 2 and t1["revisions"].count() == 2
    again, _ = P.persist_batch(t1, norm(spark, a), NOW + timedelta(minutes=5))
    assert again["observations"].count() == 2 and again["revisions"].count() == 2
    t2, _ = P.persist_batch(t1, norm(spark, a | {"title": "B", "source_updated_at": NOW - timedelta(hours=1)}), NOW + timedelta(hours=1))
    t2 = frozen(t2)
    assert {r.title for r in t2["events"].collect()} == {"B", "Two"}
    t3, _ = P.persist_batch(t2, norm(spark, a), NOW + timedelta(hours=2))
    assert {r.title for r in t3["events"].collect()} == {"B", "Two"} and t3["observations"].count() == 3
    gone = {"provider_record_id": "zz", "external_ids": ["usgs:zz"], "tags": ["withdraw_only_if_known"], "lifecycle_status": "withdrawn", "title": "gone"}
    t4, _ = P.persist_batch(t2, norm(spark, gone), NOW + timedelta(hours=3))
    assert t4["events"].count() == 2
    t5, _ = P.persist_batch(t2, norm(spark, gone | {"provider_record_id": "r1", "external_ids": ["usgs:r1"], "source_updated_at": NOW}), NOW + timedelta(hours=3))
    assert {r.lifecycle_status for r in t5["events"].where("title = 'gone'").collect()} == {"withdrawn"}


def test_identity_conflict_is_rejected_not_merged(spark):
    known = spark.createDataFrame([("usgs:1", "E1"), ("usgs:2", "E2")], "external_id string, event_id string")
    rows = norm(spark, {"provider_record_id": "x", "external_ids": ["usgs:1", "usgs:2"]}, {"provider_record_id": "y", "external_ids": ["usgs:1"]}, {"provider_record_id": "z", "external_ids": ["glide:EQ-1"]}, {"provider_record_id": "w", "external_ids": ["usgs:9"]}, {"provider_record_id": "v", "source_id": "gdacs", "external_ids": ["usgs:9"]})
    good, bad = I.resolve_identity(rows, known)
    g = by(good)
    assert {r.provider_record_id: r.reason for r in bad.collect()} == {"x": "identity_conflict"}
    assert g["y"].event_id == "E1" and g["z"].is_new and g["w"].event_id == g["v"].event_id
    for parts in (1, 8):
        assert {k: r.event_id for k, r in by(I.resolve_identity(rows.repartition(parts), known)[0]).items()} == {k: r.event_id for k, r in g.items()}
    over = spark.createDataFrame([("usgs", "y", "E2")], "source_id string, provider_record_id string, event_id string")
    assert {r.provider_record_id: r.reason for r in I.resolve_identity(rows, known, over)[1].collect()}["y"] == "override_conflict"


def test_long_chains_and_large_components_are_decided(spark):
    import random

    names = [f"{i:03d}" for i in range(120)]
    random.Random(1).shuffle(names)
    chain = norm(spark, *({"provider_record_id": r, "external_ids": [f"usgs:c{i}", f"usgs:c{i + 1}"]} for i, r in enumerate(names)))
    assert {r.component for r in I.key_components(chain.select(F.col("provider_record_id").alias("record_id"), F.col("external_ids").alias("keys"))).collect()} == {"000"}
    owners, want = {}, {}
    for i, r in sorted(enumerate(names), key=lambda x: x[1]):
        found = {owners[k] for k in (i, i + 1) if k in owners}
        if len(found) > 1:
            want[r] = None
        else:
            want[r] = found.pop() if found else "ev:" + min(f"record:usgs:{r}", f"usgs:c{i}", f"usgs:c{i + 1}")
            owners |= {i: want[r], i + 1: want[r]}
    none = spark.createDataFrame([], "external_id string, event_id string")
    good, bad = I.resolve_identity(chain, none)
    assert {r.provider_record_id: r.event_id for r in good.collect()} | {r.provider_record_id: None for r in bad.collect()} == want
    hot = norm(spark, {"provider_record_id": "x", "external_ids": ["usgs:hot"]}).crossJoin(spark.range(10_100)).withColumn("provider_record_id", F.format_string("r%05d", "id")).withColumn("raw_hash", F.col("provider_record_id")).drop("id")
    good, bad = I.resolve_identity(hot, none)
    assert bad.count() == 0 and {(r.event_id, r.is_new): r["count"] for r in good.groupBy("event_id", "is_new").count().collect()} == {("ev:record:usgs:r00000", True): 1, ("ev:record:usgs:r00000", False): 10_099}
    edges = spark.createDataFrame([("e", f"a{i}", f"a{i + 1}") for i in range(60)] + [("f", "x", "x")], "event_id string, src string, dst string")
    assert [tuple(r) for r in I.cap_cycles(edges).collect()] == [("f", "x", "x")]
    few = spark.createDataFrame([("e", a, b) for a, b in ("ab", "bc", "cd")] + [("g", "a", "b"), ("g", "b", "a")], "event_id string, src string, dst string")
    assert sorted(tuple(r) for r in I.cap_cycles(few, most=1).collect()) == [("g", "a", "b"), ("g", "b", "a")]


def test_ingest_keeps_splits_senders_and_breaks_reference_cycles(spark):
    cap = {"source_id": "meteoalarm", "kind": "advisory", "category": "weather", "source_url": "https://x.example.org/"}
    warn = lambda r, sender, refs, hours, title: cap | {"provider_record_id": r, "external_ids": [f"cap:{sender}:{r}"], "sender": sender, "supersedes": refs, "issued_at": NOW - timedelta(hours=hours), "title": title}
    quakes = [{"provider_record_id": "u", "external_ids": ["usgs:u"]}, {"source_id": "gdacs", "provider_record_id": "EQ:1", "external_ids": ["usgs:u", "gdacs:EQ:1"], "title": "g"}]
    t1, bad = P.persist_batch(P.empty_tables(spark), norm(spark, *quakes, warn("w1", "S", ["w2"], 3, "one"), warn("w2", "S", ["w1"], 2, "two")), NOW)
    assert [tuple(r) for r in bad.collect()] == [("meteoalarm", "w2", "cap_cycle")]
    t1 = frozen(t1)
    assert {r.title for r in t1["events"].collect()} == {"t", "one"} or {r.title for r in t1["events"].collect()} == {"g", "one"}
    event = t1["records"].where("source_id = 'gdacs'").first().event_id
    t1["evidence"] = t1["observations"].select("event_id", "observation_id")
    t2 = frozen(I.split_source(t1, event, "gdacs", "wrong place", NOW))
    later = NOW + timedelta(hours=1)
    t3, bad = P.persist_batch(t2, norm(spark, quakes[1] | {"title": "g2", "source_updated_at": NOW}, warn("w1", "T", [], 1, "forged"), warn("w3", "S", ["w1"], 1, "three")), later)
    assert [tuple(r) for r in bad.collect()] == [("meteoalarm", "w1", "cap_sender_conflict")]
    assert {r.event_id: r.title for r in t3["events"].where("category = 'earthquake'").collect()}[f"{event}/split/gdacs"] == "g2"
    assert {r.title for r in t3["events"].where("category = 'weather'").collect()} == {"three"}


def test_origins_cycles_and_supersession(spark):
    m = spark.createDataFrame([("e", ["usgs:us"]), ("e", ["usgs:ci"]), ("e", ["unknown:x"]), ("e", ["gwis", "emsc"]), ("f", ["firms"])], "event_id string, origins array<string>")
    assert {r.event_id: (r.independent_origins, r.independent_source_count) for r in I.independent_origins(m).collect()} == {"e": (["usgs"], 1), "f": (["nasa:firms"], 1)}
    edges = spark.createDataFrame([("e", "a", "b"), ("e", "b", "a"), ("e", "c", "a"), ("f", "x", "y")], "event_id string, src string, dst string")
    assert {(r.src, r.dst) for r in I.cap_cycles(edges).collect()} == {("a", "b"), ("b", "a")}
    rows = spark.createDataFrame([("e", "meteoalarm", "w1", []), ("e", "meteoalarm", "w2", ["w1"])], "event_id string, source_id string, provider_record_id string, supersedes array<string>")
    assert [r.provider_record_id for r in I.not_superseded(rows).collect()] == ["w2"]


def test_absence_is_unknown_not_withdrawn(spark):
    tags = ["current_list_not_archive", "until_revoked"]
    rows = [("h1", "active", tags, NOW - timedelta(hours=2)), ("h2", "active", tags, NOW), ("h3", "unknown", [*tags, "not_in_current_source_list"], NOW), ("h4", "active", [], NOW - timedelta(hours=2))]
    df = spark.createDataFrame([("imgw_hydro", "advisory", i, s, t, None, at) for i, s, t, at in rows], "source_id string, kind string, id string, lifecycle_status string, tags array<string>, valid_to timestamp, last_seen_at timestamp")
    state = spark.createDataFrame([("imgw_hydro", NOW - timedelta(hours=1))], "source_id string, current_list_ingested_at timestamp")
    assert {r.id: r.lifecycle_status for r in X.apply_absence(df, state).collect()} == {"h1": "unknown", "h2": "active", "h3": "active", "h4": "active"}


def points(spark, *rows):
    df = spark.createDataFrame([(i, c, at, float(x), float(y)) for i, c, at, x, y in rows], "id string, category string, occurred_start timestamp, lon double, lat double")
    none = F.array().cast("array<array<struct<lon:double,lat:double>>>")
    return df.withColumns({"location_precision": F.lit("point"), "time_precision": F.lit("second"), "geometry": F.struct(F.lit("Point").alias("type"), F.array(F.struct("lon", "lat")).alias("points"), none.alias("rings"))})


def test_relations_are_brute_force(spark):
    import math
    import random

    rng = random.Random(3)
    rows = [(f"e{i:03d}", rng.choice(["earthquake", "weather"]), NOW + timedelta(seconds=rng.randrange(40_000)), rng.choice([179.9, -179.9, 0.0, 60.0]) + rng.random(), rng.choice([0.0, 70.0, 84.0, -89.5]) + rng.random() / 2) for i in range(150)]
    rows = [(i, c, at, x - 360 if x > 180 else x, y) for i, c, at, x, y in rows]
    found = {(r.event_a, r.event_b): r.relation_type for r in J.relate_events(points(spark, *rows), per_event=1000).collect()}

    def km(a, b):
        p, q = math.radians(a[4]), math.radians(b[4])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            dt, d = abs((a[2] - b[2]).total_seconds()), km(a, b)
            want = "possible_same_event" if a[1] == b[1] == "earthquake" and dt <= 600 and d <= 25 else "near_in_space_and_time" if a[1] != b[1] and dt <= 21600 and d <= 100 else None
            if abs(d - 100) > 1 and abs(d - 25) > 0.3:
                assert found.get((a[0], b[0])) == want, (a, b, d)


def test_snapshot_delta_and_retained_reads(spark):
    make = lambda *r: spark.createDataFrame(list(r), "id string, fp string")
    new, old = make(("a", "1"), ("b", "2"), ("c", "3")), make(("b", "2"), ("c", "9"), ("d", "4"))
    assert {r.id: r.status for r in I.compare_snapshots(new, old, NOW, NOW - timedelta(1)).collect()} == {"a": "added", "b": "same", "c": "changed", "d": "missing"}
    assert [r.status for r in I.compare_snapshots(new, old, NOW, NOW).collect()] == ["same_snapshot_differs"]
    assert [r.status for r in I.compare_snapshots(new, old, NOW, NOW + timedelta(1)).collect()] == ["out_of_order"]
    ev = lambda *r: spark.createDataFrame(list(r), "id string, source_ids array<string>, pairs array<struct<source_id:string,provider_record_id:string>>, tags array<string>")
    cur = ev(("n", ["s1"], [("s1", "1")], []))
    prev = ev(("p1", ["s2"], [("s2", "1")], []), ("p2", ["s1", "s2"], [("s1", "9"), ("s2", "2")], []), ("p3", ["s2"], [("s2", "1"), ("s2", "7")], []), ("n", ["s2"], [("s2", "5")], []))
    src = spark.createDataFrame([("s1", "ok", NOW), ("s2", "error", NOW), ("s3", "error", None)], "source_id string, status string, last_success_at timestamp")
    out = by(I.retain_previous(cur, prev, src), "id")
    assert set(out) == {"n", "p1"} and out["p1"].tags == ["cached_public_data"]


def test_queries_and_validation(spark):
    with pytest.raises(ValueError, match="window"):
        X.window_bounds(EventQuery(since=NOW, until=NOW), NOW)
    assert X.validate_query(EventQuery(window_hours=0, time_basis="x", lat=1.0)) == ["time_basis", "window_hours", "radius_incomplete"]
    assert X.window_bounds(EventQuery(window_hours=2), NOW) == (NOW - timedelta(hours=2), NOW)


def test_highlights_do_not_depend_on_order(spark):
    rows = [(f"i{i:02d}", ["earthquake", "weather", "cyber"][i % 3], f"T{i % 7}", [f"s{i % 4}"], NOW - timedelta(hours=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, category string, title string, source_ids array<string>, occurred_start timestamp").withColumns({"issued_at": F.col("occurred_start"), "valid_from": F.col("occurred_start"), "last_changed_at": F.col("occurred_start"), "severity": F.lit(1), "original_severity": F.lit("x"), "countries": F.array(F.lit("PL"))})
    df = X.default_basis(df)
    runs = {tuple(sorted((r.position, r.id, r.step) for r in L.highlights(df.repartition(p), NOW - timedelta(days=2), NOW).collect())) for p in (1, 5)}
    assert len(runs) == 1
    picked = next(iter(runs))
    assert len(picked) == 8 and [p[1] for p in picked[:3]] == ["i00", "i01", "i02"]


def test_highlights_see_past_repeats(spark):
    make = lambda rows: X.default_basis(spark.createDataFrame(rows, "scope string, id string, category string, title string, source_ids array<string>, occurred_start timestamp").withColumns({"issued_at": F.col("occurred_start"), "valid_from": F.col("occurred_start"), "last_changed_at": F.col("occurred_start"), "severity": F.lit(1), "original_severity": F.lit("x"), "countries": F.array(F.lit("PL"))}))
    at = lambda i: NOW - timedelta(minutes=i)
    rows = [("a", f"r{i:04d}", "earthquake", "Same", ["hot"], at(i)) for i in range(700)] + [("a", "x1", "earthquake", "Other", ["hot"], at(800)), ("a", "x2", "earthquake", "New", ["quiet"], at(900))]
    rows += [("b", "y1", "weather", "W", ["s"], at(5)), ("b", "y2", "cyber", "C", ["s"], at(6)), ("b", "y3", "cyber", "D", ["s"], at(7))]
    since = NOW - timedelta(days=2)
    out = L.highlights(make(rows), since, NOW, keys=["scope"]).collect()
    assert sorted((r.scope, r.position, r.id, r.step) for r in out) == [("a", 1, "r0000", "category"), ("a", 2, "x2", "fill"), ("a", 3, "x1", "fill"), ("b", 1, "y1", "category"), ("b", 2, "y2", "category"), ("b", 3, "y3", "fill")]
    twins = spark.createDataFrame([("r0000", f"r{i:04d}", "possible_same_event") for i in range(1, 600)] + [("y2", "y1", "possible_same_event"), ("r0000", "x2", "possible_same_event")], "event_a string, event_b string, relation_type string")
    out = L.highlights(make(rows), since, NOW, keys=["scope"], relations=twins).collect()
    assert sorted((r.scope, r.position, r.id, r.step) for r in out) == [("a", 1, "r0000", "category"), ("a", 2, "x1", "fill"), ("b", 1, "y1", "category"), ("b", 2, "y3", "category")]


def test_fingerprint_streams_in_blocks(spark):
    import hashlib

    digest = lambda rows: hashlib.md5("".join(sorted(hashlib.md5(str(r).encode()).hexdigest() for r in rows)).encode()).hexdigest()
    for rows in ([i % 700 for i in range(3000)] + [5] * 600, []):
        df = sinks.md5_fingerprint(spark.createDataFrame([(r,) for r in rows], "x long").repartition(7), F.col("x").cast("string"))
        assert [tuple(r) for r in df.collect()] == [(len(rows), digest(rows))]
        assert "collect_list" not in df._jdf.queryExecution().toString()  # nothing holds all rows at once
    assert sinks.md5_fingerprint(spark.createDataFrame([(None,), (1,)], "x long"), F.col("x").cast("string")).first() == (2, digest([1]))


def test_fingerprint_query_digests_all_rows_in_order(spark, tmp_path):
    import duckdb
    from eventlens import queries

    rows = [(1, "a", "x"), (2, "a", None), (2, "a", ""), (3, None, "y"), (None, "b", "z")]
    for rows in (rows, []):
        spark.createDataFrame(rows, "event_id long, event_type string, props string").write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        want = duckdb.sql(f"WITH events AS (SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')) {queries.ORACLE_SQL['k09_fingerprint']}").fetchall()
        assert [tuple(r) for r in queries.QUERIES["k09_fingerprint"](spark, str(tmp_path)).collect()] == want


def test_digest_trees_name_what_differs(spark):
    rows = [(i, f"v{i}") for i in range(500)]
    tree = lambda r, d=2: sinks.digest_tree(spark.createDataFrame(r, "k int, v string").repartition(5), F.col("k").cast("string"), F.concat_ws("|", F.col("k").cast("string"), "v"), d)
    one = tree(rows)
    assert one.where("level = 0").first().n == 500 and sinks.differing_ranges(one, tree(rows[::-1])).collect() == []
    changed = [(k, "x" if k == 7 else v) for k, v in rows if k != 300]
    found = sinks.differing_ranges(one, tree(changed)).collect()
    want = {spark.sql(f"SELECT substr(md5('{k}'), 1, 2) AS n").first().n for k in (7, 300)}
    assert {r.node for r in found} == want and sum(r.n - r.n_other for r in found) == 1
    assert tree(rows[:0]).collect() == [] and tree([(None, None)], 1).count() == 2


def test_versioned_tables_and_split(spark, tmp_path):
    t = sinks.Tables(spark, f"file://{tmp_path}/t")
    a = spark.createDataFrame([(1,)], "x int")
    assert t.version() == 0 and t.publish({"a": a, "b": a}) == 1 and t.publish({"a": a.union(a)}, expected=1) == 2
    assert t.read("a").count() == 2 and t.read("a", 1).count() == 1 and t.read("b").count() == 1
    with pytest.raises(RuntimeError):
        t.publish({"a": a}, expected=1)
    tables = {
        "records": spark.createDataFrame([("usgs", "1", "E"), ("gdacs", "EQ:1", "E")], "source_id string, provider_record_id string, event_id string"), "external_ids": spark.createDataFrame([("usgs:1", "E"), ("gdacs:EQ:1", "E")], "external_id string, event_id string"),
        "observations": spark.createDataFrame([("o1", "usgs"), ("o2", "gdacs")], "observation_id string, source_id string"), "evidence": spark.createDataFrame([("E", "o1"), ("E", "o2")], "event_id string, observation_id string"),
        "overrides": spark.createDataFrame([], "source_id string, provider_record_id string, event_id string, reason string, decided_at timestamp"),
    }
    assert {(r.side, r.what): r.n for r in I.preview_split(tables, "E", "gdacs").collect()} == {(s, w): 1 for s in ("moving", "staying") for w in ("records", "keys", "evidence")}
    out = I.split_source(tables, "E", "gdacs", "wrong place", NOW)
    assert {r.external_id: r.event_id for r in out["external_ids"].collect()} == {"usgs:1": "E", "gdacs:EQ:1": "E/split/gdacs"} and out["overrides"].count() == 2


def test_snapshot_document(spark, tmp_path):
    events = spark.createDataFrame([("a", "https://x.org/1"), ("b", "http://10.0.0.1/")], "id string, source_url string")
    sources = spark.createDataFrame([("s1", "ok"), ("s2", "error")], "source_id string, status string")
    sinks.write_snapshot(events, sources, f"file://{tmp_path}/doc", "2024-05-01T10:00:00Z")
    schema = "format string, version int, generated_at string, sources array<struct<source_id:string,status:string>>, events array<struct<id:string,source_url:string>>"
    found, bad = sinks.read_snapshot(spark, f"file://{tmp_path}/doc", schema, NOW)
    assert found.count() == 2 and {(r.id, r.reason) for r in bad.collect()} == {("b", "private_link")}
    with pytest.raises(ValueError, match="too large"):
        sinks.write_snapshot(events, sources, f"file://{tmp_path}/doc2", "x", most_events=1)
    with pytest.raises(ValueError, match="all sources failed"):
        sinks.write_snapshot(events, sources.where("status = 'error'"), f"file://{tmp_path}/doc3", "x")


def test_relations_keep_whole_microseconds(spark):
    """Hours come from microseconds by one division: by way of seconds, some halves of the sixth digit fall to the other side."""
    start, gaps = datetime(2024, 1, 1), [3_600_000_000 + 3600 * i + 1800 for i in range(0, 4000, 7)]
    rows = [(f"a{i}", "weather", start + timedelta(days=2 * i)) for i in range(len(gaps))] + [(f"b{i}", "cyber", start + timedelta(days=2 * i, microseconds=g)) for i, g in enumerate(gaps)]
    e = spark.createDataFrame(rows, "id string, category string, occurred_start timestamp")
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.struct(F.lit(21.0).alias("lon"), F.lit(52.0).alias("lat"))).alias("points"))
    out = J.relate_events(e.withColumns({"geometry": shape, "location_precision": F.lit("point"), "time_precision": F.lit("second")})).collect()
    assert {r.event_a: r.time_delta_hours for r in out} == {f"a{i}": g / 3_600_000_000 for i, g in enumerate(gaps)}


def test_relations_are_the_same_at_any_density(spark):
    import random

    rng = random.Random(3)
    rows = [(f"e{i:03}", rng.choice(["earthquake", "flood", "cyber"]), NOW + timedelta(seconds=rng.choice([rng.randrange(40_000), 60 * (i % 7)])), rng.choice([179.9, -179.9, 30.0]) + rng.random() * 0.7, rng.choice([89.7, 10.0, 10.3]) + rng.random() * 0.2) for i in range(250)]
    schema = "id string, category string, occurred_start timestamp, lon double, lat double"
    e = spark.createDataFrame(rows, schema).selectExpr("id", "category", "occurred_start", "'point' AS location_precision", "'second' AS time_precision", "struct('Point' AS type, array(struct(lon, lat)) AS points) AS geometry").checkpoint()
    found = lambda **how: sorted(map(repr, map(tuple, J.relate_events(e, **how).drop("distance_km").collect())))
    for per_event in (3, 20):
        want = found(per_event=per_event, dense=10**9)
        assert found(per_event=per_event, dense=1) == want and len(want) > 100
    some = e.where("id < 'e060'")
    assert found(changed=some, dense=2) == found(changed=some, dense=10**9)


def test_each_breach_of_the_snapshot_contract_has_a_row(spark, tmp_path):
    pair = lambda *p: [{"source_id": a, "provider_record_id": b} for a, b in p]
    given = [pair(("usgs", "1")), pair(("usgs", "2"), ("gdacs", "2")), pair(("usgs", "1")), [], pair(("usgs", "5")), pair(("usgs", "6"))]
    table = spark.createDataFrame([(i, p) for i, p in enumerate(given)], "n int, pairs array<struct<source_id:string,provider_record_id:string>>")
    ids = {r.n: r.public_id for r in I.public_ids(table).collect()}
    sources = [["usgs"], ["gdacs", "usgs"], ["usgs"], [], ["usgs"], ["gdacs"]]
    events = [{"id": ids[n], "source_ids": sources[n], "evidence": p, "geometry": {"type": "LineString", "coordinates": [[1.5, 2], [-3, 4.25]]}} for n, p in enumerate(given)]
    events[1]["evidence"][0]["raw"] = "{}"
    events[4] |= {"id": "made-up", "secret": 1}
    doc = {"format": "public-events", "version": 1, "generated_at": "2024-05-01T10:00:00Z", "sources": [{"source_id": "usgs", "token": "x"}], "events": events, "notes": []}
    (tmp_path / "doc").write_text(json.dumps(doc))
    schema = "format string, version int, generated_at string, sources array<struct<source_id:string>>, events array<struct<id:string,source_ids:array<string>,evidence:array<struct<source_id:string,provider_record_id:string>>,geometry:struct<type:string>>>"
    schema = schema.replace("evidence:", "source_url:string,evidence:")
    found, bad = sinks.read_snapshot(spark, f"file://{tmp_path}/doc", schema, NOW, most_positions=11)
    want = {(None, "unknown_field"), (None, "geometry_budget"), (ids[1], "unknown_evidence_field"), ("made-up", "unknown_field"), ("made-up", "wrong_id"), (ids[0], "duplicate_evidence"), (ids[0], "repeated_id"), (ids[3], "no_evidence"), (ids[5], "sources_differ")}
    assert found.count() == 6 and {(r.id, r.reason) for r in bad.collect()} == want
    assert bad.where("id IS NULL AND reason = 'unknown_field'").count() == 2  # the document's and a source's
    assert (None, "geometry_budget") not in {(r.id, r.reason) for r in sinks.read_snapshot(spark, f"file://{tmp_path}/doc", schema, NOW)[1].collect()}
