"""Scalar functions at their edges."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventlens.functions import arrays, geo, severity, text, time


def one(spark, *columns):
    r = spark.range(1).select(*columns).first()
    return r[0] if len(columns) == 1 else tuple(r)


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("2024-03-01T10:00:00Z", (datetime(2024, 3, 1, 10), "second")), ("2024-03-01T10:00+02:00", (datetime(2024, 3, 1, 8), "minute")), ("2024-03-01T10Z", (datetime(2024, 3, 1, 10), "hour")),
        ("2024-03-01T10:00:00", (None, "unknown")), ("Fri, 01 Mar 2024 10:00:30 GMT", (datetime(2024, 3, 1, 10, 0, 30), "second")), ("1 Mar 2024 10:00 +0100", (datetime(2024, 3, 1, 9), "minute")),
        ("2024-03-01", (datetime(2024, 3, 1), "day")), ("31/12/2024", (datetime(2024, 12, 31), "day")), ("2024-02-30T00:00:00Z", (None, "unknown")), ("2024-03-01T10:00:00.250-0300", (datetime(2024, 3, 1, 13, 0, 0, 250000), "second")), (None, (None, "unknown")), ("soon", (None, "unknown")),
    ],
)
def test_parse_ts(spark, value, want):
    assert tuple(one(spark, time.parse_ts(F.lit(value).cast("string"), date_only=True, day_first=True))) == want


def test_strict_wall_time(spark):
    at = lambda s: one(spark, time.strict_local_to_utc(F.lit(datetime.fromisoformat(s)).cast("timestamp"), "Europe/Warsaw"))
    assert tuple(at("2024-03-31T02:30:00")) == (None, "gap")
    assert tuple(at("2024-10-27T02:30:00")) == (None, "overlap")
    assert tuple(at("2024-07-01T12:00:00")) == (datetime(2024, 7, 1, 10), None)


def test_clocks(spark):
    now = F.lit(datetime(2024, 5, 2, 3)).cast("timestamp")
    assert tuple(one(spark, time.calendar_window("yesterday", now, "Europe/Warsaw"))) == (datetime(2024, 4, 30, 22), datetime(2024, 5, 1, 22))
    assert one(spark, time.calendar_window("since_06", now, "Europe/Warsaw"))["since"] == datetime(2024, 5, 1, 4)
    assert one(spark, time.parse_bulletin_ts(F.lit("2024 Aug 26 0435 UTC"))) == datetime(2024, 8, 26, 4, 35)
    assert one(spark, time.epoch_ms(F.lit("x"))) is None and one(spark, time.epoch_ms(F.lit("1000"))) == datetime(1970, 1, 1, 0, 0, 1)
    assert one(spark, time.display_time(F.lit(datetime(2024, 5, 3)).cast("timestamp"), F.lit("day"), exclusive_end=True)) == "2024-05-02"
    assert one(spark, time.in_future(F.lit(datetime(2024, 5, 2, 3, 6)).cast("timestamp"), now, "5 MINUTES")) is True


def test_text(spark):
    assert one(spark, text.plain(F.lit("<p>A&amp;B</p><script>x</script> <b>c</b>&#233;\x07<br>d"))) == "A&B cé d"
    assert one(spark, text.fold(F.lit("ŁÓDŹ Ça"))) == "lodz ca"
    assert one(spark, text.one_line(F.lit("a‮\nb"), 10)) == "a b" and one(spark, text.one_line(F.lit("x" * 20), 5)) == "xxxx…"
    assert one(spark, text.identifier(F.lit(" a b"))) is None and one(spark, text.identifier(F.lit(" ab "))) == "ab"
    safe = lambda u: one(spark, text.safe_url(F.lit(u)))
    assert safe("https://a.org/x") and not safe("https://u:p@a.org/") and not safe("ftp://a.org") and not safe("javascript:1")
    public = lambda u: one(spark, text.is_public_url(F.lit(u)))
    assert [public(u) for u in ("https://a.org:443/", "http://10.1.1.1/", "http://8.8.8.8/", "https://localhost/", "https://a.local/", "https://a.org:8080/", "http://172.20.1.1/", "x")] == [True, False, True, False, False, False, False, False]


def test_arrays_and_ladders(spark):
    lit = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, arrays.norm_array(lit("b", "a", "b", None))) == ["a", "b"]
    assert one(spark, arrays.unique_keep_order(lit("b", "a", "b"))) == ["b", "a"]
    assert one(spark, arrays.drop_tag(arrays.add_tag(lit("x"), "y"), "x")) == ["y"]
    urls = lit("https://earthquake.usgs.gov/earthquakes/eventpage/us7000abcd/executive", "https://www.gdacs.org/report.aspx?eventtype=EQ&eventid=14", "https://x.org")
    assert one(spark, arrays.upstream_ids(urls)) == ["gdacs:EQ:14", "usgs:us7000abcd"]
    assert one(spark, arrays.owns_key(F.lit("usgs"), F.lit("usgs:1"))) is True and one(spark, arrays.owns_key(F.lit("gdacs"), F.lit("usgs:1"))) is False
    assert [one(spark, severity.severity_from_magnitude(F.lit(m).cast("double"))) for m in (7.0, 5.5, 4.0, 1.0, None)] == [4, 3, 2, 1, 0]
    assert one(spark, severity.finite_between(F.lit("NaN"), 0, 1)) is None


def test_geometry(spark):
    d = lambda f: one(spark, f(F.lit(21.0122), F.lit(52.2297), F.lit(19.945), F.lit(50.0647)))
    assert abs(d(geo.haversine_km) - 252.0) < 0.5 and abs(d(geo.geodesic_km) - 252.3) < 0.7
    equator = one(spark, geo.geodesic_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    meridian = one(spark, geo.geodesic_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert abs(equator - 111.3195) < 0.01 and abs(meridian - 110.5744) < 0.01
    poly = F.lit('{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,10],[0,0]],[[4,4],[6,4],[6,6],[4,6],[4,4]]]}')
    g = geo.parse_geojson(poly)
    at = lambda x, y: one(spark, geo.covers(g["rings"], F.lit(float(x)), F.lit(float(y))))
    assert [at(1, 1), at(5, 5), at(0, 5), at(4, 5), at(11, 5), at(10, 10)] == [True, False, True, True, False, True]
    assert one(spark, geo.intersects_bbox(g, -1, 3, 11, 4)) is True and one(spark, geo.intersects_bbox(g, 11, 11, 12, 12)) is False and one(spark, geo.intersects_bbox(g, -50, -50, 50, 50)) is True
    assert one(spark, geo.distance_to_rings_km(g["rings"], F.lit(11.0), F.lit(5.0))) == pytest.approx(110.8, abs=0.5)
    assert one(spark, geo.ring_valid(g["rings"][0])) is True and one(spark, geo.ring_valid(F.slice(g["rings"][0], 1, 3))) is False
    assert one(spark, geo.geometry_ok(poly)) is True and one(spark, geo.geometry_ok(F.lit("[" * 9 + "1" + "]" * 9))) is False and one(spark, geo.geometry_ok(F.lit("{"))) is False
    line = geo.parse_geojson(F.lit('{"type":"Polygon","coordinates":[[[170,0],[-170,0],[-170,10],[170,10],[170,0]]]}'))
    assert tuple(one(spark, geo.lon_ranges(line))[0]) == (170.0, 190.0)


def test_questions_use_each_word_once(spark):
    from eventlens.functions import text

    rows = [("BY oraz by", ["BY"], [], "oraz"), ("by pl", ["PL"], [], "by"), (None, [], [], ""), ("flood disaster, flood", [], ["disaster", "weather"], ","), ("disaster", [], ["disaster"], ""), ("kevlar plan", [], [], "kevlar plan")]
    df = spark.createDataFrame([(r[0],) for r in rows], "q string").select("q", text.tag_question("q").alias("t"))
    assert [(r.q, r.t.countries, r.t.categories, r.t.rest) for r in df.collect()] == rows
