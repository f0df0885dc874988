"""WGS84 geometry on plain columns: points as lon, lat; rings as array<array<struct<lon, lat>>>."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.functions.arrays import col

EARTH_KM, A_KM, FLATTENING = 6371.0088, 6378.137, 1 / 298.257223563


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def geodesic_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Ellipsoidal distance by the Andoyer-Lambert correction to the great circle over reduced latitudes."""
    reduced = lambda lat: F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))
    b1, b2 = reduced(lat1), reduced(lat2)
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    s = 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * F.pow(F.sin(p) * F.cos(q), 2) / F.greatest(F.pow(F.cos(s / 2), 2), F.lit(1e-15))
    y = (s + F.sin(s)) * F.pow(F.cos(p) * F.sin(q), 2) / F.greatest(F.pow(F.sin(s / 2), 2), F.lit(1e-15))
    return F.when(s < 1e-12, 0.0).otherwise(A_KM * (s - FLATTENING / 2 * (x + y)))


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _on_edge(e: Column, lon: Column, lat: Column) -> Column:
    a, b = e["a"], e["b"]
    cross = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
    return (F.abs(cross) < 1e-12) & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))


def covers(rings: Column | str, lon: Column, lat: Column) -> Column:
    """Point in a multipolygon given by all its rings (even-odd, so holes are out), borders included."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["lon"] + (lat - a["lat"]) / F.when(b["lat"] != a["lat"], b["lat"] - a["lat"]) * (b["lon"] - a["lon"])
        return F.coalesce(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < at), F.lit(False))

    edges = F.flatten(F.transform(col(rings), _edges))
    inside = F.size(F.filter(edges, crosses)) % 2 == 1
    return F.coalesce(inside | F.exists(edges, lambda e: _on_edge(e, lon, lat)), F.lit(False))


def ring_valid(ring: Column | str) -> Column:
    """Closed, 4 or more positions, 3 or more distinct, all on the globe."""
    r = col(ring)
    ok = (F.size(r) >= 4) & (F.get(r, 0) == F.element_at(r, -1)) & (F.size(F.array_distinct(r)) >= 3)
    return F.coalesce(ok & F.forall(r, lambda p: p["lon"].between(-180, 180) & p["lat"].between(-90, 90)), F.lit(False))


def parse_geojson(c: Column | str) -> Column:
    """struct<type, points, rings> of a GeoJSON text; altitudes are dropped, unknown types give null."""
    s = col(c)
    kind = F.get_json_object(s, "$.type")
    coords = F.get_json_object(s, "$.coordinates")
    point = lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat"))
    depth = lambda n: F.from_json(coords, "array<" * n + "double" + ">" * n)
    none_p, none_r = (F.array().cast(f"{'array<' * n}struct<lon:double,lat:double>{'>' * n}") for n in (1, 2))
    points = F.when(kind == "Point", F.array(point(depth(1)))).when(kind == "MultiPoint", F.transform(depth(2), point)).otherwise(none_p)
    ring = lambda r: F.transform(r, point)
    rings = F.when(kind == "Polygon", F.transform(depth(3), ring)).when(kind == "MultiPolygon", F.flatten(F.transform(depth(4), lambda p: F.transform(p, ring)))).otherwise(none_r)
    return F.when(kind.isin("Point", "MultiPoint", "Polygon", "MultiPolygon"), F.struct(kind.alias("type"), points.alias("points"), rings.alias("rings")))


def positions(geometry: Column | str) -> Column:
    """All positions of a geometry struct."""
    g = col(geometry)
    return F.concat(g["points"], F.flatten(g["rings"]))


def bbox(geometry: Column | str) -> Column:
    p = positions(geometry)
    side = lambda f, name: f(F.transform(p, lambda x: x[name]))
    return F.struct(side(F.array_min, "lon").alias("w"), side(F.array_min, "lat").alias("s"), side(F.array_max, "lon").alias("e"), side(F.array_max, "lat").alias("n"))


def intersects_bbox(geometry: Column | str, w: float, s: float, e: float, n: float) -> Column:
    """A position inside, a corner of the box covered, or an edge that crosses the box."""
    g = col(geometry)
    b = bbox(g)
    apart = (b["e"] < w) | (b["w"] > e) | (b["n"] < s) | (b["s"] > n)
    inside = F.exists(positions(g), lambda p: p["lon"].between(w, e) & p["lat"].between(s, n))
    corner = covers(g["rings"], F.lit(float(w)), F.lit(float(s)))
    for x, y in ((w, n), (e, s), (e, n)):
        corner = corner | covers(g["rings"], F.lit(float(x)), F.lit(float(y)))
    sides = [((w, s), (e, s)), ((e, s), (e, n)), ((e, n), (w, n)), ((w, n), (w, s))]

    def crosses(edge: Column) -> Column:
        a, c = edge["a"], edge["b"]
        hit = F.lit(False)
        turn = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
        for (x1, y1), (x2, y2) in sides:
            x1, y1, x2, y2 = map(float, (x1, y1, x2, y2))
            d1, d2 = turn(F.lit(x1), F.lit(y1), F.lit(x2), F.lit(y2), a["lon"], a["lat"]), turn(F.lit(x1), F.lit(y1), F.lit(x2), F.lit(y2), c["lon"], c["lat"])
            d3, d4 = turn(a["lon"], a["lat"], c["lon"], c["lat"], F.lit(x1), F.lit(y1)), turn(a["lon"], a["lat"], c["lon"], c["lat"], F.lit(x2), F.lit(y2))
            hit = hit | ((d1 * d2 <= 0) & (d3 * d4 <= 0))
        return hit

    edge = F.exists(F.flatten(F.transform(g["rings"], _edges)), crosses)
    return F.coalesce(~apart & (inside | corner | edge), F.lit(False))


def distance_to_rings_km(rings: Column | str, lon: Column, lat: Column) -> Column:
    """Distance to an area: 0 inside, else the least over its edges in a local equirectangular projection."""
    k, scale = EARTH_KM * pi / 180, F.cos(F.radians(lat))

    def to_edge(e: Column) -> Column:
        ax, ay = (e["a"]["lon"] - lon) * scale * k, (e["a"]["lat"] - lat) * k
        bx, by = (e["b"]["lon"] - lon) * scale * k, (e["b"]["lat"] - lat) * k
        dx, dy = bx - ax, by - ay
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(-(ax * dx + ay * dy) / F.when(dx * dx + dy * dy > 0, dx * dx + dy * dy), F.lit(0.0))))
        return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))

    return F.when(covers(rings, lon, lat), 0.0).otherwise(F.array_min(F.transform(F.flatten(F.transform(col(rings), _edges)), to_edge)))


def lon_ranges(geometry: Column | str) -> Column:
    """array<struct<lo, hi>>: the longitudes of each ring and point; a ring wider than 180 degrees crosses the dateline."""
    g = col(geometry)

    def ring(r: Column) -> Column:
        xs = F.transform(r, lambda p: p["lon"])
        lo, hi = F.array_min(xs), F.array_max(xs)
        east, west = F.array_min(F.filter(xs, lambda x: x >= 0)), F.array_max(F.filter(xs, lambda x: x < 0))
        return F.when(hi - lo <= 180, F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(F.struct(east.alias("lo"), (west + 360).alias("hi")))

    return F.concat(F.transform(g["points"], lambda p: F.struct(p["lon"].alias("lo"), p["lon"].alias("hi"))), F.transform(g["rings"], ring))


def geometry_ok(c: Column | str, most: int = 1_000_000, deepest: int = 8) -> Column:
    """GeoJSON text within the budget of positions and nesting."""
    s = F.regexp_replace(col(c), r'"(\\.|[^"\\])*"', "")
    n = F.regexp_count(s, F.lit(r"\[\s*-?[0-9]"))  # positions
    nested = s.rlike(r"\[\s*" * (deepest + 1))
    return F.coalesce(F.try_parse_json(col(c)).isNotNull() & (n <= most) & ~nested, F.lit(False))


def mercator_pixel(lon: Column, lat: Column, zoom: int, tile: int = 256) -> Column:
    """struct<x, y>: web-mercator pixel of a point."""
    size = float(tile * 2**zoom)
    y = F.greatest(F.lit(-85.0511), F.least(F.lit(85.0511), lat))
    return F.struct(((lon + 180) / 360 * size).alias("x"), ((0.5 - F.log(F.tan(pi / 4 + F.radians(y) / 2)) / (2 * pi)) * size).alias("y"))
