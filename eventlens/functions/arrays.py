"""Array, tag and key helpers (Column to Column)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key prefixes that a source owns (fixed values).
OWNED_PREFIXES = {"usgs": ("usgs:",), "gdacs": ("gdacs:",), "meteoalarm": ("cap:",), "cisa_kev": ("cve:",), "cert_pl": ("cert_pl:",), "nasa_eonet": ("eonet:",), "noaa_swpc": ("swpc:",), "imgw_hydro": ("imgw:hydro:",), "easa_czib": ("easa:czib:",), "github_status": ("github_status:",), "cloudflare_status": ("cloudflare_status:",), "cloudflare_radar": ("cloudflare:outage:",)}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_array(c: Column | str) -> Column:
    """Sorted, distinct, without nulls; null becomes empty."""
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(col(c), F.array().cast("array<string>")))))


def unique_keep_order(c: Column | str) -> Column:
    """Distinct values in order of first occurrence, without nulls."""
    return F.array_distinct(F.array_compact(col(c)))


def has_tag(tags: Column | str, tag: str) -> Column:
    return F.coalesce(F.array_contains(col(tags), tag), F.lit(False))


def add_tag(tags: Column | str, tag: str) -> Column:
    return F.array_sort(F.array_union(F.coalesce(col(tags), F.array().cast("array<string>")), F.array(F.lit(tag))))


def drop_tag(tags: Column | str, tag: str) -> Column:
    return F.array_except(F.coalesce(col(tags), F.array().cast("array<string>")), F.array(F.lit(tag)))


def set_tag(tags: Column | str, tag: str, on: Column) -> Column:
    return F.when(on, add_tag(tags, tag)).otherwise(drop_tag(tags, tag))


def origin_family(c: Column | str) -> Column:
    """Lineage family of an origin: null for empty and unknown ones."""
    o = F.lower(F.trim(col(c)))
    return F.when((o == "") | o.startswith("unknown:"), None).when(o.startswith("usgs:"), "usgs").when(o.isin("gwis", "firms"), "nasa:firms").otherwise(o)


def upstream_ids(urls: Column | str) -> Column:
    """Hard ids named by links: quake event pages and disaster reports."""

    def one(u: Column) -> Column:
        quake = F.regexp_extract(u, r"^https?://earthquake\.usgs\.gov/earthquakes/eventpage/([A-Za-z0-9]+)", 1)
        event, kind = F.try_parse_url(u, F.lit("QUERY"), F.lit("eventid")), F.try_parse_url(u, F.lit("QUERY"), F.lit("eventtype"))
        return F.when(quake != "", F.concat(F.lit("usgs:"), F.lower(quake))).when(F.contains(u, F.lit("gdacs.org")) & event.rlike("^[0-9]+$") & kind.isNotNull(), F.concat_ws(":", F.lit("gdacs"), F.upper(kind), event))

    return norm_array(F.transform(col(urls), one))


def allow_fields(c: Column | str, names: Iterable[str]) -> Column:
    """A map or a struct cut to the named fields."""
    names = list(names)
    return F.map_filter(col(c), lambda k, _: k.isin(names))


def owns_key(source: Column | str, key: Column | str) -> Column:
    """Whether a hard key belongs to a source: by its prefix, or as the source's own record key."""
    own = F.startswith(col(key), F.concat(F.lit("record:"), col(source), F.lit(":")))
    for name, prefixes in OWNED_PREFIXES.items():
        for p in prefixes:
            own = own | ((col(source) == name) & F.startswith(col(key), F.lit(p)))
    return own


def canonical_map(c: Column | str) -> Column:
    """A map with its entries sorted by key."""
    return F.map_from_entries(F.array_sort(F.map_entries(col(c))))
