"""Schemas, enumerations and fixed dimensions."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

#: Categories, kinds, states, default time bases and severity labels of the event contract (fixed values).
CATEGORIES = ("earthquake", "disaster", "weather", "aviation", "cyber", "internet", "space_weather")
KINDS = ("incident", "advisory", "measurement", "publication")
LIFECYCLES = ("active", "expired", "withdrawn", "unknown")
DEFAULT_BASIS = {"earthquake": "occurred", "disaster": "occurred", "weather": "validity", "aviation": "validity", "cyber": "published", "internet": "published", "space_weather": "published"}
SEVERITY_LABELS = {0: "unknown", 1: "minor", 2: "moderate", 3: "severe", 4: "extreme"}

#: Countries of the Europe scope (fixed values).
EUROPE = "AL AD AT BE BA BG BY CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MD ME MK MT NL NO PL PT RO RS SE SI SK SM UA VA XK".split()
#: Bounding box of Europe: west, south, east, north.
EUROPE_BOX = (-25.0, 34.0, 45.0, 72.0)

#: id, name, category, poll seconds, needs a key, priority in a projection (fixed values).
SOURCES = [
    ("usgs", "Earthquakes", "earthquake", 300, False, 0),
    ("gdacs", "Disasters", "disaster", 900, False, 1),
    ("meteoalarm", "Weather warnings", "weather", 900, False, 0),
    ("easa_czib", "Aviation bulletins", "aviation", 3600, False, 0),
    ("cisa_kev", "Exploited vulnerabilities", "cyber", 3600, False, 0),
    ("cert_pl", "CERT index", "cyber", 1800, False, 2),
    ("imgw_hydro", "Hydrological warnings", "weather", 900, False, 2),
    ("nasa_eonet", "Natural events", "disaster", 1800, False, 2),
    ("noaa_swpc", "Space weather", "space_weather", 300, False, 2),
    ("github_status", "Status of GitHub", "internet", 300, False, 2),
    ("cloudflare_status", "Status of Cloudflare", "internet", 300, False, 2),
    ("cloudflare_radar", "Internet outages", "internet", 900, True, 0),
]

RAW_DOCUMENT = "source_id string, url string, status int, content_type string, fetched_at timestamp, not_modified boolean, body string"
GEOMETRY = "struct<type:string,points:array<struct<lon:double,lat:double>>,rings:array<array<struct<lon:double,lat:double>>>>"

#: Columns of a normalized event, in order.
EVENT_COLUMNS = {
    "source_id": "string", "provider_record_id": "string", "kind": "string", "category": "string", "title": "string", "description": "string", "source_url": "string",
    "occurred_start": "timestamp", "occurred_end": "timestamp", "issued_at": "timestamp", "source_updated_at": "timestamp", "valid_from": "timestamp", "valid_to": "timestamp",
    "countries": "array<string>", "geometry": GEOMETRY, "location_precision": "string", "time_precision": "string", "severity": "int", "original_severity": "string", "severity_reason": "string",
    "lifecycle_status": "string", "verification_status": "string", "origins": "array<string>", "external_ids": "array<string>", "supersedes": "array<string>", "tags": "array<string>",
    "raw": "string", "raw_hash": "string", "is_current": "boolean", "episode_id": "string", "sender": "string", "source_snapshot_at": "timestamp",
}
#: What is known of a source after its reads, and what a read reports of itself.
SOURCE_STATE = (
    "source_id string, status string, last_attempt_at timestamp, last_success_at timestamp, newest_content_at timestamp, record_count bigint, failures int, initialized boolean, last_complete_at timestamp, last_repair_at timestamp,"
    " latest_snapshot_at timestamp, latest_observed_fetched_at timestamp, latest_observed_ingested_at timestamp, current_list_fetched_at timestamp, current_list_ingested_at timestamp"
)
BATCH_REPORT = "source_id string, provider_timestamp timestamp, warnings int, partial boolean, truncated boolean, repair_window boolean, current_list_complete boolean, current_list_fetched_at timestamp"
QUARANTINE = "source_id string, url string, record_id string, reason string, raw string"


@dataclass(frozen=True)
class EventQuery:
    """One filter contract over four time bases."""

    window_hours: int = 24
    time_basis: str = "occurred"
    since: datetime | None = None
    until: datetime | None = None
    country: str | None = None
    region: str | None = None
    category: str | None = None
    severity_min: int = 0
    min_sources: int = 1
    lat: float | None = None
    lon: float | None = None
    radius_km: float | None = None
    include_inactive: bool | None = None
    limit: int = 300
    extra: dict = field(default_factory=dict)
