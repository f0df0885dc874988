"""Clock functions. The session time zone is UTC; nothing reads the current time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.functions.arrays import col, has_tag

DAY_TAG = "date_only_utc_anchor"
#: Clock column of each time basis (fixed values).
BASIS_CLOCK = {"occurred": "occurred_start", "changed": "last_changed_at", "published": "issued_at", "validity": "valid_from"}

_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?\s*(Z|[+-]\d{2}:?\d{2})$"


def _zone(s: Column) -> Column:
    """ISO text with a T, seconds and a colon in its offset."""
    s = F.regexp_replace(F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}) ", "$1T"), r"\s+", "")
    s = F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}T\d{2})(Z|[+-])", "$1:00$2")
    return F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})(Z|[+-])", "$1:00$2")


def parse_ts(c: Column | str, date_only: bool = False, day_first: bool = False) -> Column:
    """struct<ts timestamp, precision string> of an ISO or RFC 2822 text; an offset is mandatory.

    Precision: second, minute, hour or day. date_only admits a bare day (anchored at UTC midnight), day_first also
    dd/MM/yyyy. Anything else gives null and `unknown`.
    """
    s = F.trim(col(c))
    iso = s.rlike(_ISO)
    ts = F.when(iso, F.try_to_timestamp(_zone(s)))
    precision = F.when(s.rlike(r"[T ]\d{2}:\d{2}:\d{2}"), "second").when(s.rlike(r"[T ]\d{2}:\d{2}"), "minute").otherwise("hour")
    mail = F.regexp_replace(F.regexp_replace(s, r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|UT|Z)$", "+0000")
    is_mail = mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(:\d{2})? [+-]\d{4}$")
    full = F.regexp_replace(mail, r"(\d{4} \d{2}:\d{2}) ", "$1:00 ")
    ts = F.coalesce(ts, F.when(is_mail, F.try_to_timestamp(full, F.lit("d MMM yyyy HH:mm:ss xx"))))
    precision = F.when(is_mail & ~mail.rlike(r"\d{2}:\d{2}:\d{2}"), "minute").when(is_mail, "second").otherwise(precision)
    day = F.lit(None).cast("timestamp")
    if date_only:
        day = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))
    if day_first:
        day = F.coalesce(day, F.when(s.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(s, F.lit("dd/MM/yyyy"))))
    return F.struct(F.coalesce(ts, day).alias("ts"), F.when(ts.isNotNull(), precision).when(day.isNotNull(), "day").otherwise("unknown").alias("precision"))


def epoch_ms(c: Column | str) -> Column:
    """Milliseconds since 1970 as a timestamp; null outside years 1 to 9999 and for anything not a whole number."""
    n = col(c).try_cast("bigint")
    return F.when(n.between(-62135596800000, 253402300799999), F.timestamp_millis(n))


def parse_bulletin_ts(c: Column | str) -> Column:
    """`YYYY Mon DD HHMM UTC`."""
    s = F.regexp_replace(F.trim(col(c)), r"\s+", " ")
    return F.when(s.rlike(r"^\d{4} [A-Z][a-z]{2} \d{1,2} \d{4} UTC$"), F.try_to_timestamp(F.regexp_replace(s, " UTC$", ""), F.lit("yyyy MMM d HHmm")))


def strict_local_to_utc(c: Column | str, tz: str) -> Column:
    """struct<ts, reason> of a wall time in a zone: null with `gap` or `overlap` where it is missing or ambiguous."""
    wall = col(c)
    utc = F.to_utc_timestamp(wall, tz)
    gap = F.from_utc_timestamp(utc, tz) != wall
    hour = F.expr("INTERVAL 1 HOUR")
    twice = (F.from_utc_timestamp(utc - hour, tz) == wall) | (F.from_utc_timestamp(utc + hour, tz) == wall)
    return F.struct(F.when(~gap & ~twice, utc).alias("ts"), F.when(gap, "gap").when(twice, "overlap").alias("reason"))


def calendar_window(name: str, now: Column | str, tz: str) -> Column:
    """struct<since, until> of `today`, `yesterday` or `since_06` in a zone, both UTC; null on a clock change."""
    local = F.from_utc_timestamp(col(now), tz)
    today = F.date_trunc("day", local)
    at = lambda t: strict_local_to_utc(t, tz)["ts"]
    if name == "today":
        return F.struct(at(today).alias("since"), col(now).alias("until"))
    if name == "yesterday":
        return F.struct(at(today - F.expr("INTERVAL 1 DAY")).alias("since"), at(today).alias("until"))
    if name == "since_06":
        six = today + F.expr("INTERVAL 6 HOURS")
        six = F.when(local < six, six - F.expr("INTERVAL 1 DAY")).otherwise(six)
        return F.struct(at(six).alias("since"), col(now).alias("until"))
    raise ValueError(name)


def day_span(c: Column | str) -> Column:
    """struct<start, end> of the UTC day of an anchored clock."""
    start = F.date_trunc("day", col(c))
    return F.struct(start.alias("start"), (start + F.expr("INTERVAL 1 DAY")).alias("end"))


def display_time(c: Column | str, precision: Column | str, exclusive_end: bool = False) -> Column:
    """Text with no more digits than the precision allows; an exclusive day end shows the day before."""
    t, p = col(c), col(precision)
    day = F.date_sub(t.cast("date"), 1) if exclusive_end else t.cast("date")
    return F.when(t.isNull(), None).when(p == "day", F.date_format(day, "yyyy-MM-dd")).when(p == "hour", F.date_format(t, "yyyy-MM-dd HH'h' 'UTC'")).when(p == "minute", F.date_format(t, "yyyy-MM-dd HH:mm 'UTC'")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss 'UTC'"))


def local_day(c: Column | str, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(col(c), tz))


def age_bucket(c: Column | str, now: Column) -> Column:
    """fresh (2 h), recent (24 h), old or future by more than 5 minutes; unknown for null."""
    age = F.unix_timestamp(now) - F.unix_timestamp(col(c))
    return F.when(age.isNull(), "unknown").when(age < -300, "future").when(age <= 7200, "fresh").when(age <= 86400, "recent").otherwise("old")


def basis_clock(basis: str) -> Column:
    return F.col(BASIS_CLOCK[basis])


def is_iso_ts(c: Column | str) -> Column:
    """A real calendar moment with an offset and minutes."""
    s = F.trim(col(c))
    return F.coalesce(s.rlike(_ISO) & s.rlike(r"[T ]\d{2}:\d{2}") & F.try_to_timestamp(_zone(s)).isNotNull(), F.lit(False))


def in_future(c: Column | str, now: Column, tolerance: str) -> Column:
    """Later than now by more than a tolerance such as `5 MINUTES`; null is not."""
    return F.coalesce(col(c) > now + F.expr(f"INTERVAL {tolerance}"), F.lit(False))


def is_day_anchor(tags: Column | str = "tags") -> Column:
    return has_tag(tags, DAY_TAG)
