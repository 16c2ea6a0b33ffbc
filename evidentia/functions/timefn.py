"""Time expressions (DT-*).  Timestamps are UTC; the present is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EngineConfig


def parse_time(c: Column) -> Column:
    """DT-1: canonical, ISO 8601 and RFC 822 forms; no zone means UTC; anything else is null."""
    text = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    text = F.regexp_replace(text, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    forms = ["yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx", "yyyy-MM-dd"]
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))


def to_iso(c: Column) -> Column:
    """DT-2"""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_hours(c: Column, as_of: Column) -> Column:
    """DT-3"""
    return (F.unix_micros(as_of) - F.unix_micros(c)) / F.lit(3.6e9)


def is_future(c: Column, as_of: Column, minutes: int = EngineConfig.future_minutes) -> Column:
    """DT-4"""
    return age_hours(c, as_of) * 60 < -minutes


def is_plausible(c: Column, as_of: Column) -> Column:
    return c.isNotNull() & (c >= F.lit(EngineConfig.earliest).cast("timestamp")) & ~is_future(c, as_of)


def sanitise(published: Column, collected: Column, as_of: Column) -> Column:
    """DT-5: implausible publication times become collection times."""
    return F.when(is_plausible(published, as_of), published).otherwise(collected)


def humanize_age(c: Column, as_of: Column) -> Column:
    """DT-7"""
    minutes = F.floor(F.abs(age_hours(c, as_of)) * 60)
    span = (
        F.when(minutes < 1, F.lit("now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))
    )
    return F.when(c.isNull(), F.lit("unknown")).when(span == "now", F.lit("just now")).when(c > as_of, F.concat(F.lit("in "), span)).otherwise(F.concat(span, F.lit(" ago")))


def countdown(start: Column, as_of: Column) -> Column:
    """DT-8: days, hours, minutes until start; null unless it is ahead."""
    seconds = F.floor((F.unix_micros(start) - F.unix_micros(as_of)) / 1_000_000)
    parts = F.struct(F.floor(seconds / 86400).alias("days"), F.floor(seconds % 86400 / 3600).alias("hours"), F.floor(seconds % 3600 / 60).alias("minutes"))
    return F.when(start > as_of, parts)


#: Abbreviations of time zones as broadcasters print them.
ZONES = {
    "America/New_York": ["ET", "EDT", "EST"], "America/Chicago": ["CT", "CDT", "CST"], "America/Denver": ["MT", "MDT", "MST"], "America/Los_Angeles": ["PT", "PDT", "PST"],
    "Europe/London": ["BST", "GMT"], "Europe/Paris": ["CET", "CEST"], "Australia/Sydney": ["AEST", "AEDT"], "Asia/Dubai": ["GST"], "Asia/Riyadh": ["AST"],
    "Asia/Singapore": ["SGT"], "Asia/Tokyo": ["JST"], "America/Sao_Paulo": ["BRT"],
}


def zone_of(text: Column) -> Column:
    """DT-9: the zone of the first abbreviation that a text holds; null for none."""
    short = {s: zone for zone, names in ZONES.items() for s in names}
    found = F.regexp_extract(text, rf"\b({'|'.join(sorted(short, key=len, reverse=True))})\b", 1)
    return F.coalesce(*(F.when(found.isin(names), F.lit(zone)) for zone, names in ZONES.items()))


def printed_date(text: Column) -> Column:
    """DT-9: the first date that a text shows, as "October 31, 2026" or "2026-10-31"; null for none."""
    worded = F.regexp_extract(text, r"([A-Z][a-z]{2,8}\s+\d{1,2},\s+\d{4})", 1)
    plain = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    one = F.regexp_replace(worded, r"\s+", " ")
    return F.to_date(F.coalesce(F.try_to_timestamp(one, F.lit("MMMM d, yyyy")), F.try_to_timestamp(one, F.lit("MMM d, yyyy")), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd"))))


def city_of(location: Column) -> Column:
    """DT-10: a location without its venue, the part before the first comma; a lone part stays."""
    parts = F.filter(F.transform(F.split(location, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.nullif(F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), ", ")).otherwise(F.get(parts, F.lit(0))), F.lit(""))


def schedule(early: Column, prelims: Column, main: Column, printed: Column, hours: int = EngineConfig.event_hours) -> Column:
    """DT-10: start, end, date and zone of an event from up to three epochs of its segments and its printed date."""
    start = F.timestamp_seconds(F.array_min(F.array(early, prelims, main)))
    return F.struct(start.alias("start"), (start + F.expr(f"INTERVAL {hours} HOURS")).alias("end"), F.coalesce(F.to_date(start), printed_date(printed)).alias("date"), zone_of(printed).alias("zone"))


def decode(c: Column, schema: str, default: Column) -> Column:
    """JS-1: a JSON column in its shape; bad data gives the default."""
    return F.coalesce(F.from_json(c, schema), default)


def to_zone(c: Column, zone: Column, known: list[str]) -> Column:
    """DT-6: wall-clock time in the venue's zone; unknown zones are UTC."""
    return F.from_utc_timestamp(c, F.when(zone.isin(known), zone).otherwise(F.lit("UTC")))
