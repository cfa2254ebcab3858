"""Instants and local days. Instants are UTC; 'now' is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgetrail import dims


def parse_iso(raw: Column) -> Column:
    """ISO date-time to an instant; no offset means UTC; anything else is NULL."""
    date_only = raw.rlike(r"^\d{4}-\d{2}-\d{2}$")
    has_offset = raw.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    text = (
        F.when(date_only, F.concat(raw, F.lit("T00:00:00Z")))
        .when(has_offset, raw)
        .otherwise(F.concat(raw, F.lit("Z")))
    )
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def parse_local(text: Column, tz: str = dims.LOCAL_TZ) -> Column:
    """First 'dd/MM/yyyy H:mm' of a text, read as local time."""
    found = F.regexp_extract(text, r"(\d{2}/\d{2}/\d{4}\s+\d{1,2}:\d{2})", 1)
    tidy = F.nullif(F.regexp_replace(found, r"\s+", " "), F.lit(""))
    return F.to_utc_timestamp(F.try_to_timestamp(tidy, F.lit("dd/MM/yyyy H:mm")), tz)


def local_day(ts: Column, tz: str = dims.LOCAL_TZ) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def local_day_start(as_of: Column, tz: str = dims.LOCAL_TZ) -> Column:
    """The instant of the last local midnight."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(as_of, tz)), tz)


def local_midnight(day: Column, tz: str = dims.LOCAL_TZ) -> Column:
    """The instant a local calendar day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def instant(value: str) -> Column:
    """A literal UTC instant."""
    return F.lit(value if value.endswith("Z") else f"{value}Z").cast("timestamp")
