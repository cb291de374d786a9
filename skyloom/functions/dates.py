"""Dates of feeds, and times."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.text import trimmed


def parse_date(s: Column, batch_time: dt.datetime | Column) -> Column:
    """RFC 822 dates and three ISO forms as timestamps; batch_time for blank and other strings. Without a zone: UTC."""
    t = trimmed(F.coalesce(s, F.lit("")))
    now = batch_time if isinstance(batch_time, Column) else F.lit(batch_time).cast("timestamp")
    rfc = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\s+(?:GMT|UT|UTC|Z)$", " +0000")
    rfc = F.regexp_replace(rfc, r"^(\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{1,2}:\d{2}(?::\d{2})?)$", "$1 +0000")
    full = F.try_to_timestamp(rfc, F.lit("d MMM yyyy H:mm:ss xx"))
    short = F.try_to_timestamp(rfc, F.lit("d MMM yyyy H:mm xx"))
    zoned = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(t, F.lit("T00:00:00Z"))))
    return F.coalesce(full, short, zoned, day, now)


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / F.lit(86400e6)


def hours_since(t: Column, now: Column) -> Column:
    return F.greatest((F.unix_micros(now) - F.unix_micros(t)) / F.lit(3600e6), F.lit(0.0))
