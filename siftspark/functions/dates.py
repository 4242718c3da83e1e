"""Dates of posts and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

PERIODS = {"PAST_24_HOURS": 1, "PAST_2_DAYS": 2, "PAST_WEEK": 7, "PAST_2_WEEKS": 14, "PAST_MONTH": 30, "PAST_2_MONTHS": 60, "PAST_YEAR": 365, "PAST_2_YEARS": 730}


def post_time(s) -> Column:
    """A post's timestamp in any of the usual forms, naive ones as UTC, null if none fits."""
    s = F.trim(_c(s))
    return F.coalesce(
        F.try_to_timestamp(F.substring(s, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy")),
        F.try_to_timestamp(F.when(s.rlike(r"^\d{4}-\d\d-\d\d_"), F.regexp_replace(s, r"_[A-Za-z]+$", "")), F.lit("yyyy-MM-dd_HH:mm:ss")),
        F.when(s.rlike(r"^\d{4}-\d\d-\d\d"), s.try_cast("timestamp")),
    )


def local_post_time(s) -> Column:
    """As post_time, but the clock time as written, whatever its offset."""
    return post_time(F.regexp_replace(F.regexp_replace(_c(s), r"[+-]\d{4} ", "+0000 "), r"(Z|[+-]\d\d:?\d\d)$", ""))


def iso_millis(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def hour(ts) -> Column:
    return F.date_trunc("hour", _c(ts))


def seconds_to_hour(ts) -> Column:
    return (F.unix_timestamp(F.date_trunc("hour", _c(ts))) + 3601 - F.unix_timestamp(_c(ts))).cast("long")


def period_start(name, now) -> Column:
    days = F.create_map(*(F.lit(v) for p in PERIODS.items() for v in p))
    return F.date_trunc("minute", _c(now)) - F.make_interval(days=F.try_element_at(days, _c(name)))


def in_range(ts, start, end) -> Column:
    """A missing bound is no bound; a missing date is outside."""
    ts, start, end = map(_c, (ts, start, end))
    return ts.isNotNull() & (start.isNull() | (ts >= start)) & (end.isNull() | (ts <= end))


def minute(ts) -> Column:
    return F.date_trunc("minute", _c(ts))


def ticks(since, now, seconds: int) -> Column:
    return F.floor((F.unix_timestamp(_c(now)) - F.unix_timestamp(_c(since))) / seconds).cast("long")


def blocked_date(ts, start, end) -> Column:
    """A dated page outside bounds that are set; undated pages pass."""
    bounded = _c(start).isNotNull() | _c(end).isNotNull()
    return bounded & _c(ts).isNotNull() & ~in_range(ts, start, end)
