"""Time expressions: nanoseconds since 1970 UTC as LONG are canonical, Spark timestamps for display."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000


def timestamp(ns: Column | str) -> Column:
    """The microsecond timestamp of a nanosecond count (floor, also before 1970)."""
    ns = F.col(ns) if isinstance(ns, str) else ns
    whole = ns - F.pmod(ns, F.lit(1000))
    return F.timestamp_micros(F.call_function("div", whole, F.lit(1000).cast("long")))


def hour_stamp(ns: Column | str) -> Column:
    return F.date_format(timestamp(ns), "yyyyMMddHH")


def day_stamp(ns: Column | str) -> Column:
    return F.date_format(timestamp(ns), "yyyyMMdd")


def readable(ns: Column | str) -> Column:
    """``YYYY-MM-DD HH:MM:SS UTC``, whole seconds (cut off, not rounded)."""
    return F.concat(F.date_format(timestamp(ns), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def parse_readable(text: Column | str) -> Column:
    """Nanoseconds of such a text; null if it is none."""
    t = F.regexp_replace(text, " UTC$", "")
    return F.unix_micros(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss"))) * 1000


def file_stamp(ns: Column | str) -> Column:
    """``YYYYMMDDTHHMMSSZ``, for file names."""
    return F.date_format(timestamp(ns), "yyyyMMdd'T'HHmmss'Z'")


def month_bucket(ns: Column | str) -> Column:
    """Months since January 1970."""
    t = timestamp(ns)
    return (F.year(t) - 1970) * 12 + F.month(t) - 1


def day_range_ns(first: str | dt.date, last: str | dt.date) -> tuple[int, int]:
    """First and last nanosecond of a range of days, both ends included; a reversed range matches nothing."""
    a, b = (d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in (first, last))
    epoch = dt.date(1970, 1, 1)
    return (a - epoch).days * DAY_NS, ((b - epoch).days + 1) * DAY_NS - 1


def prefix_bound(text: str, upper: bool) -> str:
    """A date prefix (``2006``, ``2006-01`` ...) as the least or greatest ``YYYYMMDDHH`` it covers."""
    return text.replace("-", "").ljust(10, "9" if upper else "0")[:10]


def in_prefix_range(stamp: Column | str, start: str | None, end: str | None) -> Column:
    """``YYYYMMDDHH`` strings between two prefixes, both included."""
    stamp = F.col(stamp) if isinstance(stamp, str) else stamp
    ok = F.lit(True)
    if start:
        ok = ok & (stamp >= prefix_bound(start, False))
    if end:
        ok = ok & (stamp <= prefix_bound(end, True))
    return ok
