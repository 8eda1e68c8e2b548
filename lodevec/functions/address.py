"""Addresses: frame addresses, archive file names, URLs and local paths.

The formats (``<site>/<YYYY>/<site>_..._<YYYYMMDDHH>_v01.cdf`` and the like) are fixed values of the archive.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The archive's file name and address patterns.
FILE_NAME = r"asi_l1_([a-z0-9]{4})_([0-9]{10})_v([0-9]{2})\.cdf"
FILE_PATTERN = "asi_l1_{site}_{hour}_v01.cdf"
LINK = r'href="([^"?]+)"'
BASE = "https://example.org/asi"


def parse_hour(when: str | dt.date | dt.datetime) -> tuple[str, str]:
    """``(YYYY-MM-DD, HH)`` of a date, a datetime or a text; a date alone means hour 00.

    Digit strings must have 8 or 10 digits; parts below the hour are ignored.
    """
    if isinstance(when, dt.datetime):
        return when.strftime("%Y-%m-%d"), when.strftime("%H")
    if isinstance(when, dt.date):
        return when.isoformat(), "00"
    text = when.strip()
    if text.isdigit():
        if len(text) not in (8, 10):
            raise ValueError(f"{when!r}: a digit string is YYYYMMDD or YYYYMMDDHH")
        day = dt.datetime.strptime(text[:8], "%Y%m%d")
        hour = int(text[8:] or 0)
        if hour > 23:
            raise ValueError(f"{when!r}: no such hour")
        return day.strftime("%Y-%m-%d"), f"{hour:02d}"
    text = text.removesuffix("Z").removesuffix(" UTC").strip()
    if m := re.fullmatch(r"(\d{4}-\d{2}-\d{2})[ T](\d{2})", text):
        return dt.date.fromisoformat(m[1]).isoformat(), f"{dt.time(int(m[2])).hour:02d}"
    try:
        return parse_hour(dt.datetime.fromisoformat(text))
    except ValueError as e:
        raise ValueError(f"{when!r} is no date or hour") from e


def hour_of(text: Column | str) -> Column:
    """``YYYYMMDDHH`` of a text column in any of those forms, null if it has none."""
    t = F.trim(text)
    digits = F.regexp_replace(t, r"[^0-9]", "")
    plain = t.rlike(r"^[0-9]+$")
    ok = F.when(plain, F.length(t).isin(8, 10)).otherwise(t.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?)?( UTC|Z)?$"))
    stamp = F.rpad(F.substring(digits, 1, 10), 10, "0")
    return F.when(ok & F.try_to_timestamp(stamp, F.lit("yyyyMMddHH")).isNotNull(), stamp)


def name_parts(path: Column | str) -> tuple[Column, Column, Column]:
    """``(site, YYYY, YYYYMMDDHH)`` named by a file path; nulls if its name has another form."""
    site, hour = F.nullif(F.regexp_extract(path, FILE_NAME, 1), F.lit("")), F.nullif(F.regexp_extract(path, FILE_NAME, 2), F.lit(""))
    return site, F.substring(hour, 1, 4), hour


def archive_path(site: Column | str, hour: Column | str) -> Column:
    """``<site>/<YYYY>/<file>`` below an archive's root."""
    return F.concat_ws("/", site, F.substring(hour, 1, 4), F.concat(F.lit("asi_l1_"), site, F.lit("_"), hour, F.lit("_v01.cdf")))


def url(site: Column | str, hour: Column | str, base: str = BASE) -> Column:
    return F.concat_ws("/", F.lit(base), archive_path(site, hour))


def local_path(root: str, site: Column | str, hour: Column | str) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), archive_path(site, hour))


def url_to_local(root: str, link: Column | str, base: str = BASE) -> Column:
    return F.concat(F.lit(root.rstrip("/")), F.substring_index(link, base, -1))


def shard_hour(path: Column | str) -> Column:
    """The ten-digit hour in a shard path, null if it has none."""
    return F.nullif(F.regexp_extract(path, r"(?:^|[^0-9])([0-9]{10})(?:[^0-9]|$)", 1), F.lit(""))


def file_name(site: Column | str, ns: Column | str) -> Column:
    """Name of a result file: ``<site>_<YYYYMMDDTHHMMSSZ>.csv``."""
    from lodevec.functions.when import file_stamp

    return F.concat(site, F.lit("_"), file_stamp(ns), F.lit(".csv"))
