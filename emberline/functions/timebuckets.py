"""Time parsing, date keys and time buckets. The session time zone is expected to be UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts tried after the ISO one; day first only where month first is impossible.
TIMESTAMP_LAYOUTS = (
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy",
    "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy",
)

_CALENDAR = {"P1D": "day", "P1W": "week", "P1M": "month", "P3M": "quarter", "P1Y": "year", "PT1H": "hour", "PT1M": "minute"}
_SECONDS = {"S": 1, "M": 60, "H": 3600, "D": 86400}


def parse_timestamp(c: Column) -> Column:
    """Timestamp from text in one of the known layouts, null if none fits."""
    return F.coalesce(
        c.try_cast("timestamp"),
        *[F.try_to_timestamp(c, F.lit(layout)) for layout in TIMESTAMP_LAYOUTS],
    )


def date_key(ts: Column) -> Column:
    """``yyyyMMdd`` as INT, 0 for a missing time."""
    return F.coalesce(F.year(ts) * 10000 + F.month(ts) * 100 + F.day(ts), F.lit(0))


def timestamp_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, the epoch for a missing time."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("1970-01-01 00:00:00"))


def time_floor(ts: Column, period: str) -> Column:
    """Start of the ISO-8601 ``period`` (``PT1M``, ``PT15M``, ``PT1H``, ``P1D``, ``P1M``, ``P1Y`` ...) that holds ``ts``."""
    unit = _CALENDAR.get(period)
    if unit:
        return F.date_trunc(unit, ts)
    match = re.fullmatch(r"PT(\d+)([SMH])|P(\d+)(D)", period)
    if not match:
        raise ValueError(f"unsupported period {period!r}")
    count, letter = (match[1], match[2]) if match[1] else (match[3], match[4])
    step = int(count) * _SECONDS[letter]
    seconds = F.unix_timestamp(ts.cast("timestamp"))
    return F.timestamp_seconds(F.floor(seconds / step) * step)
