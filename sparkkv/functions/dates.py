"""Date and duration functions; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN, COMPACT, HTTP = "yyyy-MM-dd HH:mm:ss", "yyyyMMddHHmmss", "EEE, dd MMM yyyy HH:mm:ss Z"


def show(ts: Column, pattern: str = PLAIN) -> Column:
    return F.date_format(ts, pattern)


def parse(s: Column, pattern: str = PLAIN) -> Column:
    """Null for what doesn't follow the pattern."""
    return F.try_to_timestamp(s, F.lit(pattern))


def to_hour(ts: Column) -> Column:
    return F.date_trunc("HOUR", ts)


def to_day(ts: Column) -> Column:
    return F.date_trunc("DAY", ts)


def normalised(seconds: Column, micros: Column) -> Column:
    """struct<sec, usec> of a duration, 0 <= usec < 1000000, also for negative ones."""
    total = seconds.cast("long") * 1_000_000 + micros.cast("long")
    usec = F.pmod(total, F.lit(1_000_000).cast("long"))
    return F.struct(((total - usec) / 1_000_000).cast("long").alias("sec"), usec.alias("usec"))
