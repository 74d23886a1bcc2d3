"""Time to live. The time of reading is always given, so results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SECONDS = 3600


def expiry(written: Column, seconds: Column | None = None, default: int = DEFAULT_SECONDS) -> Column:
    """When a value written at ``written`` ends; ``default`` where no time is given."""
    s = F.lit(default) if seconds is None else F.coalesce(seconds, F.lit(default))
    return written + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s.cast("decimal(18,6)"))


def live(kv: DataFrame, written: str, now: Column, seconds: Column | None = None, enabled: bool = True) -> DataFrame:
    """Rows that haven't ended by ``now``; all if the feature is off."""
    return kv.where(expiry(F.col(written), seconds) > now) if enabled else kv


def ended(kv: DataFrame, written: str, now: Column, seconds: Column | None = None) -> DataFrame:
    """What a sweep would remove."""
    return kv.where(expiry(F.col(written), seconds) <= now)
