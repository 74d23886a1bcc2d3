"""Gateway routing and its analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def byte_sum(s: Column) -> Column:
    """Sum of the UTF-8 bytes of ``s``, from the pairs of its hexadecimal form."""
    pairs = F.regexp_extract_all(F.hex(s.cast("binary")), F.lit("(..)"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda n, h: n + F.conv(h, 16, 10).cast("long"))


def route(value: Column, hosts: int, fallback: Column) -> Column:
    """Host number by the value's byte sum; a sum of 0 is spread by ``fallback``, a hash, so routing can be repeated."""
    n = F.coalesce(byte_sum(value), F.lit(0))
    return F.when(n > 0, n % hosts).otherwise(F.pmod(fallback, F.lit(hosts)))


def resolved(requests: DataFrame, by_message: DataFrame, by_service: DataFrame, overall: dict) -> DataFrame:
    """Requests (service, message) with their policy: the message's, else the service's, else the general one, setting by setting."""
    names = list(overall)
    m = by_message.select("service", "message", *[F.col(c).alias(f"m_{c}") for c in names])
    s = by_service.select("service", *[F.col(c).alias(f"s_{c}") for c in names])
    out = requests.join(m, ["service", "message"], "left").join(s, "service", "left")
    return out.withColumns({c: F.coalesce(f"m_{c}", f"s_{c}", F.lit(v)) for c, v in overall.items()}).drop(*[f"{p}_{c}" for p in "ms" for c in names])


def failover(hosts: DataFrame, first: Column, count: int, now: int, restore_ms: int) -> DataFrame:
    """``hosts`` (host_no, invalid_ms) with the order (from 0) in which a request for ``first`` tries them, around the ring.

    A host that became invalid (at ``invalid_ms``; null: valid) is passed over until more than ``restore_ms`` have gone by, and has a null
    ``attempt`` till then. ``hosts`` is a service's list of hosts, a few rows.
    """
    usable = F.col("invalid_ms").isNull() | (F.lit(now) - F.col("invalid_ms") > restore_ms)
    ring = hosts.withColumns({"_place": F.pmod(F.col("host_no") - first, F.lit(count)), "_ok": usable})
    rank = F.row_number().over(Window.partitionBy("_ok").orderBy("_place")) - 1
    return ring.withColumn("attempt", F.when(F.col("_ok"), rank)).drop("_place", "_ok")


def response(code: Column) -> Column:
    """Status of a reply code: 400 below 0 and from 400 on as given, else 200."""
    return F.when(code < 0, 400).when(code >= 400, code).otherwise(200)


def delays(steps: DataFrame, key: str) -> DataFrame:
    """``steps`` with the milliseconds since the step before of the same key."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    return steps.withColumn("delay_ms", ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1000).cast("long"))


def replies(messages: DataFrame, key: str, number: str, kind: str) -> DataFrame:
    """(request, reply): each message with the first later one of the same ``key`` whose ``kind`` is its own plus one; messages without one, or without a kind, are left out.

    A message stands once as a request, among those that it waits for, and once as a reply; so no pairs are made.
    """
    messages = messages.where(F.col(kind).isNotNull())
    asks = messages.select(key, (F.col(kind) + 1).alias("_kind"), F.col(number).alias("request"), F.lit(None).cast("long").alias("reply"), F.col(number).alias("_at"))
    says = messages.select(key, F.col(kind).alias("_kind"), F.lit(None).cast("long").alias("request"), F.col(number).alias("reply"), F.col(number).alias("_at"))
    later = Window.partitionBy(key, "_kind").orderBy("_at").rowsBetween(1, Window.unboundedFollowing)
    rows = asks.union(says).withColumn("reply", F.first("reply", ignorenulls=True).over(later))
    return rows.where("request IS NOT NULL AND reply IS NOT NULL").select("request", "reply")
