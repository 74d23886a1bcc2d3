"""Keyed reads and mutations over DataFrames, and the fold of a mutation log into its current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def get(kv: DataFrame, key: str, value) -> DataFrame:
    """Point read; the predicate reaches the Parquet reader."""
    return kv.where(F.col(key) == value)


def multi_get(kv: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Every requested key once, with the stored columns and ``found``."""
    return requests.select(key).distinct().join(kv.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def existing(requests: DataFrame, kv: DataFrame, key: str) -> DataFrame:
    """The requests whose key is stored."""
    return requests.join(kv.select(key), key, "left_semi")


def listing(kv: DataFrame, key: str, low, high, count: int, descending: bool = False) -> DataFrame:
    """Ordered scan of low <= key < high, at most ``count`` rows (TakeOrderedAndProject)."""
    rows = kv.where((F.col(key) >= low) & (F.col(key) < high))
    return rows.orderBy(F.desc(key) if descending else F.asc(key)).limit(count)


def add(kv: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert the rows of ``new`` whose key isn't stored; of rows that repeat a key, one whole row is stored (the smallest)."""
    rest = [c for c in kv.columns if c != key]
    once = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*") if rest else new.select(key).distinct()
    return kv.unionByName(once.join(kv.select(key), key, "left_anti").select(*kv.columns))


def put(log: DataFrame, key: str, order: str, value: list[str]) -> DataFrame:
    """Upsert, last write wins: the row with the greatest ``order`` of each key (partial aggregation before the shuffle)."""
    best = log.groupBy(key).agg(F.max(F.struct(order, *value)).alias("w"))
    return best.select(key, "w.*")


def update(kv: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """Change stored keys only; keys that aren't stored are never made. ``changes`` has one row for a key."""
    new = changes.select(key, F.col(value).alias("_new"))
    return kv.join(new, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def increase(kv: DataFrame, deltas: DataFrame, key: str, value: str) -> DataFrame:
    """Add each key's summed deltas to its stored value."""
    sums = deltas.groupBy(key).agg(F.sum(value).alias("_add"))
    return kv.join(sums, key, "left").withColumn(value, F.col(value) + F.coalesce("_add", F.lit(0))).drop("_add")


def remove(kv: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return kv.join(keys.select(key), key, "left_anti")


def fold(log: DataFrame, span: int | None = None) -> DataFrame:
    """Current state of a log (sid, k, op, v[, ts]): last set or del by sid, plus the increments after it.

    Deleted keys are left out, as are keys that were only counted. Setting a key to null deletes it. Hits are counted over the whole log.
    The window and the aggregate share one exchange by key. If a few keys hold most of the log, give a ``span``: records are folded by
    (key, sid div span) first, and a second exchange brings a row for each key and span, so no task holds a hot key's records.
    """
    part = ["k"] if span is None else ["k", "span"]
    rows = log if span is None else log.withColumn("span", F.expr(f"sid div {span}"))
    rows = rows.withColumn("base", F.max(F.when(F.col("op").isin("set", "del"), F.col("sid"))).over(Window.partitionBy(*part)))
    after = (F.col("op") == "inc") & (F.col("sid") > F.coalesce("base", F.lit(-(1 << 62))))
    at = F.col("sid") == F.col("base")
    state = rows.groupBy(*part).agg(
        F.max("base").alias("base"),
        F.max(F.when(at & (F.col("op") == "set"), F.col("v"))).alias("set_v"),
        F.sum(F.when(after, F.col("v").cast("decimal(18,4)"))).alias("inc_v"),
        F.count_if(after).alias("n_inc"),
        F.count_if(F.col("op") == "hit").alias("hits"),
        F.max("sid").alias("last_sid"),
        F.max("ts").alias("last_ts"),
    )
    if span is not None:
        # Of the spans from the last set or del on: its value, and all increments.
        start = F.max(F.when(F.col("base").isNotNull(), F.col("span"))).over(Window.partitionBy("k"))
        state = state.withColumn("start", start).withColumn("on", F.col("start").isNull() | (F.col("span") >= F.col("start")))
        state = state.groupBy("k").agg(
            F.max(F.when(F.col("span") == F.col("start"), F.col("set_v"))).alias("set_v"),
            F.sum(F.when(F.col("on"), F.col("inc_v"))).alias("inc_v"),
            F.sum(F.when(F.col("on"), F.col("n_inc")).otherwise(0)).alias("n_inc"),
            *[f(c).alias(c) for f, c in ((F.sum, "hits"), (F.max, "last_sid"), (F.max, "last_ts"))],
        )
    state = state.where("set_v IS NOT NULL OR n_inc > 0")
    value = F.coalesce(F.col("set_v").cast("decimal(18,4)"), F.lit(0)) + F.coalesce("inc_v", F.lit(0))
    return state.select("k", value.cast("double").alias("v"), "n_inc", "hits", "last_sid", "last_ts")


def fold_tail(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """``fold`` of a whole log from its folded beginning and the rest: snapshot rows enter as a set before the tail."""
    start = snapshot.select("k", F.lit(-1).cast("long").alias("sid"), F.lit("set").alias("op"), "v")
    return fold(start.unionByName(tail.select("k", "sid", "op", "v")).withColumn("ts", F.lit(None).cast("timestamp_ntz")))


def as_of(log: DataFrame, sid: int) -> DataFrame:
    return fold(log.where(F.col("sid") <= sid))


def key_group(group: Column, start: int, end: int) -> Column:
    """Bits start .. end (inclusive) of a group value: the partition that holds a key."""
    return F.shiftright(group, start).bitwiseAND((1 << (end - start + 1)) - 1)


def hash_partition(key: Column, n: int) -> Column:
    """0 .. n-1 from the first 60 bits of the key's MD5: the same in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long"), F.lit(n))


def range_partition(key: Column, bounds: list) -> Column:
    """Number of ``bounds`` that are at most the key."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= key)).cast("long")


def wide_key(key: Column, width: int) -> Column:
    """An unsigned key of ``width`` bytes, big-endian, whose binary order is the key's."""
    return F.unhex(F.lpad(F.hex(key), 2 * width, "0"))
