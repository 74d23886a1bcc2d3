"""Relational queries that Spark brings along; they aren't part of the keyed engine, and are here because its users need them beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key at or before it: one sort by (key, time), no join of pairs."""
    names = left.columns
    r = right.select(key, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    rows = left.withColumns({"_t": F.col(left_ts), "_side": F.lit(1)}).unionByName(r, allowMissingColumns=True)
    last = F.last("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_v", last).where("_side = 1").select(*names, *[F.col(f"_v.{v}").alias(v) for v in values])


def range_join(points: DataFrame, spans: DataFrame, at: Column, low: str, high: str, width: int) -> DataFrame:
    """Points with the spans [low, high) that hold them. Both are bucketed by ``width``, so the join is an equi-join with a filter."""
    p = points.withColumn("_b", F.floor(at / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return p.join(s, "_b").where((at >= F.col(low)) & (at < F.col(high))).drop("_b")


def revenue() -> Column:
    return F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(18,4)")
