"""Auditing, rotating and merging mutation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkkv.operators.prefix import prefix_sums


#: Consecutive numbers that are summed in one window.
SPAN = 1 << 20


def rotate(log: DataFrame, size: Column, limit: int, stream: str, span: int = SPAN) -> DataFrame:
    """``log`` with the number of the file each record goes to: a stream's records in sid order, ``limit`` bytes to a file.

    Running sums are taken by spans of sids, so one busy stream isn't one task.
    """
    rows = log.withColumns({"_size": size, "_span": F.expr(f"sid div {span}")})
    rows = prefix_sums(rows, [stream], "_span", ["sid"], {"_before": "_size"})
    return rows.withColumn("file_no", F.floor(F.col("_before") / F.lit(limit))).drop("_size", "_span", "_before")


def retained(files: DataFrame, stream: str, keep: int) -> DataFrame:
    """The ``keep`` newest files of each stream."""
    rank = F.row_number().over(Window.partitionBy(stream).orderBy(F.desc("file_no")))
    return files.withColumn("age", rank).where(F.col("age") <= keep)


def gaps(log: DataFrame, stream: str) -> DataFrame:
    """(stream, after_sid, missing) where a stream's own numbering ``seq`` skips."""
    step = F.col("seq") - F.lag("seq").over(Window.partitionBy(stream).orderBy("seq"))
    return log.withColumn("step", step).where("step > 1").select(stream, (F.col("seq") - F.col("step")).alias("after_seq"), (F.col("step") - 1).alias("missing"))


def once(log: DataFrame) -> DataFrame:
    """Records by sid, once each, however often they were replayed."""
    return log.dropDuplicates(["sid"])


def merged(*sites: DataFrame) -> DataFrame:
    """Last write wins over several sites' logs (k, ts, sid, site, v); ties go to the greater sid, then site."""
    every = sites[0]
    for s in sites[1:]:
        every = every.unionByName(s)
    return every.groupBy("k").agg(F.max(F.struct("ts", "sid", "site", "v")).alias("w")).select("k", "w.*")


def lag_of(log: DataFrame, applied: DataFrame, stream: str, most: int) -> DataFrame:
    """(stream, lag, tolerated): entries that a replica applied up to ``applied_sid`` hasn't seen."""
    behind = log.join(applied, stream).where("sid > applied_sid").groupBy(stream).agg(F.count("*").alias("lag"))
    out = applied.join(behind, stream, "left")
    return out.select(stream, F.coalesce("lag", F.lit(0)).alias("lag"), (F.coalesce("lag", F.lit(0)) <= most).alias("tolerated"))
