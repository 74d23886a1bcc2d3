"""Replication of the mutation log as Structured Streaming: dispatch, subscription, resumption, windows, state with time to live.

Every stream writes Parquet with a checkpoint, both in a folder that the cluster shares, and runs on what is there (``availableNow``); a
service leaves the trigger out. ``rate`` bounds the files of a micro-batch, the way a replica is sent its chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkv.sources.shared import shared_dir
from sparkkv.sources.tables import operation

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def dispatched(spark: SparkSession, folder: str, pattern: str = "events.parquet", rate: int = 8, subscribe: list[str] | None = None) -> DataFrame:
    """The log as a stream (sid, ts, k, op, v, kind); a subscriber may ask for some kinds only. ``ts`` is a timestamp, as watermarks need."""
    e = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", rate).parquet(folder)
    rows = e.select(F.col("event_id").alias("sid"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("k"), operation(F.col("event_type")).alias("op"), F.col("value").alias("v"), F.col("event_type").alias("kind"))
    return rows.where(F.col("kind").isin(subscribe)) if subscribe else rows


def delivered(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Run an append stream on what is there; the rows delivered so far. The same ``at`` resumes where it stopped."""
    spark = stream.sparkSession
    at = at or f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def maintained(stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregate in complete mode; its last result. Each micro-batch replaces the result's folder, so a repeated one does no harm."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/rows")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def counters(stream: DataFrame) -> DataFrame:
    return stream.groupBy("k", "kind").agg(F.count("*").alias("n"))


def once(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Replayed records are suppressed by sid, with state that the watermark bounds."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["sid"])


def windows(stream: DataFrame, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts by kind."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.groupBy(w, "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def sessions(stream: DataFrame, gap: str = "2 hours") -> DataFrame:
    s = stream.groupBy("k", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("k", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def latest(stream: DataFrame) -> DataFrame:
    """Last write of each key, by sid (partial aggregates meet in the state store)."""
    return stream.where("op = 'set'").groupBy("k").agg(F.max(F.struct("sid", "v")).alias("w")).select("k", "w.sid", "w.v")


def running_state(stream: DataFrame, ttl_ms: int = 60 * 86_400_000, delay: str = "1 day") -> DataFrame:
    """(k, n, total): running counts of (k, ts, v) in custom state that ends ``ttl_ms`` after the key's last record (event time).

    A processing-time limit would keep an ``availableNow`` query from ending.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for f in frames:
            n, total, last = n + len(f), total + float(f["v"].sum()), max(last, int(f["ts"].max().timestamp() * 1000))
        state.update((n, total, last))
        state.setTimeoutTimestamp(last + ttl_ms)
        yield pd.DataFrame({"k": [key[0]], "n": [n], "total": [round(total, 2)]})

    rows = stream.withWatermark("ts", delay).groupBy("k")
    return rows.applyInPandasWithState(step, "k long, n long, total double", "n long, total double, last long", "update", GroupStateTimeout.EventTimeTimeout)


def updated(stream: DataFrame, name: str, key: str) -> DataFrame:
    """Run an update-mode stream; the last row of each key."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{at}/rows")
    names: list[str] = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct("batch", *names)).alias("w")).select(key, *[f"w.{c}" for c in names])


def figures(query) -> dict[str, int | float | None]:
    """Operational figures of a running or ended stream, from its last micro-batch."""
    p = query.lastProgress or {}
    state = p.get("stateOperators") or []
    return {
        "batch": p.get("batchId"), "rows": p.get("numInputRows"), "rows_per_second": p.get("processedRowsPerSecond"),
        "state_rows": sum(s["numRowsTotal"] for s in state), "late_rows": sum(s["numRowsDroppedByWatermark"] for s in state),
    }
