"""The log as a stream; each result is compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkv.plans.kv_queries import LOG
from sparkkv.plans.registry import query
from sparkkv.streaming import replication as r


@query(f"WITH {LOG} SELECT k, kind, count(*) AS n FROM log GROUP BY 1, 2")
def stream_counter(spark: SparkSession, d: str) -> DataFrame:
    return r.maintained(r.counters(r.dispatched(spark, d)), "counter")


@query(f"WITH {LOG} SELECT k, max(sid) AS sid, arg_max(v, sid) AS v FROM log WHERE op = 'set' GROUP BY k")
def stream_latest(spark, d):
    return r.maintained(r.latest(r.dispatched(spark, d)), "latest")


@query(f"WITH {LOG} SELECT sid, k, kind FROM log WHERE kind IN ('purchase', 'error')")
def stream_subscribe(spark, d):
    return r.delivered(r.dispatched(spark, d, subscribe=["purchase", "error"]).select("sid", "k", "kind"), "subscribe")


@query(f"WITH {LOG} SELECT sid, k, op FROM log")
def stream_dedup(spark, d):
    """The log sent twice, suppressed within the watermark."""
    twice = r.dispatched(spark, d).withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    return r.delivered(r.once(twice, "60 days").select("sid", "k", "op"), "dedup")


@query(f"WITH {LOG} SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, kind, count(*) AS n FROM log GROUP BY 1, 2")
def stream_windows(spark, d):
    out = r.maintained(r.windows(r.dispatched(spark, d)), "windows")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n")


@query(f"""WITH {LOG}, m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM log WINDOW w AS (PARTITION BY k ORDER BY ts, sid)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY ts, sid) AS no FROM m)
SELECT k, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY k, no""")
def stream_sessions(spark, d):
    out = r.maintained(r.sessions(r.dispatched(spark, d)), "sessions")
    return out.select("k", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT user_id AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_state(spark, d):
    """Running counts in custom state with time to live."""
    return r.updated(r.running_state(r.dispatched(spark, d).select("k", "ts", "v")), "state", "k")
