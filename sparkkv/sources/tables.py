"""The input tables, and the mutation log that the keyed operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def operation(event_type):
    """Event type to mutation: signup sets, error deletes, purchase increments, anything else only counts."""
    return (
        F.when(event_type == "signup", "set").when(event_type == "error", "del").when(event_type == "purchase", "inc").otherwise("hit")
    )


def mutation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, ts, k, op, v, kind): ``events`` as an append-only log ordered by sid."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("sid"), "ts", F.col("user_id").alias("k"), operation(F.col("event_type")).alias("op"),
        F.col("value").alias("v"), F.col("event_type").alias("kind"),
    )
