"""Counters of several names per key, and operational figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(hits: DataFrame, key: str, counter: str) -> DataFrame:
    """(key, counter, n): one row for each counter of a key."""
    return hits.groupBy(key, counter).agg(F.count("*").alias("n"))


def as_row(hits: DataFrame, key: str, counter: str, names: list[str]) -> DataFrame:
    """All counters of a key in a row; naming them spares Spark a job, and absent ones are 0."""
    return hits.groupBy(key).agg(*[F.count_if(F.col(counter) == n).alias(n) for n in names])


def configured(hits: DataFrame, definition: DataFrame, key: str, counter: str) -> DataFrame:
    """Counters named by ``definition`` (counter, step): a hit adds its counter's step; others aren't counted."""
    rows = hits.join(definition, counter)
    return rows.groupBy(key, counter).agg(F.sum("step").alias("n"))


def recent(hits: DataFrame, day, days: int) -> DataFrame:
    """Hits of the ``days`` days up to and including ``day``."""
    return hits.where((F.to_date("ts") <= day) & (F.to_date("ts") > F.date_sub(day, days)))
