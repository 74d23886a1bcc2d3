"""File sources and sinks: texts, lines, XML, binary files, directory listings, settings, engines as write formats."""

from __future__ import annotations

import configparser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Store engines and how Spark stands in for them: Parquet files, Parquet by key group, a cached view, or nothing at all.
ENGINES = ("columnar", "grouped", "memory", "null")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line): a row for each line, of any length."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def numbered_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 1, line): what follows the last line break is a line only if it isn't empty."""
    parts = F.split(F.col(text_col), "\n")
    rows = texts.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("n", "line"), F.size(parts).alias("last"))
    return rows.where("NOT (n = last - 1 AND line = '')").select("id", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of XML files (the reader is built into Spark)."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, length) of the files below ``path``; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def settings(text: str) -> dict[str, dict[str, str]]:
    """Sections of an INI text (a driver-side configuration, not data)."""
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    parser.read_string(text)
    return {s: dict(parser[s]) for s in parser.sections()}


def store(df: DataFrame, engine: str, path: str | None = None, group: str | None = None, compress: bool = True) -> DataFrame | None:
    """Write ``df`` with one of ``ENGINES``; the stored table, or None for the null engine."""
    if engine == "null":
        df.write.format("noop").mode("overwrite").save()
        return None
    if engine == "memory":
        return df.persist()
    writer = df.write.mode("overwrite").option("compression", "zstd" if compress else "none")
    if engine == "grouped":
        # Rows of a group meet in as many tasks as adaptive execution finds useful, then one directory for each group.
        df = df.hint("rebalance", group)
        writer = df.write.mode("overwrite").option("compression", "zstd" if compress else "none").partitionBy(group)
    elif engine != "columnar":
        raise ValueError(engine)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def export_range(df: DataFrame, key: str, low, high, path: str | None = None) -> DataFrame:
    """Rows with low <= key < high in key order; written range by range, so readers skip files and row groups by key."""
    rows = df.where((F.col(key) >= low) & (F.col(key) < high))
    if path is None:
        return rows
    rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
