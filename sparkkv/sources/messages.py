"""Logs of binary messages: a 14-byte head and a body of the length it names, one after another in a file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 14
SCHEMA = "path string, position long, version int, attr int, kind int, task long, body binary, error string"


def scan(data: bytes, most: int) -> Iterator[tuple]:
    """(position, version, attr, kind, task, body, error) of each message; one row with ``error`` ends a damaged file."""
    at = 0
    while at < len(data):
        head = data[at : at + HEAD]
        version, attr = head[0], head[1] if len(head) > 1 else 0
        kind, task, size, check = (int.from_bytes(head[a:b], "big") for a, b in ((2, 4), (4, 8), (8, 12), (12, 14)))
        error = None
        if len(head) < HEAD:
            error = "short head"
        elif (version + attr + kind + task + size) & 0xFFFF != check:
            error = "checksum"
        elif size > most:
            error = "length"
        elif at + HEAD + size > len(data):
            error = "short body"
        if error:
            yield at, None, None, None, None, None, error
            return
        yield at, version, attr, kind, task, data[at + HEAD : at + HEAD + size], None
        at += HEAD + size


def decoded(files: DataFrame, most: int = 1 << 24) -> DataFrame:
    """``SCHEMA`` rows of (path, content) ``files``. Log files are rotated by size, so a file is a fair unit of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(path, *r) for r in scan(content.as_py() or b"", most)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, SCHEMA)


def message_log(spark: SparkSession, path: str, pattern: str = "*", most: int = 1 << 24) -> DataFrame:
    """The messages of all log files below ``path``, in any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return decoded(files.select("path", "content"), most)
