"""Shared helpers of the training-data operators: tables, lineage cuts, buckets of distributed ranks.

Nothing here holds data on the driver; the helpers only build DataFrames.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkkv.operators.prefix import prefix_sums
from sparkkv.plans.sql import CRC32_TABLE, crc32_sql
from sparkkv.sources.shared import saved
from sparkkv.sources.tables import table

__all__ = ["CRC32_TABLE", "bucket_of", "crc32_sql", "map_arrow", "prefix_sums", "root_buckets", "saved", "table"]


#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1000


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` in small batches; a session that asks for smaller ones still keeps its setting.

    Buffers come from the system's allocator, which gives large ones back when a batch is done.
    """
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, BATCH_ROWS)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)

    return df.mapInArrow(lean, schema)


def root_buckets(rows: int) -> int:
    """Buckets so that a group of all ``rows`` rows has about as many buckets as rows in a bucket."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows)) / 2))


def bucket_of(hex_hash: Column, buckets: int) -> Column:
    """The leading 28 bits of a hexadecimal hash, scaled to 0 .. buckets-1; follows the hash's order."""
    return F.floor(F.conv(F.substring(hex_hash, 1, 7), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 28))
