"""Operator 10, sharding: proportional stratified interleaving (native: DataFrame functions only).

Rows are shuffled by a seeded hash and ranked within their source; a row's fractional rank is
``(rank - 1 + phase) / rows of its source``, where the phase in [0, 1) is a hash of the source, so that sources with
few rows don't all land in the middle. Sorting by fractional rank interleaves the sources in proportion, and equal
cuts of that order give shards that each match the mixture. Law ``rows``: counts differ by at most one.

Equal rows are one row with a number of copies until they have their ranks, so that they don't meet in one bucket.
Both rankings are distributed (``common.prefix_sums``): no task holds a source or the whole order. Fractional ranks
are uniform whatever the sources' sizes, so the second ranking's buckets are even.

Defined results: a null source is a stratum of its own; a null text has size 8 and CRC-32 0; equal rows are separate
rows (their order among themselves has no effect on the result's rows); an empty table gives an empty result; other
columns, even with the names used here, don't matter, as only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkkv.llm.common import CRC32_TABLE, bucket_of, crc32_sql, prefix_sums, root_buckets, saved, table

SHARDS = 24
SEED = "interleave-1"


def interleave(
    docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot): every row of ``docs`` in one of ``shards`` shards.

    ``slot`` counts from 0 without gaps in each shard and follows the interleaved order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumns(
        {
            "stratum": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")),
            "mix": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text_crc32").cast("string"))),
        }
    )
    # One scan of the texts; what follows reads this slim table only.
    rows = saved(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "shard-rows")
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    buckets = root_buckets(n_rows)
    order = ["mix", "doc_id", "size", "text_crc32"]
    ranked = prefix_sums(rows.withColumn("part", bucket_of(F.col("mix"), buckets)), ["stratum"], "part", order, {"rank": "copies"})
    per_stratum = rows.groupBy("stratum").agg(F.sum("copies").alias("stratum_rows"))
    phase = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/phase:"), F.col("stratum"))), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))
    ranked = ranked.withColumn("rank", F.explode(F.expr("sequence(rank, rank + copies - 1)"))).drop("part", "copies")
    placed = ranked.join(per_stratum, "stratum").withColumn("fraction", (F.col("rank") + phase) / F.col("stratum_rows"))
    placed = placed.withColumns({"all": F.lit(0), "one": F.lit(1).cast("long"), "part": F.floor(F.col("fraction") * root_buckets(total))})
    placed = prefix_sums(placed, ["all"], "part", ["fraction", "stratum", *order], {"place": "one"})
    shard = F.expr(f"place * {shards} div {max(1, total)}")
    placed = placed.withColumn("shard", shard.cast("int")).withColumn("first", F.expr(f"(shard * {total}L + {shards - 1}) div {shards}"))
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def op10_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``rows``."""
    out = interleave(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


_ORACLE = f"""
WITH {CRC32_TABLE}, t AS (
  SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT + 8 AS size, {crc32_sql("hex(encode(coalesce(text, '')))")} AS text_crc32 FROM documents, crc32_table
), m AS (
  SELECT *, coalesce('=' || source, 'null') AS stratum, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32) AS mix FROM t
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY mix, doc_id NULLS FIRST, size, text_crc32) - 1
    + ('0x' || substr(md5('{SEED}/phase:' || stratum), 1, 7))::BIGINT / {float(1 << 28)}) / count(*) OVER (PARTITION BY stratum) AS fraction FROM m
), p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, mix, doc_id NULLS FIRST, size, text_crc32) - 1 AS place, count(*) OVER () AS n FROM r
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * {SHARDS} // n)::INT AS shard,
  (place - ((place * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, source FROM p
"""

QUERIES = {"op10_interleave": op10_interleave}
ORACLES = {"op10_interleave": _ORACLE}
