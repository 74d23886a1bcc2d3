"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner may write it as Parquet and read it again as the next
stage's ``docs``. All but the last return the columns of documents.

1. language: documents without a language (``und``: null text or no letter) go; labels are learned from all labelled rows of the stage's own
   input. The predicted language and its score reject nothing, and without any label every text with a letter stays.
2. near_duplicates: of each component of near-equal texts the document with the smallest id stays. Rows of one id and text count once; rows that share
   an id but have different texts are documents of their own, of which the text with the smallest digest is first.
3. mixture: sources at temperature weights. The budget is the least that passes every source at least once, so no document is lost; rare
   sources repeat, at most ``REPEATS`` times.
4. packing: pieces of at most 2048 tokens in as few sequences as possible.

Defined results: null ids are kept by stage 2 (nothing links them); an empty input gives an empty output with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkkv.llm import jaccard, langid, mixing, packing
from sparkkv.llm.common import prefix_sums

REPEATS = 2.0


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known (operator 6)."""
    fitted = langid.fit(docs)
    if fitted is None:
        return langid.lettered(docs)
    names = tuple(_free(docs, x) for x in ("lang_pred", "score"))
    return langid.predict(docs, fitted, names=names).where(F.col(names[0]) != langid.UND).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component (operator 5)."""
    again = jaccard.saved(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not again.limit(1).count():
        dropped = jaccard.near_components(docs).where("doc_id != component_id").select("doc_id").distinct()
        return jaccard.among(docs, jaccard.saved(dropped, "dropped"), "left_anti").select(*_columns(docs))
    # Ids that repeat: each (id, text) is a document with a number of its own, in the ids' order.
    digest, number, place = _free(docs, "digest"), _free(docs, "number"), _free(docs, "place")
    rows = docs.withColumn(digest, F.coalesce(F.sha2("text", 256), F.lit("")))
    slim = rows.where("doc_id IS NOT NULL").select("doc_id", F.col(digest).alias("digest")).distinct()
    # Ranges of ids are numbered side by side: a partition's number is its place in the order.
    slim = jaccard.saved(slim.repartitionByRange("doc_id", "digest").withColumn("part", F.spark_partition_id()).withColumn("one", F.lit(1).cast("long")).withColumn("all", F.lit(0)), "ids")
    numbers = prefix_sums(slim, ["all"], "part", ["doc_id", "digest"], {"number": "one"})
    numbers = jaccard.saved(numbers.select("doc_id", F.col("digest").alias(digest), F.col("number").alias(number)), "numbers")
    rows = jaccard.saved(rows.join(numbers, ["doc_id", digest], "left").select(*_columns(docs), F.col(f"`{number}`")), "numbered")
    asked = rows.where("doc_id IS NOT NULL").select(F.col(number).alias("doc_id"), "text")
    dropped = jaccard.near_components(asked).where("doc_id != component_id").select("doc_id").distinct()
    dropped = jaccard.saved(dropped.withColumnRenamed("doc_id", number), "dropped")
    kept = rows.where("doc_id IS NOT NULL").join(dropped, number, "left_anti")
    # Repeated rows of one id and text are one document.
    first = F.row_number().over(Window.partitionBy(number).orderBy(number))
    one = kept.withColumn(place, first).where(F.col(place) == 1).select(*_columns(docs))
    return one.union(rows.where("doc_id IS NULL").select(*_columns(docs)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture has them (operator 1)."""
    return mixing.mixed_documents(docs, budget=None, repetition_limit=REPEATS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset (operator 7)."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", pack)]

#: Neither a learned model nor a tokenizer can be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = jaccard.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
