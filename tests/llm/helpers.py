"""Frames for the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


#: Names that the operators use inside.
NAMES = ["key", "part", "rank", "n", "score", "lang_pred", "mix", "row", "times", "token", "component", "one", "all", "node", "root", "pos", "pass", "_n", "place", "tokens", "whole", "vec", "label2", "print", "n_tokens", "bound"]


def clashing(df):
    """``df`` with more columns of other types."""
    return df.withColumns({c: F.lit("clash") for c in NAMES if c not in df.columns})
