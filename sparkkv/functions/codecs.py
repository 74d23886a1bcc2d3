"""Character sets and seeded checksums that Spark has no built-in for (Arrow batches)."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utf16_bytes(s: Column) -> Column:
    return F.encode(s, "UTF-16BE")


def utf16_text(b: Column) -> Column:
    return F.decode(b, "UTF-16BE")


@F.pandas_udf(T.BinaryType())
def gbk_bytes(s: pd.Series) -> pd.Series:
    """GBK of a text; null if it has a character that GBK lacks."""

    def one(x):
        try:
            return None if x is None else x.encode("gbk")
        except UnicodeEncodeError:
            return None

    return s.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def gbk_text(b: pd.Series) -> pd.Series:
    """Text of GBK bytes; null if they aren't GBK."""

    def one(x):
        try:
            return None if x is None else bytes(x).decode("gbk")
        except UnicodeDecodeError:
            return None

    return b.map(one, na_action="ignore")


def utf16_to_gbk(b: Column) -> Column:
    """GBK of UTF-16 (big-endian) bytes; null if they hold a character that GBK lacks."""
    return gbk_bytes(utf16_text(b))


def gbk_to_utf16(b: Column) -> Column:
    """UTF-16 (big-endian) of GBK bytes; null if they aren't GBK."""
    return utf16_bytes(gbk_text(b))


@F.pandas_udf(T.LongType())
def crc32_from(seed: pd.Series, b: pd.Series) -> pd.Series:
    """CRC-32 of ``b`` carried on from ``seed``; with seed 0 use Spark's ``crc32``."""
    return pd.Series([None if s is None or x is None else zlib.crc32(bytes(x), int(s)) for s, x in zip(seed, b, strict=True)], dtype="Int64")
