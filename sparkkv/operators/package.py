"""Packages: ordered lists of named items in a binary form, and the 14-byte message head.

An item is a 4-byte length (all integers big-endian; the highest bit marks a nested package), a 2-byte key length, the key, a zero byte, the
data, a zero byte; the length counts 8 bytes besides key and data. Decoded, a package is array<struct<key, value, nested>>: duplicate keys are
legal and the order counts. Encoding and all edits are built-in expressions; only decoding, whose next position depends on the
bytes before it, runs in Python, over Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type of decoded packages; an object, as workers have no parser for type strings.
ITEMS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType()), T.StructField("nested", T.BooleanType())]))
NESTED = 1 << 31


def item(key: Column, value: Column, nested: bool = False) -> Column:
    return F.struct(key.alias("key"), value.cast("binary").alias("value"), F.lit(nested).alias("nested"))


def size_of(x: Column) -> Column:
    """Bytes of an encoded item."""
    return F.octet_length(x["key"]) + F.octet_length(x["value"]) + 8


def _hex(n: Column, width: int) -> Column:
    return F.lpad(F.hex(n.cast("long")), width, "0")


def encode(items: Column) -> Column:
    def one(x: Column) -> Column:
        size = size_of(x).cast("long") + F.when(x["nested"], F.lit(NESTED)).otherwise(F.lit(0).cast("long"))
        return F.concat(_hex(size, 8), _hex(F.octet_length(x["key"]), 4), F.hex(x["key"].cast("binary")), F.lit("00"), F.hex(x["value"]), F.lit("00"))

    return F.unhex(F.array_join(F.transform(items, one), ""))


def parse(data: bytes) -> list[tuple] | None:
    """Items of an encoded package; None if it is damaged."""
    out, at = [], 0
    while at < len(data):
        head = int.from_bytes(data[at : at + 4], "big")
        size, key = head & (NESTED - 1), int.from_bytes(data[at + 4 : at + 6], "big")
        end, cut = at + size, at + 6 + key
        if at + 8 > len(data) or size < 8 + key or end > len(data) or data[cut] or data[end - 1]:
            return None
        out.append((data[at + 6 : cut].decode("utf-8", "replace"), data[cut + 1 : end - 1], bool(head & NESTED)))
        at = end
    return out


@F.pandas_udf(ITEMS)
def decode(data: pd.Series) -> pd.Series:
    """Items of a package; null if it is null or damaged."""
    names = ("key", "value", "nested")
    return data.map(lambda b: None if b is None or (p := parse(bytes(b))) is None else [dict(zip(names, x, strict=True)) for x in p])


def valid(items: Column) -> Column:
    """Whether ``decode`` could read a package that isn't null."""
    return items.isNotNull()


def by_index(items: Column, i: int) -> Column:
    return F.get(items, F.lit(i))


def _same(x: Column, key: str, case: bool) -> Column:
    return x["key"] == key if case else F.lower(x["key"]) == key.lower()


def by_name(items: Column, key: str, case: bool = True) -> Column:
    """The first item of that name; null without one."""
    return F.get(F.filter(items, lambda x: _same(x, key, case)), F.lit(0))


def append(items: Column, key: Column, value: Column, most: int | None = None) -> Column:
    """``items`` with one more; null if the package would exceed ``most`` bytes."""
    out = F.array_append(items, item(key, value))
    return out if most is None else F.when(total_size(out) <= most, out)


def total_size(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda n, x: n + size_of(x))


def _first(items: Column, key: str, case: bool) -> Column:
    """Place of the first item of that name, from 0; -1 without one."""
    return F.coalesce(F.array_position(F.transform(items, lambda x: _same(x, key, case)), F.lit(True)), F.lit(0)) - 1


def remove(items: Column, key: str, every: bool = False, case: bool = True) -> Column:
    """struct<items, removed>."""
    at = _first(items, key, case)
    out = F.filter(items, lambda x: ~_same(x, key, case)) if every else F.filter(items, lambda x, i: i != at)
    return F.struct(out.alias("items"), (F.size(items) - F.size(out)).alias("removed"))


def remove_at(items: Column, i: int) -> Column:
    return F.filter(items, lambda x, n: n != i)


def modify(items: Column, key: str, value: Column, case: bool = True) -> Column:
    """The first item of that name gets a new value."""
    at = _first(items, key, case)
    return F.transform(items, lambda x, i: F.struct(x["key"].alias("key"), F.when(i == at, value.cast("binary")).otherwise(x["value"]).alias("value"), x["nested"].alias("nested")))


def modify_at(items: Column, n: int, value: Column) -> Column:
    return F.transform(items, lambda x, i: F.struct(x["key"].alias("key"), F.when(i == n, value.cast("binary")).otherwise(x["value"]).alias("value"), x["nested"].alias("nested")))


def render(items: Column) -> Column:
    """``key=value`` lines."""
    return F.concat(F.array_join(F.transform(items, lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), "\n"), F.when(F.size(items) > 0, "\n").otherwise(""))


def pack_head(version: Column, attr: Column, kind: Column, task: Column, size: Column) -> Column:
    total = (version.cast("long") + attr + kind + task + size).bitwiseAND(0xFFFF)
    return F.unhex(F.concat(_hex(version, 2), _hex(attr, 2), _hex(kind, 4), _hex(task, 8), _hex(size, 8), _hex(total, 4)))


def read_head(b: Column, most: int | None = None) -> Column:
    """struct<version, attr, kind, task, size>; null for another length, a wrong checksum, or a size over ``most``."""
    n = lambda at, width: F.conv(F.hex(F.substring(b, at, width)), 16, 10).cast("long")
    parts = [n(1, 1), n(2, 1), n(3, 2), n(5, 4), n(9, 4)]
    good = (F.octet_length(b) == 14) & ((parts[0] + parts[1] + parts[2] + parts[3] + parts[4]).bitwiseAND(0xFFFF) == n(13, 2))
    if most is not None:
        good &= parts[4] <= most
    return F.when(good, F.struct(*[p.alias(x) for p, x in zip(parts, ("version", "attr", "kind", "task", "size"), strict=True)]))
