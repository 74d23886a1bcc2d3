"""Addresses and endpoints."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUAD = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def ipv4_number(s: Column) -> Column:
    """Dotted IPv4 address as an unsigned 32-bit number, first part highest; 0 for what isn't one."""
    p = F.split(s, r"\.")
    n = lambda i: F.get(p, i).cast("long")
    return F.when(s.rlike(_QUAD), F.shiftleft(n(0), 24) + F.shiftleft(n(1), 16) + F.shiftleft(n(2), 8) + n(3)).otherwise(F.lit(0).cast("long"))


def ipv4_kind(n: Column) -> Column:
    """any, loopback, multicast, linklocal or other."""
    return (
        F.when(n == 0, "any").when(F.shiftright(n, 24) == 127, "loopback").when(F.shiftright(n, 28) == 14, "multicast")
        .when(F.shiftright(n, 16) == 0xA9FE, "linklocal").otherwise("other")
    )


def endpoint(s: Column) -> Column:
    """struct<host, port> of ``host:port``; null without a colon or with nothing before it; a port that isn't a number is 0."""
    at = F.instr(s, ":")
    port = F.regexp_extract(F.substr(s, at + 1), r"^\s*(\d{1,9})", 1)
    return F.when(at > 1, F.struct(F.substr(s, F.lit(1), at - 1).alias("host"), F.when(port != "", port.try_cast("int")).otherwise(0).alias("port")))


def address(s: Column) -> Column:
    """struct<host, port, family> of ``host:port``, ``[v6]:port`` or a bare port; null for anything else (names aren't looked up)."""
    six, four, bare = F.regexp_extract(s, r"^\[([0-9A-Fa-f:.]+)\]:(\d{1,5})$", 1), F.regexp_extract(s, r"^([^:\[\]]+):(\d{1,5})$", 1), s.rlike(r"^\d{1,5}$")
    port = F.regexp_extract(s, r"(\d{1,5})$", 1).try_cast("int")
    return (
        F.when(six != "", F.struct(six.alias("host"), port.alias("port"), F.lit("v6").alias("family")))
        .when(four != "", F.struct(four.alias("host"), port.alias("port"), F.lit("v4").alias("family")))
        .when(bare, F.struct(F.lit("0.0.0.0").alias("host"), port.alias("port"), F.lit("v4").alias("family")))
    )


@F.pandas_udf(T.StringType())
def ipv6_kind(s: pd.Series) -> pd.Series:
    """any, loopback, multicast, linklocal, mapped (an IPv4 address), compatible or other; null for what isn't an IPv6 address."""

    def one(x):
        try:
            a = ipaddress.IPv6Address(x)
        except (ValueError, TypeError):
            return None
        kinds = (("any", a == ipaddress.IPv6Address(0)), ("loopback", a.is_loopback), ("multicast", a.is_multicast), ("linklocal", a.is_link_local), ("mapped", a.ipv4_mapped is not None), ("compatible", int(a) >> 32 == 0))
        return next((k for k, yes in kinds if yes), "other")

    return s.map(one)


def same_address(a: Column, b: Column) -> Column:
    """Equality of two structs of ``address``."""
    return (F.lower(a["host"]) == F.lower(b["host"])) & (a["port"] == b["port"])
