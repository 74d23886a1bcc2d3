"""Every registered query against its SQL on the smallest fixture."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from sparkkv.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def canonical(rows, names) -> list:
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, bool):
            return str(v)
        return repr(float(v)) if isinstance(v, (int, float)) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def oracle(sql: str, sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    names, expected = oracle(ORACLES[name], sf)
    assert sorted(df.columns) == sorted(names)
    assert canonical(rows, df.columns) == canonical(expected, names)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
