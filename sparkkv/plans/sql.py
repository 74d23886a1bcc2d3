"""Pieces of DuckDB SQL that several queries use."""

from __future__ import annotations

#: Table (tab) of CRC-32's 256 steps, built from the rule.
CRC32_TABLE = "crc32_table AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"


def crc32_sql(hexadecimal: str, seed: int = 0) -> str:
    """Expression for the CRC-32, carried on from ``seed``, of the bytes that the expression ``hexadecimal`` spells; needs CRC32_TABLE's tab."""
    values = f"list_transform(regexp_extract_all({hexadecimal}, '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend({seed ^ 0xFFFFFFFF}::BIGINT, {values}), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"
