"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from sparkkv.llm import chat, jaccard, langid, licenses, media, mixing, neighbours, packing, sharding, tokencount

MODULES = [mixing, licenses, chat, tokencount, jaccard, langid, packing, neighbours, media, sharding]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
