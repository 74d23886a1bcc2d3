"""All queries of the keyed engine, its functions, streams and the relational baseline."""

from __future__ import annotations

from sparkkv.plans import audit_queries, baseline_queries, function_queries, kv_queries, stream_queries  # noqa: F401  they register
from sparkkv.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
