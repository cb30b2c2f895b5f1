"""The registry behind ``__spark_entry__``: query name -> Spark callable and
query name -> DuckDB oracle SQL.  Queries without an oracle get the
driver's rows-only check and are tested against brute force in pytest."""

from __future__ import annotations

import importlib

_MODULES = ["scoutline.plans.catalog_matching", "scoutline.plans.catalog_text",
            "scoutline.plans.catalog_sessions", "scoutline.plans.catalog_outreach",
            "scoutline.plans.catalog_streaming", "scoutline.plans.catalog_service"]


def _load():
    queries, oracle = {}, {}
    for name in _MODULES:
        m = importlib.import_module(name)
        for k in m.QUERIES:
            if k in queries:
                raise ValueError(f"duplicate query {k}")
        queries.update(m.QUERIES)
        oracle.update(getattr(m, "ORACLE", {}))
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
