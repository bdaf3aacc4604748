"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a function (spark, sf_dir) under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            # DuckDB's count_if gives a HUGEINT, and null for no row.
            ORACLES[f.__name__] = sql.replace("count_if(", "count(*) FILTER (WHERE ")
        return f

    return add
