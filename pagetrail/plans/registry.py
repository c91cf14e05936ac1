"""All queries of the library outside the training-data subpackage, with their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (session, folder) under its name, with the SQL that gives the same rows, if SQL can."""

    def register(f: Callable) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


for _name in ("corpus", "files", "joins", "reports", "sequences", "scoring", "gateway", "signal", "streams"):
    importlib.import_module(f"pagetrail.plans.{_name}")
