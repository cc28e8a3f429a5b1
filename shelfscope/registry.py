"""The registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as a query under its name, with DuckDB SQL for the same rows."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLE[f.__name__] = oracle
        return f

    return register


def _load() -> None:
    from . import plans  # noqa: F401  (its modules register themselves)


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLE
