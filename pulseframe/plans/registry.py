"""All registered queries of the signal engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "g9_features_long"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the DuckDB SQL of the same rows if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ruff: noqa: E402
from pulseframe.plans import cardiac, extraction, features, recordings, rr, signals, speech, tremor, vectors

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "cardiac", "extraction", "features", "query", "recordings", "rr", "signals", "speech", "tremor", "vectors"]
