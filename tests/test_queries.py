"""Every registered query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest
from pulseframe.plans.registry import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}") + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF.iterdir():
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, str(SF))
    rows = found.collect()
    if name in ORACLE_SQL:
        wanted = duck.sql(ORACLE_SQL[name])
        assert sorted(found.columns) == sorted(wanted.columns)
        assert table(found.columns, rows) == table(wanted.columns, wanted.fetchall())
