"""Sums of line items add up in the order in which they are stored, as their SQL adds them in one thread."""

from __future__ import annotations

import duckdb
import pytest
from pulseframe.plans.registry import ORACLE_SQL, QUERIES
from test_sql_edges import events

ITEMS = "(1e16, 0.5), (1, 0.25), (1, 0.25), (-1e16, 0.25), (3, 0.25)"


@pytest.mark.parametrize("cuts", [(0, 1, 3, 5), (0, 2, 4, 5), (0, 5)])
def test_line_items_of_several_files(spark, tmp_path, cuts):
    con = duckdb.connect(config={"threads": 1})
    (tmp_path / "lineitem.parquet").mkdir()
    con.sql(f"COPY ({events('[1.5, 2.5, 4]')}) TO '{tmp_path}/events.parquet'")
    for k, (first, after) in enumerate(zip(cuts, cuts[1:])):
        con.sql(f"COPY (SELECT 7::BIGINT AS l_suppkey, v::DOUBLE AS l_tax, v::DOUBLE AS l_discount, w::DOUBLE AS l_quantity, 1 AS l_linenumber FROM (SELECT v, w, row_number() OVER () - 1 AS i FROM (VALUES {ITEMS}) t(v, w)) WHERE i >= {first} AND i < {after} ORDER BY i) TO '{tmp_path}/lineitem.parquet/part-{k}.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    own = "session_id = 7 AND data IS NOT NULL AND metric IN ('mean', 'wmean')"
    found = QUERIES["g9_derived_catalog"](spark, str(tmp_path)).filter(own)
    rows = {(r.feature, r.metric): r.data for r in found.collect()}
    assert rows == {(f, m): v for f, m, v in con.sql(f"SELECT feature, metric, data FROM ({ORACLE_SQL['g9_derived_catalog']}) WHERE {own}").fetchall()}
    assert rows["jitter", "mean"] == rows["voicepct", "mean"] == 0.6 and rows["pausetime", "mean"] == 3
