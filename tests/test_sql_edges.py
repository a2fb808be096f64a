"""Queries against their SQL on tables made for it: values of 0, plateaus, near parallel vectors, sums whose order shows."""

from __future__ import annotations

import functools
import math
import operator
from pathlib import Path

import duckdb
from pulseframe.operators import cardiac, catalog, extraction, filters
from pulseframe.operators.signals import rounded
from pulseframe.plans.registry import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F


def cells(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def agrees(spark, folder: Path, name: str, **tables: str) -> list:
    """The rows of a query over tables given as SQL, which must be those of its own SQL to the last digit."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = QUERIES[name](spark, str(folder))
    wanted = con.sql(ORACLE_SQL[name])
    order = [found.columns.index(c) for c in wanted.columns]
    rows = sorted(([cells(r[i]) for i in order] for r in found.collect()), key=repr)
    assert rows == sorted(([cells(v) for v in r] for r in wanted.fetchall()), key=repr)
    return rows


def events(values: str) -> str:
    """One user's events, a second apart, of a list of values."""
    return f"SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, 0::BIGINT AS user_id, 'click' AS event_type, v::DOUBLE AS value FROM (SELECT unnest(range(len(x))) AS i, unnest(x) AS v FROM (SELECT {values} AS x))"


def test_a_value_of_0_spoils_its_own_segments_only(spark, tmp_path):
    orders = "SELECT i AS o_orderkey, 150 * (i % 7) AS o_custkey FROM range(200) t(i)"
    rows = agrees(spark, tmp_path, "g4_segment_moments", events=events("[1.5, 2.5, 0, 4, 5.25, 6, 7, 8, 9, 10]"), orders=orders)
    assert {-math.inf, None} < {r[5] for r in rows}


def test_infinite_values_of_segments(spark):
    frames = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, math.inf, 2.0, 4.0, -math.inf, 8.0, None, 9.0])], "session_id long, idx long, value double")
    spans = {1: (0, 1), 2: (0, 2), 3: (2, 4), 4: (1, 6), 5: (4, 6), 6: (5, 8), 7: (1, 2)}
    segments = spark.createDataFrame([(k, 0, *span) for k, span in spans.items()], "segment_id long, session_id long, start long, stop long")
    found = {r.segment_id: (r.value_count, cells(r.value_mean), r.value_std and cells(round(r.value_std, 9))) for r in extraction.segment_moments(frames, segments, ["value"], block=3).collect()}
    assert found == {1: (1, 1.0, None), 2: (2, math.inf, None), 3: (2, 3.0, round(math.sqrt(2), 9)), 4: (5, None, None), 5: (2, -math.inf, None), 6: (2, 8.5, round(math.sqrt(0.5), 9)), 7: (1, math.inf, None)}


def test_a_mean_at_a_threshold_adds_up_in_order(spark):
    values = [4.62, 26.0, 120.38, 145.1, 31.06, 101.14, 23.78, 7.92]  # 31.06 is half way between the mean and the lowest; summed backwards it is not below
    samples = spark.createDataFrame([(s, i, v) for s in range(40) for i, v in enumerate(values)], "session_id long, idx long, value double").repartition(7).sortWithinPartitions("session_id", (-F.col("idx")))
    beats = spark.createDataFrame([(s, 0, 0, 30, 0) for s in range(40)], "session_id long, heartbeat_id long, start_sample long, end_sample long, r_peak_sample long")
    assert {(r.ivc_point, r.ao_point) for r in cardiac.ao_points(beats, samples, 40.0).collect()} == {(4, 5)}


def test_plateaus_are_no_spaced_peaks(spark, tmp_path):
    rows = agrees(spark, tmp_path, "s19_spaced_peaks", events=events("[1, 30, 2, 2, 2, 2, 2, 40, 40, 3, 3, 3, 3, 3, 35, 1, 50, 50, 50, 1]"))
    assert sorted(r[1] for r in rows) == [1, 14]
    both = filters.peaks(spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 30.0, 30.0, 30.0, 2.0])], "session_id long, idx long, value double"), 20.0, 4.5)
    assert [r.idx for r in both.collect()] == [2]


def test_nearly_parallel_vectors_keep_their_own_orthogonal(spark, tmp_path):
    vectors = "SELECT i AS vec_id, [1, 2, 3, 1 + e, 2, 3 - e]::FLOAT[] AS embedding FROM (SELECT unnest(range(4)) AS i, unnest([0, 0.001, -0.002, 0.5]) AS e)"
    rows = agrees(spark, tmp_path, "v5_orthogonal", embeddings=vectors)
    assert [r[1] is None for r in sorted(rows)] == [True, False, False, False]


def test_the_catalog_of_a_value_of_0(spark, tmp_path):
    items = "SELECT (i % 3)::BIGINT AS l_suppkey, i / 8 AS l_tax, 1.0 + i AS l_quantity, i / 16 AS l_discount, (i % 4)::INT AS l_linenumber, TIMESTAMP '2024-01-01' AS l_shipdate, i AS l_orderkey, 1.5 AS l_extendedprice FROM range(12) t(i)"
    rows = agrees(spark, tmp_path, "g9_derived_catalog", events=events("[1.5, 2.5, 0, 4, 5.25]"), lineitem=items)
    assert -math.inf in [r[-1] for r in rows]


def test_rounding_is_that_of_the_sql(spark):
    values = [40.537375, 46.171875, 52.048625, 55.981875, -55.981875, 0.5e-5, -0.5e-5, 0.0, 1e10, math.inf, -math.inf, None, 0.49999999999999994e-5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").select("i", rounded("v", 5).alias("v"))
    assert {r.i: r.v for r in df.collect()} == {i: v and duckdb.execute("SELECT round(?::DOUBLE, 5)", [v]).fetchone()[0] for i, v in enumerate(values)}


def test_means_add_up_in_order_of_time(spark):
    values = [0.1, 1e16, 0.2, -1e16, 0.3, 7.7]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "session_id long, idx long, fac_LMK00disp double").orderBy(-F.col("idx"))
    found = catalog.derived({"facial": rows}, ["session_id"]).filter("feature = 'LMK00disp' and metric = 'mean'").collect()
    assert [r.data for r in found] == [functools.reduce(operator.add, values) / 6]
