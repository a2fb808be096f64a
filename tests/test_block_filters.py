"""Filters on blocks of a session equal the kernel over the whole session."""

from __future__ import annotations

import numpy as np
import pytest
from pulseframe.operators import filters


@pytest.mark.parametrize("design", [filters.Design("butterworth", order=4, low=1.0, high=9.0, fs=100.0), filters.Design("butterworth", order=3, high=0.2, fs=100.0), filters.Design("elliptic", order=4, low=2.0, high=12.0, fs=100.0)])
def test_blocks_equal_the_whole(spark, design):
    rng = np.random.default_rng(4)
    made = {k: rng.normal(50, 10, n).cumsum() * 0.01 + rng.normal(0, 1, n) for k, n in enumerate((1, 2, 20, 99, 100, 101, 250, 1003, 2000))}
    rows = [(k, i, float(v)) for k, x in made.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "session_id long, idx long, value double").repartition(6)
    found = {}
    for r in filters.filtered(df, design, block=100).collect():
        found.setdefault(r.session_id, {})[r.idx] = r.value
    for k, x in made.items():
        wanted = filters.kernel(design)(x)
        assert sorted(found[k]) == list(range(len(x)))
        assert np.allclose([found[k][i] for i in range(len(x))], wanted, rtol=1e-9, atol=1e-8)


def test_decimation_by_blocks(spark):
    x = np.sin(np.arange(1500) * 0.01) * 40
    df = spark.createDataFrame([(7, i, float(v)) for i, v in enumerate(x)], "session_id long, idx long, value double").repartition(3)
    found = {r.idx: r.value for r in filters.decimate(df, 4, block=128).collect()}
    wanted = filters.decimated(x, 4)
    assert sorted(found) == list(range(len(wanted))) and np.allclose([found[i] for i in range(len(wanted))], wanted, atol=1e-9)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "session_id long, idx long, value double")
    assert filters.filtered(df, filters.Design("butterworth", order=4, high=5.0, fs=100.0)).collect() == []
