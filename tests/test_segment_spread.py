"""Deviations of segments that are small next to their session's keep their digits."""

from __future__ import annotations

import math
import statistics

import pytest
from pulseframe.operators import extraction
from test_sql_edges import agrees, events

SEGMENTS = "segment_id long, session_id long, start long, stop long"


def test_equal_values_have_no_spread(spark, tmp_path):
    values = [0.67] * 50 + [0.01] * 40 + [500.0] * 60
    orders = "SELECT i AS o_orderkey, 150 * (i % 83) AS o_custkey FROM range(5063) t(i)"
    rows = agrees(spark, tmp_path, "g4_segment_moments", events=events(str(values)), orders=orders)
    assert len(rows) == 5063 and 0.0 in {r[-1] for r in rows}


@pytest.mark.parametrize("block", [2, 3, 4, 16])
def test_small_spreads_beside_large_values(spark, block):
    values = [1e9, -1e9, 3e8] * 7 + [1 + 1e-9 * (i * i % 7) for i in range(60)] + [None, 5.0]
    spans = [(a, b) for a in range(-2, len(values) + 2, 3) for b in range(a - 1, len(values) + 4, 5)] + [(25, 29), (64, 80), (21, 81), (None, 5), (3, None)]
    frames = spark.createDataFrame([(s, i, v) for s in (0, 1) for i, v in enumerate(values)], "session_id long, idx long, value double").repartition(5)
    segments = spark.createDataFrame([(k, k % 3, *span) for k, span in enumerate(spans)], SEGMENTS)
    found = {r.segment_id: r for r in extraction.segment_moments(frames, segments, ["value"], block).collect()}
    assert len(found) == len(spans)
    for k, (a, b) in enumerate(spans):
        own = [v for v in values[max(a, 0) : max(b, 0)] if v is not None] if k % 3 < 2 and None not in (a, b) else []
        r = found[k]
        assert (r.start, r.stop, r.value_count) == (a, b, len(own))
        assert (r.value_mean is None) == (not own) and (r.value_std is None) == (len(own) < 2)
        if own:
            assert math.isclose(r.value_mean, statistics.fmean(own), rel_tol=1e-12, abs_tol=1e-6)
        if len(own) > 1:
            assert math.isclose(r.value_std, statistics.stdev(own), rel_tol=1e-6 if max(own) < 2 else 1e-12, abs_tol=1e-15)
