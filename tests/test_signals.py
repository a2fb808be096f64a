"""Signal, vector and cardiac operators on hand-computed inputs, and kernels by their analytic properties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pulseframe.functions import vectors as V
from pulseframe.operators import prominence, cardiac, features, filters, rr, signals, speech
from pyspark.sql import functions as F


def signal(spark, *values, session=1):
    return spark.createDataFrame([(session, i, None if v is None else float(v)) for i, v in enumerate(values)], "session_id long, idx long, value double")


def column(df, name):
    return [r[name] for r in df.orderBy("session_id", "idx").collect()]


def test_gradient_and_extrema(spark):
    assert column(signal(spark, 0, 1, 2, 3, 4).withColumn("d", signals.gradient("value")), "d") == [1.0] * 5
    assert column(signal(spark, 5).withColumn("d", signals.gradient("value")), "d") == [None]
    assert [r.idx for r in signals.local_maxima(signal(spark, 0, 2, 2, 2, 0)).collect()] == [2]
    assert signals.local_maxima(signal(spark, 5, 1, 0, 1, 5)).count() == 0
    flat = signal(spark, 5, 1, 0, 1, 5).withColumn("hit", signals.flat_maxima())
    assert column(flat, "hit") == [True, False, False, False, True]


def test_interpolation_keeps_leading_nulls(spark):
    assert column(signal(spark, None, 1, None, 3, None).withColumn("f", signals.interpolated()), "f") == [None, 1.0, 2.0, 3.0, 3.0]


def test_prominence(spark):
    found = {r.idx: r.prominence for r in prominence.prominences(signal(spark, 0, 3, 1, 5, 2, 4, 0)).collect()}
    assert found == {1: 2.0, 3: 5.0, 5: 2.0}


def test_voice_activity(spark):
    flags = [0, 1, 1, 1, 0, 0, 0, 1, 1, 1, 1]
    df = spark.createDataFrame([(1, i, bool(f)) for i, f in enumerate(flags)], "session_id long, idx long, speech boolean")
    assert [(r.start, r.stop) for r in speech.vad_segments(df, 3, 1.0).orderBy("start").collect()] == [(1.0, 5.0), (7.0, 10.0)]


def test_pauses(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.5, 3.0), (1, 4.0, 5.0)], "session_id long, start double, stop double")
    r = speech.timing_cues(df).first()
    assert (r.total, r.speaking, r.n_pauses, r.pause_time, r.pause_fraction) == (5.0, 3.5, 2, 1.5, 0.3)


def test_heartbeats(spark):
    peaks = spark.createDataFrame([(1, r) for r in (100, 200, 310, 400)] + [(2, 5)], "session_id long, idx long")
    beats = cardiac.heartbeats(peaks, spark.createDataFrame([(1, 1000), (2, 50)], "session_id long, n long")).orderBy("heartbeat_id").collect()
    assert [b.start_sample for b in beats] == [65, 165, 272, 368]
    assert [b.end_sample for b in beats] == [165, 272, 368, 458]
    assert [b.rr_interval_samples for b in beats] == [100.0, 110.0, 90.0, 90.0]


def test_outliers_are_one_sided(spark):
    assert column(cardiac.outliers(signal(spark, 0, 0, 1, 1, 10)), "outlier") == [False, False, False, False, True]
    assert not any(column(cardiac.outliers(signal(spark, 0, 0, 1, 1, -10)), "outlier"))


def test_constant_intervals_have_no_artefacts(spark):
    df = spark.createDataFrame([(1, i, 800.0) for i in range(30)], "session_id long, idx long, rr_ms double")
    r = rr.artefacts(df).agg(*(F.max(F.col(c).cast("int")).alias(c) for c in ("ectopic", "long", "short", "missed", "extra"))).first()
    assert set(r) == {0}


def test_weighted(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 4.0, 2.0), ("a", None, 9.0)], "k string, x double, w double")
    r = features.weighted(df, ["k"], "x", "w").first()
    assert r.wmean == pytest.approx(2.75) and r.wstd == pytest.approx(math.sqrt(2.7))


def test_rotations(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(V.applied(V.rotation(V.vector(1, 0, 0), F.lit(math.pi)), V.vector(0, 0, 1))) == pytest.approx([0, 0, -1])
    assert get(V.applied(V.gravity_rotation(V.vector(1, 0, 0)), V.vector(1, 0, 0))) == pytest.approx([0, 0, 1])
    assert get(V.orthogonal(V.vector(1, 0, 0), V.vector(-1, 0, 0))) == pytest.approx([0, 0, 1])
    assert get(V.normalized(V.vector(0, 0, 0))) is None
    assert get(V.parallel(V.vector(0, 0, 1), V.vector(0, 0, -2))) is True


@pytest.mark.parametrize(("design", "edges"), [(filters.Design("butterworth", 4, 0.5, 25.0, 1000.0), (0.5, 25.0)), (filters.Design("butterworth", 4, None, 20.0, 500.0), (20.0,)), (filters.Design("butterworth", 5, 20.0, None, 500.0), (20.0,))])
def test_butterworth_is_three_decibels_down_at_its_edges(design, edges):
    sections = filters.butterworth(design)
    for f in edges:
        z = np.exp(-2j * math.pi * f / design.fs * np.arange(3))
        gain = np.prod([abs((s[:3] @ z) / (np.array([1, s[3], s[4]]) @ z)) for s in sections])
        assert 20 * math.log10(gain) == pytest.approx(-3.0103, abs=1e-3)


def test_zero_phase_keeps_constants_and_symmetry():
    low = filters.butterworth(filters.Design("butterworth", 4, None, 20.0, 500.0))
    assert filters.zero_phase(np.full(80, 3.0), low) == pytest.approx(np.full(80, 3.0))
    bump = np.exp(-(np.linspace(-4, 4, 401) ** 2))
    assert filters.zero_phase(bump, low) == pytest.approx(filters.zero_phase(bump, low)[::-1], abs=1e-6)
    t = np.arange(256)
    assert filters.envelope(np.cos(2 * math.pi * t * 8 / 256)) == pytest.approx(np.ones(256))


def test_empty_input(spark):
    empty = signal(spark)
    assert signals.local_maxima(empty).count() == 0 and cardiac.outliers(empty).count() == 0 and filters.filtered(empty, filters.Design("hilbert")).count() == 0
