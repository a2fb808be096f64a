"""NumPy kernels against plain restatements and analytic properties."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pulseframe.operators import cardiac, catalog, correction, ecg, filters
from pyspark.sql import functions as F


def stepwise(x, sections):
    """zero_phase sample by sample."""
    pad = min(len(x) - 1, 3 * (2 * len(sections) + 1))
    out = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for s in sections:
            z1, z2 = filters.steady(s)
            out = np.array(filters._run(out.tolist(), tuple(s), z1 * out[0], z2 * out[0])[0])
        out = out[::-1]
    return out[pad : len(out) - pad]


@pytest.mark.parametrize("n", [2, 5, 63, 64, 65, 1000])
def test_blocks_equal_steps(n):
    x = np.random.default_rng(n).normal(size=n)
    sections = filters.butterworth(filters.Design("butterworth", order=4, low=0.5, high=25.0, fs=1000.0))
    assert np.allclose(filters.zero_phase(x, sections), stepwise(x, sections), atol=1e-9)


def test_chebyshev_response():
    sections = filters.chebyshev_lowpass(8, 0.05, 0.2, 2.0)
    gain = lambda f: abs(np.prod([(s[:3] @ np.exp(-1j * math.pi * f * np.arange(3))) / (np.array([1, s[3], s[4]]) @ np.exp(-1j * math.pi * f * np.arange(3))) for s in sections]))
    band = np.array([gain(f) for f in np.linspace(0, 0.2, 400)])
    floor = 10 ** (-0.05 / 20)
    assert band.max() == pytest.approx(1, abs=1e-4) and band.min() == pytest.approx(floor, abs=1e-4) and gain(0.2) == pytest.approx(floor, abs=1e-6) and gain(0.4) < 1e-2


def test_decimation_keeps_slow_sines():
    t = np.arange(4000)
    out = filters.decimated(np.sin(2 * math.pi * t / 500), 4)
    assert len(out) == 1000 and np.allclose(out[50:-50], np.sin(2 * math.pi * t[::4] / 500)[50:-50], atol=0.02)


@pytest.mark.parametrize(("n", "m"), [(10, 5), (10, 20), (11, 6), (12, 7), (9, 9), (8, 13)])
def test_resampling_of_slow_sines(n, m):
    wave = lambda k: 2 + np.sin(2 * math.pi * np.arange(k) / k) + 0.5 * np.cos(4 * math.pi * np.arange(k) / k)
    assert np.allclose(filters.resampled(wave(n), m), wave(m))


def test_spaced_peaks_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = rng.integers(0, 6, rng.integers(0, 30)).astype(float)
        found, i = [], 1
        while i < len(x) - 1:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i] and x[i] >= 2:
                found.append((i + j) // 2)
            i = j + 1
        kept = []
        for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
            if all(abs(p - q) >= 3 for q in kept):
                kept.append(p)
        assert filters.spaced_peaks(x, 2, 2.5).tolist() == sorted(kept)


def test_correction_ends_without_outliers():
    rng = np.random.default_rng(1)
    c = 100 + 60 * np.arange(40) + 30
    b = (c - 12 + rng.integers(-1, 2, 40)).astype(float)
    b[[7, 20]] -= 25
    b[11] = np.nan
    own = pd.DataFrame({"session_id": 1, "heartbeat_id": np.arange(40), "b_point": b, "c_point": c})
    out = correction._corrected(own, 20.0, 199)
    assert np.isnan(out["b_point"].to_numpy(float, na_value=np.nan)[11]) and abs(out["b_point"][7] - (c[7] - 12)) < 8 and abs(out["b_point"][20] - (c[20] - 12)) < 8
    assert not correction._stationarised(own.assign(b_point=out["b_point"].to_numpy(float, na_value=np.nan)), 20.0)["outlier"].any()
    none = correction._corrected(own.assign(b_point=np.nan), 20.0, 199)
    assert none["b_point"].isna().all() and correction._stationarised(own.assign(b_point=np.nan), 20.0).empty


def test_cleaned_ecg_has_its_peaks():
    fs, n = 200.0, 4000
    t = np.arange(n) / fs
    beats = np.arange(0.5, 19.5, 0.8)
    x = sum(np.exp(-(((t - b) / 0.012) ** 2)) for b in beats) + 0.5 * np.sin(2 * math.pi * 0.2 * t) + 0.05 * np.sin(2 * math.pi * 50 * t)
    for method in ecg.METHODS:
        own = ecg.clean(x, fs, method)
        at = ecg.r_positions(own, fs) / fs
        assert len(at) == len(beats) and np.abs(at - beats).max() < 0.02 and abs(own.mean()) < 0.02
    assert ecg.clean(np.array([3.0]), fs, "biosppy").tolist() == [0.0] and len(ecg.r_positions(np.zeros(50), fs)) == 0


def test_c_points_by_prominence(spark):
    values = [0, 0.2, 0, 1.5, 0, 0.5, 0] + [0, 0, 1.2, 0, 1.3, 0, 0] + [0, 0, 0, 0, 0, 0, 0]
    samples = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "session_id long, idx long, value double")
    beats = spark.createDataFrame([(1, 0, 0, 7, 0), (1, 1, 7, 14, 8), (1, 2, 14, 21, 15)], "session_id long, heartbeat_id long, start_sample long, end_sample long, r_peak_sample long")
    found = {r.heartbeat_id: r.c_point for r in cardiac.c_points_by_prominence(beats, samples).collect()}
    assert found == {0: 3, 1: 11, 2: None}  # both peaks of beat 1 reach level 1.0; 11 is as far from R as beat 0's


def test_ao_envelope_is_its_composition(spark):
    x = np.random.default_rng(3).normal(size=300)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "session_id long, idx long, value double")
    high = filters.zero_phase(x, filters.butterworth(filters.Design("butterworth", order=4, low=20.0, fs=100.0)))
    power = np.abs(np.fft.ifft(np.fft.fft(high) * np.concatenate([[1], np.full(149, 2), [1], np.zeros(149)]))) ** 2
    expected = filters.zero_phase(power, filters.butterworth(filters.Design("butterworth", order=4, high=20.0, fs=100.0)))
    found = [r.value for r in ecg.scg_envelope(df, 100.0).orderBy("idx").collect()]
    assert np.allclose(found, expected)


def test_catalog_of_empty_tables(spark):
    none = spark.createDataFrame([(1, 0)], "session_id long, idx long")
    out = catalog.derived({"facial": none}, ["session_id"])
    assert out.count() == 370 and out.filter("data is not null").isEmpty()
    assert catalog.subgroup_of(spark.createDataFrame([("fac", "nothing")], "a string, b string"), "a", "b").first().subgroup is None
    assert out.filter(F.col("subgroup") == "facial_tremor").select("group").distinct().collect()[0][0] == "mov"
