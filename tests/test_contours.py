"""Visibility graphs, wavelets, vocal tremor, segmented extraction and the catalog's deviations against plain restatements."""

from __future__ import annotations

import json
import math
import random
import statistics

import numpy as np
import pytest
from pulseframe.operators import catalog, extraction, tremor, visibility, wavelets
from pyspark.sql import functions as F


def plain_visible(v):
    return {(i, j) for j in range(len(v)) for i in range(j) if all((v[j] - v[i]) / (j - i) < (v[j] - v[k]) / (j - k) for k in range(i + 1, j))}


def plain_c_point(v, sparse=0.55):
    down = {i: [] for i in range(len(v))}
    for i, j in plain_visible(v):
        if v[i] != v[j]:
            high, low = (i, j) if v[i] > v[j] else (j, i)
            down[high].append(low)
    w = [1.0] * len(v)
    while sum(x > 0 for x in w) > (1 - sparse) * len(v):
        further = [sum(w[k] for k in down[i]) for i in range(len(v))]
        if not any(further):
            break
        w = further
    score = [x * (y - min(v)) for x, y in zip(w, v)]
    return score.index(max(score))


def test_visibility_graph_by_definition():
    rng = random.Random(2)
    for _ in range(60):
        v = [float(rng.randrange(6)) for _ in range(rng.randrange(1, 25))]
        i, j = visibility.visible_pairs(np.array(v))
        assert set(zip(i.tolist(), j.tolist())) == plain_visible(v) and len(i) == len(plain_visible(v))


def test_c_points_by_visibility(spark):
    rng = random.Random(3)
    samples, beats, wanted = [], [], {}
    for session in range(3):
        v = [rng.random() + 5 * math.exp(-((i % 30 - 18) ** 2) / 6) for i in range(120)]
        samples += [(session, i, x) for i, x in enumerate(v)]
        for b in range(4):
            beats.append((session, b, 30 * b, 30 * b + 30, 30 * b + 10))
            wanted[session, b] = 30 * b + plain_c_point(v[30 * b : 30 * b + 30])
    beats += [(0, 9, 500, 520, 505), (7, 0, 0, 5, 2)]  # without samples
    wanted |= {(0, 9): None, (7, 0): None}
    own = spark.createDataFrame(beats, "session_id long, heartbeat_id long, start_sample long, end_sample long, r_peak_sample long")
    found = visibility.c_points_by_visibility(own, spark.createDataFrame(samples, "session_id long, idx long, value double").repartition(4))
    assert {(r.session_id, r.heartbeat_id): r.c_point for r in found.collect()} == wanted


@pytest.mark.parametrize("scale", [1, 2, 3, 4])
def test_wavelet_scales_are_slopes_half_a_sample_back(scale):
    taps = wavelets.scale_taps(scale)
    assert math.isclose(sum(taps.values()), 0, abs_tol=1e-12)
    line = sum(w * k for k, w in taps.items())
    assert line > 0 and math.isclose(sum(w * (k + 0.5) ** 2 for k, w in taps.items()), 0, abs_tol=1e-9)  # odd about -1/2


def test_q_peaks_of_a_made_ecg(spark):
    n, rs = 2000, range(100, 1950, 170)
    x = np.zeros(n)
    for r in rs:
        t = np.arange(n)
        x += 1.2 * np.exp(-((t - r) ** 2) / 18) - 0.3 * np.exp(-((t - r + 9) ** 2) / 10) - 0.25 * np.exp(-((t - r - 10) ** 2) / 12)
    samples = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "session_id long, idx long, value double").repartition(3)
    beats = spark.createDataFrame([(1, k, r - 60, r + 110, r) for k, r in enumerate(rs)], "session_id long, heartbeat_id long, start_sample long, end_sample long, r_peak_sample long")
    lows = {k: r - 20 + int(np.argmin(x[r - 20 : r])) for k, r in enumerate(rs)}
    for block in (50, 4096):
        found = {r.heartbeat_id: r.q_peak for r in wavelets.q_peaks_by_wavelet(beats, samples, 250, search=0.1, block=block).collect()}
        assert found.keys() == lows.keys() and all(abs(found[k] - lows[k]) <= 1 for k in lows)


# tremor


def plain_tremor(v, s):
    """One session's tremor, by loops."""
    n, longest = len(v), s.longest
    voiced = [i for i in range(n) if v[i] is not None]
    mean, middle = sum(v[i] for i in voiced) / len(voiced), sum(voiced) / len(voiced)
    below = sum((i - middle) ** 2 for i in voiced)
    slope = sum((i - middle) * v[i] for i in voiced) / below if below else 0.0
    x = [0.0 if v[i] is None else (v[i] - slope * (i - middle) - mean) / mean for i in range(n)]
    peak = max(x) - min(x)
    options = []
    starts = [k * longest for k in range(n) if k * longest + 2 * longest + 1 < n]
    for at in starts:
        own = x[at : at + 2 * longest + 2]
        centre = sum(own) / len(own)
        own = [a - centre for a in own]
        r = []
        for lag in range(longest + 2):
            a, b = own[:longest], own[lag : lag + longest]
            e = math.sqrt(sum(p * p for p in a) * sum(p * p for p in b))
            r.append(sum(p * q for p, q in zip(a, b)) / e if e else 0.0)
        level = max(map(abs, own)) / peak if peak else 0.0
        found = [(0.0, s.voicing + max(0.0, 2 - level * (1 + s.voicing) / s.silence))]
        for lag in range(s.shortest, longest + 1):
            if r[lag] > s.voicing / 2 and r[lag] > r[lag - 1] and r[lag] >= r[lag + 1]:
                d, bend = (r[lag + 1] - r[lag - 1]) / 2, 2 * r[lag] - r[lag - 1] - r[lag + 1]
                top = r[lag] + d * d / bend / 2
                found.append((1 / s.step / (lag + d / bend), 1 / top if top > 1 else top))
        options.append(found)
    best = [(0.0, [])]

    def cost(a, b):
        if a > 0 and b > 0:
            return s.jump * abs(math.log2(a / b))
        return s.change if (a > 0) != (b > 0) else 0.0

    paths = [([], 0.0)]
    for k, found in enumerate(options):
        grown = []
        for f, strength in found:
            worth = strength - (s.octave * math.log2(s.high / f) if f > 0 else 0.0)
            grown.append(max((([*p, f], t - (0.01 / (longest * s.step) * cost(p[-1], f) if p else 0.0) + worth) for p, t in paths), key=lambda c: c[1]))
        paths = grown
    path = max(paths, key=lambda c: c[1])[0] if options else []
    assert best
    freqs, highs, lows = [f for f in path if f > 0], [], []
    for at, f in zip(starts, path):
        if f > 0:
            half = max(1, round(1 / f / s.step / 2))
            for sign, into in ((1, highs), (-1, lows)):
                y = [sign * a for a in x]
                lo, hi = max(0, at - longest // 2 - 1), at + 2 * longest + 2
                into += [abs(y[i]) for i in range(max(at, 1), at + longest) if y[i - 1] < y[i] >= y[i + 1] and y[i] >= max(y[max(i - half, lo) : min(i + half + 1, hi)])]
    freq = sum(freqs) / len(freqs) if freqs else None
    index = 50 * (sum(highs) / len(highs) + sum(lows) / len(lows)) if highs and lows else None
    return freq, index, None if index is None else index * freq / (freq + 1)


def test_tremor_equals_a_plain_one(spark):
    rng, s = random.Random(5), tremor.Settings(step=0.04)
    made = {}
    for session in range(12):
        f, n = rng.uniform(2, 9), rng.randrange(20, 220)
        made[session] = [None if rng.random() < 0.1 else 120 + 0.05 * i + 9 * math.sin(2 * math.pi * f * i * s.step) + rng.gauss(0, 1 + session) for i in range(n)]
    made[20], made[21] = [5.0] * 100, [None] * 10 + [4.0]
    rows = [(k, i, v) for k, own in made.items() for i, v in enumerate(own)]
    found = {r.session_id: r for r in tremor.tremor(spark.createDataFrame(rows, "session_id long, idx long, value double").repartition(5), s).collect()}
    assert found.keys() == made.keys()
    for k, own in made.items():
        for a, b in zip((found[k].freq, found[k]["index"], found[k].power), plain_tremor(own, s), strict=True):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9))


def test_tremor_of_a_steady_oscillation(spark):
    s = tremor.Settings()
    rows = [(1, i, 150 * (1 + 0.08 * math.sin(2 * math.pi * 5 * i * s.step))) for i in range(800)] + [(2, i, 100.0 + (i % 2)) for i in range(30)]
    found = {r.session_id: r for r in tremor.tremor(spark.createDataFrame(rows, "session_id long, idx long, value double"), s).collect()}
    assert abs(found[1].freq - 5) < 0.05 and abs(found[1]["index"] - 8) < 0.4 and found[2].freq is None


def test_result_lines_are_read_back(spark):
    a = spark.createDataFrame([(1, 4.5678, 1.23456, 2.0), (2, None, None, None)], "session_id long, freq double, index double, power double")
    b = spark.createDataFrame([(1, 3.0, None, None), (3, 2.0, 3.0, 4.0)], "session_id long, freq double, index double, power double")
    lines = {r.session_id: r.line for r in tremor.result_line(a, b).collect()}
    assert lines[1] == '{"FTrF": 4.57, "ATrF": 3.00, "FTrI": 1.235, "ATrI": --undefined--, "FTrP": 2.000, "ATrP": --undefined--}'
    assert json.loads(lines[2].replace("--undefined--", "0")) == dict.fromkeys(("FTrF", "ATrF", "FTrI", "ATrI", "FTrP", "ATrP"), 0)
    found = {r.session_id: r for r in tremor.parsed_results(spark.createDataFrame([*lines.items(), (4, "no JSON")], "session_id long, line string")).collect()}
    assert (found[1].mov_freqtremfreq, found[1].mov_amptremindex, found[2].mov_freqtremfreq, found[4].mov_freqtremfreq) == (4.57, 0.0, 0.0, None)


def test_resampling_spreads_over_blocks_and_keeps_levels(spark):
    rng = random.Random(6)
    points, lengths = [], []
    for session in range(3):
        t = 0.0
        for i in range(40):
            t += rng.choice([0.03, 0.4, 1.7]) * rng.uniform(0.5, 1)
            points.append((session, i, t, 7.0 if session == 0 else rng.uniform(0, 9)))
        lengths.append((session, t + 1))
    points.append((5, 0, 2.5, 3.0))
    lengths.append((5, 4.0))
    own = spark.createDataFrame(points, "session_id long, idx long, t double, value double").repartition(4)
    ends = spark.createDataFrame(lengths, "session_id long, length double")
    whole, small = ([tuple(r) for r in tremor.resampled(own, ends, 0.5, 0.25, block=b).orderBy("session_id", "idx").collect()] for b in (4096, 3))
    assert whole == small
    assert all(math.isclose(v, 7.0) for s, _, v in whole if s == 0)
    for s in (0, 1, 2):
        assert [i for k, i, _ in whole if k == s] == list(range(sum(k == s for k, *_ in whole)))


# extraction


def test_segment_moments_are_those_of_a_scan(spark):
    rng = random.Random(7)
    frames = [(s, i, None if rng.random() < 0.1 else 1e9 + rng.random() if s else float("nan") if i == 3 else rng.gauss(0, 5)) for s in range(3) for i in range(40)]
    segments = [(k, rng.randrange(4), a := rng.randrange(-5, 45), a + rng.randrange(-3, 30)) for k in range(120)]
    found = extraction.segment_moments(spark.createDataFrame(frames, "session_id long, idx long, value double").repartition(3), spark.createDataFrame(segments, "segment_id long, session_id long, start long, stop long"), ["value"], block=8)
    rows = {r.segment_id: r for r in found.collect()}
    assert len(rows) == 120
    for k, session, a, b in segments:
        own = [v for s, i, v in frames if s == session and a <= i < b and v is not None and not math.isnan(v)]
        assert rows[k].value_count == len(own)
        assert (rows[k].value_mean is None) == (not own) and (not own or math.isclose(rows[k].value_mean, statistics.fmean(own), rel_tol=1e-12))
        assert (rows[k].value_std is None) == (len(own) < 2) and (len(own) < 2 or math.isclose(rows[k].value_std, statistics.stdev(own), rel_tol=1e-6, abs_tol=1e-7))


def test_extraction_gives_the_tables_of_what_is_there(spark):
    assert extraction.extract_features() == {}
    frames = spark.createDataFrame([(1, i, i % 5 != 4, 120.0 + i % 3, 1.0, i % 9 < 5) for i in range(60)], "session_id long, idx long, voiced boolean, pitch double, amplitude double, speech boolean")
    segments = spark.createDataFrame([(10, 1, 0, 60), (11, 1, 20, 22)], "segment_id long, session_id long, start long, stop long")
    blinks = spark.createDataFrame([(1, 2.0, 5.0)], "session_id long, duration double, fps double"), spark.createDataFrame([(1, 3)], "session_id long, frame long")
    voice = frames.withColumn("period", F.lit(0.01)).withColumn("gne", F.lit(0.5)), F.col("voiced")
    tables = extraction.extract_features(voice, blinks, (frames, segments, 0.02))
    assert list(tables) == ["df_jitter", "df_shimmer", "df_gne", "df_eyeblink", "df_pause_segment", "df_vfs", "df_vt"]
    vfs = {r.segment_id: r for r in tables["df_vfs"].collect()}
    assert math.isclose(vfs[10].aco_voicepct, 100 * sum(i % 9 < 5 for i in range(60)) / 60) and vfs[10].error is None
    assert vfs[11].aco_voicepct is None and vfs[11].error == "shorter than 0.064 s"
    assert {r.segment_id: r.error for r in tables["df_vt"].collect()} == {10: None, 11: "shorter than 0.5 s"}
    assert tables["df_jitter"].count() == 12 and tables["df_eyeblink"].filter("blink = 1").count() == 1


def test_catalog_deviations_keep_their_digits(spark):
    rows = [(1, 1e9 + k, 1.0) for k in range(4)] + [(2, 5.0, 2.0), (2, None, 3.0), (None, 1.0, 1.0), (None, 3.0, 1.0)]
    own = spark.createDataFrame(rows, "session_id long, aco_jitter double, length double")
    out = {(r.session_id, r.metric): r.data for r in catalog.derived({"acoustic_seg": own}, ["session_id"], {"acoustic_seg": "length"}).filter("feature = 'jitter'").collect()}
    assert math.isclose(out[1, "wstd"], statistics.stdev(range(4)), rel_tol=1e-9) and out[1, "wmean"] == 1e9 + 1.5
    assert out[2, "wmean"] == 5.0 and out[2, "wstd"] is None
