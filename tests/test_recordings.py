"""WAV files, segments, radar channels, autoregressions, the elliptic design and B points on rises, against plain restatements and known answers."""

from __future__ import annotations

import math
import wave

import numpy as np
import pytest
from pulseframe.operators import autoregression, cardiac, filters, monotone, radar
from pulseframe.sources import wav


def _wav(path, values, channels=1, width=2, fs=8000):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(fs)
        f.writeframes(np.asarray(values).astype("<i2" if width == 2 else "u1").tobytes())


def test_wav_files(spark, tmp_path):
    _wav(tmp_path / "mono.wav", range(-5, 100000))
    _wav(tmp_path / "stereo.wav", [1, 2, -3, -4, 5, 8], channels=2, fs=44100)
    _wav(tmp_path / "bytes.wav", [0, 255], width=1)
    _wav(tmp_path / "empty.wav", [])
    (tmp_path / "broken.wav").write_bytes(b"RIFF")
    (tmp_path / "other.txt").write_text("no audio")
    found = wav.files(spark, f"file://{tmp_path}")
    facts = {r.path.split("/")[-1]: r for r in wav.checked(wav.info(found)).collect()}
    assert {n: r.error for n, r in facts.items() if n != "broken.wav"} == {"mono.wav": None, "stereo.wav": "not mono", "bytes.wav": "not 16 bit", "empty.wav": None}
    assert facts["broken.wav"].error.startswith("not a PCM WAV") and facts["broken.wav"].n is None and facts["mono.wav"].n == 100005
    rows = wav.timed(wav.frames(found)).collect()
    mono = sorted((r.idx, r.value, r.t) for r in rows if r.path.endswith("mono.wav"))
    assert [v for _, v, _ in mono] == list(range(-5, 32768)) + [int(np.int64(x).astype("<i2")) for x in range(32768, 100000)] and mono[1][2] == 0.000125
    assert sorted((r.channel, r.idx, r.value) for r in rows if r.path.endswith("stereo.wav")) == [(0, 0, 1), (0, 1, -3), (0, 2, 5), (1, 0, 2), (1, 1, -4), (1, 2, 8)]
    assert [(r.idx, r.value) for r in wav.to_mono(wav.frames(found).filter("path like '%stereo.wav'")).orderBy("idx").collect()] == [(0, 1), (1, -4), (2, 6)]


def test_cut(spark):
    samples = spark.createDataFrame([(1, i, float(i)) for i in range(25)], "session_id long, idx long, value double")
    segments = spark.createDataFrame([(1, 0, 0.25, 1.1), (1, 1, 2.3, None), (1, 2, 2.0, 9.0), (1, 3, 0.5, 0.5), (2, 0, 0.0, 1.0)], "session_id long, segment long, start double, stop double")
    got = {}
    for r in wav.cut(samples, segments, 10).orderBy("segment", "idx").collect():
        got.setdefault((r.session_id, r.segment, r.stop), []).append((r.idx, r.value))
    assert {k: [v for _, v in rows] for k, rows in got.items()} == {(1, 0, 1.1): list(range(2, 11)), (1, 1, 2.5): [23, 24], (1, 2, 9.0): list(range(20, 25))}
    assert all([i for i, _ in rows] == list(range(len(rows))) for rows in got.values())


def test_elliptic_response():
    for order, low, high, stop in ((2, 0.75, 40.0, None), (6, 20.0, 100.0, 200.0)):
        sections = filters.elliptic(filters.Design("elliptic", order=order, low=low, high=high, fs=1000.0))
        gain = lambda f: 20 * math.log10(np.prod([abs((s[:3] @ np.exp(-2j * math.pi * f / 1000 * np.arange(3))) / (np.array([1, s[3], s[4]]) @ np.exp(-2j * math.pi * f / 1000 * np.arange(3)))) for s in sections]) + 1e-12)  # noqa: B023, E731
        band = [gain(f) for f in np.linspace(low, high, 3000)]
        assert max(band) == pytest.approx(0, abs=1e-3) and min(band) == pytest.approx(-1, abs=1e-3) and gain(high) == pytest.approx(-1, abs=1e-6) and gain(0.0) == pytest.approx(-80, abs=1e-3)
        assert stop is None or max(gain(f) for f in np.linspace(stop, 499, 500)) < -79.99
    with pytest.raises(ValueError):
        filters.elliptic(filters.Design("elliptic", order=3, low=1.0, high=2.0))


def test_radar(spark):
    fs, n = 200, 6000
    t = np.arange(n) / fs
    angle = 6 * np.sin(2 * math.pi * 0.1 * t)
    rows = [(1, i, float(np.sin(a)), float(np.cos(a))) for i, a in enumerate(angle)] + [(2, 0, 1.0, 0.0)]
    out = radar.prepared(spark.createDataFrame(rows, "session_id long, idx long, i double, q double"), float(fs)).orderBy("session_id", "idx").collect()
    own = [r for r in out if r.session_id == 1]
    assert np.allclose([r.phase for r in own], angle * radar.METERS, atol=1e-9) and len(out) == n + 1
    middle = slice(1000, 5000)
    assert np.allclose([r.breathing for r in own[middle]], (angle * radar.METERS)[middle], atol=0.03 * 6 * radar.METERS)
    assert [round(r.idx / fs, 1) for r in own if r.breath] == pytest.approx([2.5, 12.5, 22.5], abs=0.2)
    with pytest.raises(ValueError):
        radar.prepared(spark.createDataFrame(rows, "session_id long, idx long, i double, q double"), 100.0)
    peaks = spark.createDataFrame([(1, 10), (1, 40), (1, 60), (2, 5)], "session_id long, idx long")
    assert [round(r.rr, 6) for r in radar.beat_intervals(peaks, 10.0).orderBy("session_id", "idx").collect()] == [3.0, 2.0, round(5 / 3, 6), 0.0]
    windows = radar.whole_windows(spark.createDataFrame([(1, i) for i in range(61)] + [(2, i) for i in range(20)], "session_id long, idx long"), 10, 2)
    assert {(r.session_id, r.window): r["count"] for r in windows.groupBy("session_id", "window").count().collect()} == {(1, 0): 20, (1, 1): 20, (1, 2): 20}


def _series(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.zeros(n + 200)
    for t in range(2, len(x)):
        x[t] = 1.2 * x[t - 1] - 0.6 * x[t - 2] + rng.normal()
    return x[200:] + 5


def test_autoregression():
    x = _series(2000)
    assert chosen(x) == autoregression.chosen_order(x, 8) and autoregression.chosen_order(x, 8) >= 2
    predictors, left = autoregression.burg(x - x.mean(), 2)
    assert predictors[2] == pytest.approx([1.2, -0.6], abs=0.05)
    model = autoregression.Model(x[:300], 3)
    assert model.mean == pytest.approx(5, abs=0.6)
    # a predictor of order m is the best one for the covariances that the full model implies
    lags = [1.0]
    for p in model.predictors[1:]:
        lags.append(float(p[: len(lags)] @ np.array(lags[::-1])))
    for m in (1, 2, 3):
        cov = np.array([[lags[abs(i - j)] for j in range(m)] for i in range(m)])
        assert np.linalg.solve(cov, lags[1 : m + 1]) == pytest.approx(model.predictors[m], abs=1e-8)
    assert model.predict(0) == model.mean
    assert model.predict(300) == pytest.approx(model.mean + model.predictors[3] @ (x[297:300][::-1] - model.mean))


def chosen(x, most=8):
    best = (math.inf, 0)
    for p in range(most + 1):
        a = np.array([[1, *(x[t - k] for k in range(1, p + 1))] for t in range(most, len(x))])
        y = x[most:]
        sse = float(np.sum((y - a @ np.linalg.pinv(a) @ y) ** 2))
        best = min(best, (len(y) * math.log(sse / len(y)) + 2 * (p + 1), p))
    return best[1]


def test_restored():
    x = _series(200, 3)
    hit = np.zeros(200, bool)
    hit[[0, 50, 51, 199]] = True
    spoiled = np.where(hit, x + 40, x)
    out = autoregression.restored(spoiled, hit)
    assert np.array_equal(out[~hit], x[~hit]) and np.abs(out - x).max() < 6
    for n in (1, 2, 5):
        assert autoregression.restored(np.ones(n), np.zeros(n, bool)) == pytest.approx(np.ones(n))
    assert np.array_equal(autoregression.restored(np.array([3.0]), np.array([True])), [3.0])


def _monotone(x, r, a, c, fs):
    """The B point of one beat, step by step."""
    d2 = np.gradient(x)
    d3 = np.gradient(d2)
    borders = [[a, "start", True]]
    for i in range(a + 1, c - 1):
        if d2[i] < 0 <= d2[i + 1]:
            borders.append([i, "start", True])
        elif d2[i] >= 0 > d2[i + 1]:
            borders.append([i, "end", True])
    borders.append([c, "end", True])
    high = [k for k, (i, kind, _) in enumerate(borders) if kind == "start" and x[i] > int(x[c] / 2)]
    for k in high:
        borders[k + 1][2] = borders[k][2] = False
    low = [k for k, (i, kind, there) in enumerate(borders) if there and kind == "end" and x[i] < int(2 * x[c] / 3)]
    if any(not borders[k - 1][2] for k in low):
        return None
    for k in low:
        borders[k - 1][2] = borders[k][2] = False
    left = [i for i, _, there in borders if there]
    if not left or left == [a]:
        return None
    lo, hi = left[0], left[-1]
    if len(left) > 2:
        k = max(range(1, len(left)), key=lambda k: (x[left[k]] - x[left[k - 1]], -k))
        lo, hi = left[k - 1], left[k]
    hi -= int((2 / 3) * (hi - lo))
    h, best = x[c] - x[a], lo
    for i in range(lo, hi):
        before, after = d3[i - 1] if i > lo else d3[i], d3[i + 1] if i + 1 < hi else d3[i]
        if (i + 1 < hi and (d3[i] < 0) != (d3[i + 1] < 0) and 0 <= d2[i] < 10 * h / fs) or (d3[i] >= before and d3[i] >= after and d3[i] >= 4 * h / fs):
            best = i
    return best


def test_monotone(spark):
    rng = np.random.default_rng(8)
    samples, beats, points, signals = [], [], [], {}
    for s in range(12):
        x = np.cumsum(rng.normal(size=400)).round(3) if s % 2 else (30 * np.sin(np.arange(400) / 6) ** 3 + rng.normal(size=400)).round(3)
        signals[s] = x
        samples += [(s, i, float(v)) for i, v in enumerate(x)]
        for k, r in enumerate(range(10, 370, 40)):
            c = r + 5 + int(np.argmax(x[r + 5 : r + 25]))
            beats.append((s, k, r - 10, r + 30, r, 40.0))
            points.append((s, k, None if (s, k) == (3, 4) else c))
    b = spark.createDataFrame(beats, "session_id long, heartbeat_id long, start_sample long, end_sample long, r_peak_sample long, rr_interval_samples double")
    x = spark.createDataFrame(samples, "session_id long, idx long, value double")
    c = spark.createDataFrame(points, "session_id long, heartbeat_id long, c_point long")
    at = {(r.session_id, r.heartbeat_id): r.a_point for r in cardiac.a_points(b, x, c).collect()}
    cs = {(s, k): v for s, k, v in points}
    got = {(r.session_id, r.heartbeat_id): r.b_point for r in monotone.b_points_monotone(b, x, c, 50.0).collect()}
    wanted = {k: None if at[k] is None else _monotone(signals[k[0]], 0, at[k], cs[k], 50.0) for k in cs}
    assert got == wanted and sum(v is not None for v in got.values()) > 30
    rest = {(r.session_id, r.heartbeat_id): r.b_point for r in monotone.b_points_monotone(b, x, c, 50.0, correct_outliers=True).collect()}
    assert all(rest[k] == v for k, v in got.items() if v is not None) and rest[(0, 0)] is None
