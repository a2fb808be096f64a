"""Prominences over blocks, and C points chosen by history, against plain restatements."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pulseframe.operators import cardiac, prominence


def plain(v):
    """(position, prominence) of every peak, by walking from it to both sides."""
    out, i = [], 1
    while i < len(v) - 1:
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j + 1 < len(v) and v[j + 1] < v[i]:
            sides = []
            for side in (v[:i][::-1], v[j + 1 :]):
                low = v[i]
                for x in side:
                    if x > v[i]:
                        break
                    low = min(low, x)
                sides.append(low)
            out.append(((i + j) // 2, v[i] - max(sides)))
        i = j + 1
    return out


def series(rng):
    kind, n = rng.randrange(4), rng.randrange(1, 90)
    if kind == 0:
        return [float(rng.randrange(5)) for _ in range(n)]
    if kind == 1:
        return [i + 3.0 * (i % 2) for i in range(n)]
    if kind == 2:
        return [-i + 3.0 * (i % 2) for i in range(n)]
    return [rng.gauss(0, 1) for _ in range(n)]


def test_kernel():
    rng = random.Random(1)
    for _ in range(200):
        v = series(rng)
        at, size = prominence.peak_prominences(np.array(v))
        assert list(zip(at.tolist(), size.tolist())) == plain(v)


@pytest.mark.parametrize("block", [4, 1 << 14])
def test_blocks(spark, block):
    rng = random.Random(2)
    made = {k: series(rng) for k in range(40)}
    rows = [(k, i, x) for k, v in made.items() for i, x in enumerate(v)]
    found = {}
    for r in prominence.prominences(spark.createDataFrame(rows, "session_id long, idx long, value double").repartition(5), block).collect():
        found.setdefault(r.session_id, []).append((r.idx, r.prominence))
    assert {k: sorted(v) for k, v in found.items()} == {k: plain(v) for k, v in made.items() if plain(v)}


def test_c_points_by_history(spark):
    rng = random.Random(3)
    samples, beats, wanted = [], [], {}
    for session in range(6):
        v = [round(rng.gauss(0, 0.5), 2) for _ in range(200)]
        samples += [(session, i, x) for i, x in enumerate(v)]
        past = []
        for b in range(10):
            r = 20 * b + rng.randrange(3, 12)
            beats.append((session, b, 20 * b, 20 * b + 20, r))
            peaks = [(20 * b + at - r, size) for at, size in plain(v[20 * b : 20 * b + 20])]
            near = []
            for tenths in range(10, -1, -1):
                near = [o for o, size in peaks if size >= max(tenths / 10, 1e-16)]
                if near:
                    break
            if len(near) > 1:
                near = [o for o in near if o >= 0]
                if near and past:
                    mean = sum(past[-3:]) / len(past[-3:])
                    near = sorted(near, key=lambda o: (abs(o - mean), o))
            wanted[session, b] = r + near[0] if near and near[0] >= 0 else None
            if wanted[session, b] is not None:
                past.append(near[0])
    own = spark.createDataFrame(beats, "session_id long, heartbeat_id long, start_sample long, end_sample long, r_peak_sample long")
    out = cardiac.c_points_by_prominence(own, spark.createDataFrame(samples, "session_id long, idx long, value double").repartition(4))
    assert {(r.session_id, r.heartbeat_id): r.c_point for r in out.collect()} == wanted
