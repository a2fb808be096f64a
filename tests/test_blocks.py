"""Rolling quantiles on blocks and the speaker timeline on intervals, against plain restatements."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pulseframe.operators import rr, speech


def test_rolling_quantiles():
    rng = np.random.default_rng(2)
    for n, half in ((1, 3), (5, 5), (40, 3), (7, 45)):
        x = rng.normal(0, 1, n)
        x[rng.random(n) < 0.2] = np.nan
        found = rr.rolling_quantiles(x, half, (0.25, 0.5, 0.75))
        for i in range(n):
            near = x[max(0, i - half) : i + half + 1]
            near = near[~np.isnan(near)]
            wanted = np.quantile(near, [0.25, 0.5, 0.75]) if len(near) else [np.nan] * 3
            assert np.allclose(found[i], wanted, equal_nan=True)


@pytest.mark.parametrize("block", [16, 1 << 13])
def test_artefacts_do_not_depend_on_blocks(spark, block):
    rng = random.Random(4)
    rows = [(s, i, 800 + rng.gauss(0, 20) + (400 if rng.random() < 0.04 else 0)) for s, n in enumerate((1, 2, 60, 230)) for i in range(n)]
    df = spark.createDataFrame(rows, "session_id long, idx long, rr_ms double").repartition(4)
    found = {(r.session_id, r.idx): r for r in rr.artefacts(df, block=block).collect()}
    assert len(found) == len(rows)
    for s in range(4):
        x = np.array([v for t, _, v in rows if t == s])
        d = np.diff(x, prepend=np.nan)
        d[0] = np.nanmean(d) if len(x) > 1 else np.nan
        near = lambda a, i, h: a[max(0, i - h) : i + h + 1][~np.isnan(a[max(0, i - h) : i + h + 1])]
        off = np.array([x[i] - np.median(near(x, i, 5)) for i in range(len(x))])
        m = np.where(off < 0, 2 * off, off)
        for i in range(len(x)):
            for name, a in (("threshold1", np.abs(d)), ("threshold2", np.abs(m))):
                own = near(a, i, 45)
                wanted = 5.2 * (np.quantile(own, 0.75) - np.quantile(own, 0.25)) / 2 if len(own) else None
                value = found[s, i][name]
                assert (value is None) == (wanted is None) and (value is None or math.isclose(value, wanted, rel_tol=1e-9, abs_tol=1e-9))


def plain_timeline(segments, fs):
    """Flags of every sample of one session, sample by sample."""
    total = {}
    for a, b, who in segments:
        total[who] = round(total.get(who, 0) + b - a, 6)
    test = min(total, key=lambda w: (-total[w], w))
    spans = [(math.ceil(round(a * fs, 6)), math.floor(round(b * fs, 6)), who) for a, b, who in sorted(segments)]
    n = math.floor(round(max(b for _, b, _ in segments) * fs, 6)) + 1
    rows = []
    for i in range(n):
        on = [who for a, b, who in spans if a <= i <= b]
        rows.append([int(set(on) == {test}), int(bool(on) and on[-1] != test)])
    at = 0
    while at < n:
        stop = at
        while stop < n and rows[stop][0] == rows[at][0]:
            stop += 1
        if not rows[at][0] and any(p for _, p in rows[at:stop]):
            for k in range(at, stop):
                rows[k][1] = 1
        at = stop
    return {i: tuple(r) for i, r in enumerate(rows)}


def test_timeline(spark):
    rng = random.Random(6)
    made = {}
    for session in range(25):
        made[session] = [(a := round(rng.uniform(0, 6), 2), round(a + rng.uniform(0.3, 3), 2), rng.choice("ABC")) for _ in range(rng.randrange(1, 7))]
    rows = [(s, *seg, seg[1] - seg[0]) for s, own in made.items() for seg in own]
    df = spark.createDataFrame(rows, "session_id long, start double, stop double, speaker string, length double").repartition(3)
    found = {}
    for r in speech.speaker_timeline(df, 20).collect():
        found.setdefault(r.session_id, {})[r.idx] = (r.test, r.panel)
    assert found == {s: plain_timeline(own, 20) for s, own in made.items()}
    intervals = speech.speaker_intervals(df, 20).count()
    assert intervals <= sum(2 * len(own) + 4 for own in made.values())
