"""Cycles of the correction start from the given points: a point that a cycle lost is back in the next."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pulseframe.operators import correction


def plain(b, c, fs, cycles):
    """The loop, step by step, on one session without gaps in c."""
    given, now = list(b), list(b)
    lost = 0
    for _ in range(cycles):
        rows = [i for i, x in enumerate(now) if x is not None]
        distance = np.array([(c[i] - now[i]) / fs for i in rows])
        base = correction.baseline(distance)
        rest = distance - base
        off = rest - np.median(rest)
        hit = off > 3 * np.median(np.abs(off))
        if not hit.any():
            break
        line = pd.Series(np.where(hit, np.nan, rest)).interpolate().to_numpy()
        fresh = [None if np.isnan(x) else int(np.trunc(round(c[i] - (x + y) * fs, 6))) for i, x, y in zip(rows, line, base)]
        now = list(given)
        for i, x in zip(rows, fresh):
            now[i] = None if x is None or x == 0 else x
        lost += sum(x is None for x in now)
    return now, lost


def test_points_come_back(spark):
    rng = np.random.default_rng(3)
    rows, wanted, lost = [], {}, 0
    for session in range(30):
        n = int(rng.integers(16, 60))
        c = [200 * i + 100 for i in range(n)]
        b = [x - int(40 + rng.normal(0, 2)) for x in c]
        for i in {0, *rng.integers(0, n, 3).tolist()}:  # the first has no earlier neighbour to draw a line from
            b[i] -= int(rng.integers(30, 90))
        wanted[session], gone = plain(b, c, 100.0, 199)
        lost += gone
        rows += [(session, i, b[i], c[i]) for i in range(n)]
    out = correction.corrected(spark.createDataFrame(rows, "session_id long, heartbeat_id long, b_point long, c_point long").repartition(4), 100.0)
    found = {}
    for r in out.collect():
        found.setdefault(r.session_id, {})[r.heartbeat_id] = r.b_point
    assert lost > 0
    assert {s: [own[i] for i in sorted(own)] for s, own in found.items()} == wanted
