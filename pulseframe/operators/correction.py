"""Correction of outlying B points by the distance to C, session by session: a loop whose every cycle filters the whole series.

A session's points are one row a heartbeat, so the group in a task is a few numbers a beat.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pulseframe.operators.filters import Design, butterworth, zero_phase

_SHORT = 15  # series of up to so many distances are continued with their last one
_BASE = Design("butterworth", order=4, high=0.1, fs=1.0)
POINTS = "session_id long, heartbeat_id long, "


@lru_cache(maxsize=1)
def _base_sections() -> np.ndarray:
    return butterworth(_BASE)


def baseline(distance: np.ndarray) -> np.ndarray:
    """The low-pass part of a series of distances."""
    full = distance if len(distance) > _SHORT else np.append(distance, np.repeat(distance[-1:], _SHORT + 1 - len(distance)))
    return zero_phase(full, _base_sections())[: len(distance)]


def _outlying(stationary: np.ndarray) -> np.ndarray:
    off = stationary - np.median(stationary)
    return off > 3 * np.median(np.abs(off))


def _filled(x: np.ndarray) -> np.ndarray:
    """NaN on the line between their neighbours, trailing ones as the last value; leading ones stay."""
    known = np.flatnonzero(~np.isnan(x))
    out = np.interp(np.arange(len(x)), known, x[known]) if len(known) else x.copy()
    out[: known[0] if len(known) else 0] = np.nan
    return out


def _cycle(b: np.ndarray, c: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stationary distance, baseline, outlier, corrected b) of beats that have both points."""
    distance = (c - b) / fs
    base = baseline(distance)
    stationary = distance - base
    hit = _outlying(stationary)
    line = _filled(np.where(hit, np.nan, stationary))
    fresh = np.trunc(np.round(c - (line + base) * fs, 6))
    return stationary, base, hit, np.where(np.isnan(fresh) | (fresh == 0), np.nan, fresh)


def _stationarised(own: pd.DataFrame, fs: float) -> pd.DataFrame:
    own = own.dropna(subset=["b_point", "c_point"]).sort_values("heartbeat_id")
    if own.empty:
        return pd.DataFrame({c: [] for c in ("session_id", "heartbeat_id", "stationary", "baseline", "outlier", "corrected")})
    s, base, hit, fresh = _cycle(own["b_point"].to_numpy(float), own["c_point"].to_numpy(float), fs)
    return own[["session_id", "heartbeat_id"]].assign(stationary=s, baseline=base, outlier=hit, corrected=fresh)


def stationarised(points: DataFrame, fs: float) -> DataFrame:
    """(beat, stationary, baseline, outlier, corrected) of points(beat, b_point, c_point), for the beats that have both.

    The distance to C in seconds without its low-pass baseline; outliers are more than 3 median absolute deviations above the
    median; corrected is b_point after one cycle: outliers on the line between their neighbours, plus the baseline, cut to whole
    samples (after rounding to 6 decimals, so that unchanged points stay), null where that is 0 or there is no earlier neighbour.
    """

    def one(own: pd.DataFrame) -> pd.DataFrame:
        return _stationarised(own, fs)

    return points.groupBy("session_id").applyInPandas(one, POINTS + "stationary double, baseline double, outlier boolean, corrected double")


def _corrected(own: pd.DataFrame, fs: float, cycles: int) -> pd.DataFrame:
    own = own.sort_values("heartbeat_id")
    b, c = own["b_point"].to_numpy(float, na_value=np.nan), own["c_point"].to_numpy(float, na_value=np.nan)
    raw = b.copy()
    for _ in range(cycles):
        both = np.flatnonzero(~np.isnan(b) & ~np.isnan(c))
        if not len(both):
            break
        _, _, hit, fresh = _cycle(b[both], c[both], fs)
        if not hit.any():
            break
        b = raw.copy()
        b[both] = fresh
    return own[["session_id", "heartbeat_id"]].assign(b_point=pd.array(b, dtype="Float64").astype("Int64"))


def corrected(points: DataFrame, fs: float, cycles: int = 199) -> DataFrame:
    """(beat, b_point) of points(beat, b_point, c_point), corrected in cycles until there is no outlier, at most `cycles`.

    Beats without both points keep what they have. Every cycle corrects the given points, so one that a cycle had no line for is back in the next.
    """

    def one(own: pd.DataFrame) -> pd.DataFrame:
        return _corrected(own, fs, cycles)

    return points.groupBy("session_id").applyInPandas(one, POINTS + "b_point long")
