"""Autoregressive models of short series, and the correction of outlying B points with them, session by session.

A session's points are one row a heartbeat, so the group in a task is a few numbers a beat; every cycle refits both models.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pulseframe.operators.correction import POINTS, _filled, _outlying, baseline

_MAX_LAG, _CYCLES, _FITS = 30, 29, 1000


def chosen_order(x: np.ndarray, most: int = _MAX_LAG) -> int:
    """The order in 0..most with the least AIC among regressions on a constant and the last values, all over the same samples.

    `most` is lowered until there are at least as many samples as coefficients; 0 where that leaves none.
    """
    while most > 0 and len(x) - most < most + 1:
        most -= 1
    y, best = x[most:], (math.inf, 0)
    for p in range(most + 1):
        rows = np.column_stack([np.ones(len(y)), *(x[most - k : len(x) - k] for k in range(1, p + 1))])
        rest = y - rows @ np.linalg.lstsq(rows, y, rcond=None)[0]
        aic = len(y) * math.log(max(float(rest @ rest) / max(len(y), 1), 1e-300)) + 2 * (p + 1)
        if aic < best[0] - 1e-9:
            best = (aic, p)
    return best[1]


def burg(x: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Predictors of order 0..order of a series without its mean, and the shares of variance that they leave, by Burg's reflection coefficients."""
    ahead, behind = x.copy(), x.copy()
    predictors, left = [np.zeros(0)], [1.0]
    for _ in range(order):
        f, b = ahead[1:], behind[:-1]
        below = float(f @ f + b @ b)
        k = 2 * float(f @ b) / below if below > 0 else 0.0
        last = predictors[-1]
        longer = np.empty(len(last) + 1)
        longer[:-1], longer[-1] = last - k * last[::-1], k
        predictors.append(longer)
        left.append(left[-1] * max(1 - k * k, 1e-12))
        ahead, behind = f - k * b, b - k * f
    return predictors, np.array(left)


class Model:
    """An autoregression of a chosen order around a constant, both fitted in turns: reflection coefficients of the rest, then the constant by least squares on what the predictors leave."""

    def __init__(self, x: np.ndarray, order: int) -> None:
        self.x, self.order, self.mean = x, order, float(np.mean(x))
        for _ in range(_FITS):
            self.predictors, left = burg(x - self.mean, order)
            ones, own = self._rests(np.ones(len(x))), self._rests(x)
            weight = ones / left[np.minimum(np.arange(len(x)), order)]
            mean = float(weight @ own) / float(weight @ ones) if float(weight @ ones) > 1e-12 else self.mean
            moved, self.mean = abs(mean - self.mean), mean
            if moved <= 1e-10 * max(1.0, abs(mean)):
                break
        else:
            raise ArithmeticError(f"the constant of an autoregression of order {order} still moves by {moved} after {_FITS} fits")
        self.predictors, _ = burg(x - self.mean, order)

    def _rests(self, v: np.ndarray) -> np.ndarray:
        """What the predictors leave of each value: those of rising order at the start, then the full one over all windows at once."""
        out, n = v.astype(float), min(self.order, len(v))
        for t in range(1, n):
            out[t] -= self.predictors[t] @ v[:t][::-1]
        if 0 < self.order < len(v):
            own = np.ascontiguousarray(v, float)
            windows = np.ndarray((len(v) - n, n), float, own, 0, own.strides * 2)  # sliding_window_view, whose own checks cost more than the product
            out[n:] -= windows @ self.predictors[n][::-1]
        return out

    def predict(self, t: int) -> float:
        """The best linear prediction of x[t], t at most len(x), from all values in front of it."""
        p = self.predictors[min(t, self.order)]
        return self.mean + float(p @ (self.x[t - len(p) : t][::-1] - self.mean))


def restored(stationary: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Hit values as the mean of a forward and a backward prediction over the series whose hits are on the line between their neighbours.

    The backward prediction is for one place behind the mirrored one, as the published procedure counts it. Leading hits,
    which have no line, take the first value that was not hit.
    """
    line = _filled(np.where(hit, np.nan, stationary))
    known = np.flatnonzero(~np.isnan(line))
    if not len(known):
        return stationary.copy()
    line[: known[0]] = line[known[0]]
    turned = line[::-1].copy()
    forward, back = Model(line, chosen_order(line)), Model(turned, chosen_order(turned))
    out = stationary.copy()
    for t in np.flatnonzero(hit):
        out[t] = (forward.predict(int(t)) + back.predict(len(line) - int(t))) / 2
    return out


def _corrected(own: pd.DataFrame, fs: float, cycles: int) -> pd.DataFrame:
    own = own.sort_values("heartbeat_id")
    b = _rounds(own["b_point"].to_numpy(float, na_value=np.nan), own["c_point"].to_numpy(float, na_value=np.nan), fs, cycles)
    return own[["session_id", "heartbeat_id"]].assign(b_point=pd.array(b, dtype="Float64").astype("Int64"))


def _rounds(b: np.ndarray, c: np.ndarray, fs: float, cycles: int) -> np.ndarray:
    raw = b.copy()
    for _ in range(cycles):
        both = np.flatnonzero(~np.isnan(b) & ~np.isnan(c))
        if not len(both):
            break
        distance = (c[both] - b[both]) / fs
        base = baseline(distance)
        hit = _outlying(distance - base)
        if not hit.any():
            break
        fresh = np.trunc(np.round(c[both] - (restored(distance - base, hit) + base) * fs, 6))
        b = raw.copy()
        b[both] = np.where(fresh == 0, np.nan, fresh)
    return b


def corrected(points: DataFrame, fs: float, cycles: int = _CYCLES) -> DataFrame:
    """(beat, b_point) of points(beat, b_point, c_point): outlying distances to C, as in correction.stationarised, are predicted in cycles until there are none, at most `cycles`.

    Values are rounded to 6 decimals before they are cut to whole samples; a point at 0 is null. Beats without both points keep what they have.
    """

    def one(own: pd.DataFrame) -> pd.DataFrame:
        return _corrected(own, fs, cycles)

    return points.groupBy("session_id").applyInPandas(one, POINTS + "b_point long")
