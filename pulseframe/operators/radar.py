"""Radar recordings: the signals derived from the two channels, whole windows, and intervals between beats."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.filters import Design, butterworth, spaced_peaks, zero_phase
from pulseframe.operators.signals import ordered

# Fixed values of the sensor: carrier in Hz, speed of light in air near the ground in m/s.
CARRIER_HZ = 61e9
LIGHT_MPS = 299708516
METERS = LIGHT_MPS / (4 * math.pi * CARRIER_HZ)
PREPARED = "session_id long, idx long, radius double, heart_sound double, pulse_wave double, phase double, breathing double, breath boolean"


@lru_cache(maxsize=32)
def _sections(order: int, low: float | None, high: float | None, fs: float) -> np.ndarray:
    return butterworth(Design("butterworth", order=order, low=low, high=high, fs=fs))


def channels(i: np.ndarray, q: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """The derived signals of one recording."""
    run = lambda x, order, low=None, high=None: zero_phase(x, _sections(order, low, high, fs))
    radius = np.hypot(run(i, 4, 0.2), run(q, 4, 0.2))
    phase = np.unwrap(np.arctan2(i, q)) * METERS
    breathing = run(phase, 4, None, 0.2)
    breath = np.zeros(len(i), bool)
    breath[spaced_peaks(breathing, -math.inf, 2 * fs)] = True
    return {"radius": radius, "heart_sound": run(radius, 5, 15.0, 60.0), "pulse_wave": run(radius, 4, None, 1.5), "phase": phase, "breathing": breathing, "breath": breath}


def prepared(df: DataFrame, fs: float) -> DataFrame:
    """PREPARED rows of df(session_id, idx, i, q): the radius without its drift, heart sounds (15 to 60 Hz), pulse wave (up to 1.5 Hz),
    the unwrapped phase in metres, breathing (up to 0.2 Hz) and its peaks at least two seconds apart. A session must fit a task; fs is above 120, twice the highest edge."""
    if fs <= 120:
        raise ValueError("heart sounds up to 60 Hz need a sampling rate above 120 Hz")

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        return own[["session_id", "idx"]].assign(**channels(own["i"].to_numpy(float), own["q"].to_numpy(float), fs))

    return df.select("session_id", "idx", "i", "q").groupBy("session_id").applyInPandas(one, PREPARED)


def whole_windows(df: DataFrame, fs: int, seconds: int) -> DataFrame:
    """df(session_id, idx, ...) with window, the tumbling windows of `seconds` that end within a session's duration, (n - 1) / fs; the last, partial one is dropped."""
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    size = fs * seconds
    return df.withColumn("n", n).filter(F.col("idx") < F.floor((F.col("n") - 1) / size) * size).drop("n").withColumn("window", F.floor(F.col("idx") / size))


def beat_intervals(peaks: DataFrame, fs: float) -> DataFrame:
    """(session_id, idx, quality 1, outlier 0, rr) of peaks(session_id, idx): seconds to the next peak; the last one has the mean of the session's, its own 0 included."""
    step = F.coalesce((F.lead("idx").over(ordered()) - F.col("idx")) / fs, F.lit(0.0))
    last = F.lead("idx").over(ordered()).isNull()
    rows = peaks.select("session_id", "idx", step.alias("step"), last.alias("last"))
    mean = F.avg("step").over(Window.partitionBy("session_id"))
    return rows.select("session_id", "idx", F.lit(1.0).alias("quality"), F.lit(0.0).alias("outlier"), F.when(F.col("last"), mean).otherwise(F.col("step")).alias("rr"))
