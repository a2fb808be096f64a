"""ECG cleaning and R peaks, as NumPy kernels over one session at a time."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from pulseframe.operators.filters import Design, butterworth, each_session, each_session_at, envelope, zero_phase

METHODS = ("biosppy", "neurokit")


def bandpass_taps(n: int, low: float, high: float, fs: float) -> np.ndarray:
    """n taps of a band-pass by the windowed-sinc method with a Hamming window, with gain 1 in the middle of the band."""
    at = np.arange(n) - (n - 1) / 2
    taps = (2 * high / fs * np.sinc(2 * high / fs * at) - 2 * low / fs * np.sinc(2 * low / fs * at)) * np.hamming(n)
    return taps / np.sum(taps * np.cos(np.pi * at * (low + high) / fs))


def _both_ways(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """A moving sum forward and backward, with odd extension of the ends and the first sample for ever before."""
    if len(x) < 2:
        return x * 0.0
    pad = min(len(x) - 1, 3 * len(taps))
    out = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        out = np.convolve(np.concatenate([np.full(len(taps) - 1, out[0]), out]), taps, "valid")[::-1]
    return out[pad : len(out) - pad]


def clean(x: np.ndarray, fs: float, method: str) -> np.ndarray:
    if method == "neurokit":  # a high-pass at 0.5 Hz, then the mean of one period of the 50 Hz mains
        out = zero_phase(x, butterworth(Design("butterworth", order=5, low=0.5, fs=fs)))
        n = max(1, int(fs / 50))
        return _both_ways(out, np.full(n, 1 / n))
    n = int(1.5 * fs) | 1  # about 1.5 s of samples, an odd number
    out = _both_ways(x, bandpass_taps(n, 0.67, min(45.0, 0.49 * fs), fs))
    return out - out.mean() if len(out) else out


def clean_ecg(df: DataFrame, fs: float, method: str = "biosppy") -> DataFrame:
    """(session_id, idx, value) of the cleaned signal: a zero-phase FIR band-pass of 0.67 to 45 Hz without its mean, or method neurokit.

    At low rates the upper edge is 0.49 * fs. Signals of one sample become 0.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    return each_session(df, partial(clean, fs=fs, method=method))


def r_positions(x: np.ndarray, fs: float) -> np.ndarray:
    """Peaks of the steepest stretches: where the smoothed absolute gradient exceeds 1.5 times its wider mean, the most prominent local maximum, at least 0.3 s apart."""
    if len(x) < 3:
        return np.zeros(0, int)
    steep = np.abs(np.gradient(x))
    mean = lambda v, n: np.convolve(np.pad(v, (n // 2, n - 1 - n // 2), mode="edge"), np.full(n, 1 / n), "valid")
    fine = mean(steep, max(1, round(0.1 * fs)))
    hot = np.concatenate([[False], fine > 1.5 * mean(fine, max(1, round(0.75 * fs))), [False]])
    begin, end = np.flatnonzero(hot[1:] & ~hot[:-1]), np.flatnonzero(~hot[1:] & hot[:-1])
    least = 0.4 * np.mean(end - begin) if len(begin) else 0
    out, last = [], -np.inf
    for a, b in zip(begin, end, strict=True):
        if b - a < least:
            continue
        own = x[a:b]
        tops = np.flatnonzero((own[1:-1] > own[:-2]) & (own[1:-1] > own[2:])) + 1
        if not len(tops):
            continue
        rise = [own[k] - max(own[: k + 1].min(), own[k:].min()) for k in tops]
        at = a + int(tops[int(np.argmax(rise))])
        if at - last > 0.3 * fs:
            out.append(at)
            last = at
    return np.array(out, int)


def r_peaks(df: DataFrame, fs: float) -> DataFrame:
    """(session_id, idx) of the R peaks of a cleaned ECG(session_id, idx, value)."""
    return each_session_at(df, partial(r_positions, fs=fs))


def ao_envelope(x: np.ndarray, fs: float) -> np.ndarray:
    """The smoothed squared envelope of the part of an acceleration above 20 Hz."""
    high = zero_phase(x, butterworth(Design("butterworth", order=4, low=20.0, fs=fs)))
    return zero_phase(envelope(high) ** 2, butterworth(Design("butterworth", order=4, high=20.0, fs=fs)))


def scg_envelope(df: DataFrame, fs: float) -> DataFrame:
    """(session_id, idx, value): ao_envelope of each session's norm of acceleration."""
    return each_session(df, partial(ao_envelope, fs=fs))
