"""Recursive filters, decimation and the Hilbert envelope.

Recursive filters run on blocks of a session in different tasks. A block of samples maps the state of the filter's sections before
it to the state after it by a matrix and an offset, so the blocks' offsets, computed from a zero state, are composed in their order,
a few numbers a block, and every block then runs once more from its true state. The envelope and Fourier resampling need
all samples of a session at once, so there one session must fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.blocks import with_halo


@dataclass(frozen=True)
class Design:
    """kind butterworth (low only: high-pass, high only: low-pass, both: band-pass; order of the prototype), elliptic (band-pass of even order, ripple and depth in dB) or hilbert."""

    kind: str
    order: int = 4
    low: float | None = None
    high: float | None = None
    fs: float = 1000.0
    ripple: float = 1.0
    depth: float = 80.0


def butterworth(d: Design) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of the digital filter by the bilinear transform with prewarped edges."""
    warp = lambda f: 2 * d.fs * math.tan(math.pi * f / d.fs)
    poles = np.exp(1j * math.pi * (2 * np.arange(1, d.order + 1) + d.order - 1) / (2 * d.order))
    if d.low and d.high:
        lo, hi = warp(d.low), warp(d.high)
        half = poles * (hi - lo) / 2
        root = np.sqrt(half * half - lo * hi)
        analog, zeros = np.concatenate([half + root, half - root]), np.concatenate([np.ones(d.order), -np.ones(d.order)])
        probe = 2 * math.atan(math.sqrt(lo * hi) / (2 * d.fs))
    elif d.low:
        analog, zeros, probe = warp(d.low) / poles, np.ones(d.order), math.pi
    else:
        analog, zeros, probe = warp(d.high) * poles, -np.ones(d.order), 0.0
    z = (2 * d.fs + analog) / (2 * d.fs - analog)
    sections = []
    upper = sorted(z[z.imag > 1e-9], key=lambda p: abs(p))
    real = sorted(z[np.abs(z.imag) <= 1e-9].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper]
    pairs += [(-(real[i] + real[i + 1]), real[i] * real[i + 1]) for i in range(0, len(real) - 1, 2)] + ([(-real[-1], 0.0)] if len(real) % 2 else [])
    plus, minus = int((zeros > 0).sum()), int((zeros < 0).sum())
    at = np.exp(-1j * probe * np.arange(3))
    for a1, a2 in pairs:
        order = 2 if a2 or plus + minus > 1 else 1
        own = []
        for _ in range(order):
            take = plus and (not minus or len(own) == 0)
            plus, minus = (plus - 1, minus) if take else (plus, minus - 1)
            own.append(1.0 if take else -1.0)
        b = np.poly(own)
        b = np.concatenate([b, np.zeros(3 - len(b))])
        gain = abs((b @ at) / (np.array([1.0, a1, a2]) @ at))
        sections.append([*(b / gain), a1, a2])
    return np.array(sections)


_BLOCK = 64


def _run(x: list[float], s: tuple[float, ...], z1: float, z2: float) -> tuple[list[float], list[tuple[float, float]]]:
    """Outputs of a section and its states after each sample."""
    b0, b1, b2, a1, a2 = s
    out, states = [], []
    for v in x:
        y = b0 * v + z1
        z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
        out.append(y)
        states.append((z1, z2))
    return out, states


@lru_cache(maxsize=64)
def _block(s: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a block of samples does: outputs by inputs, outputs by the state before, the state after by inputs, and by the state before."""
    pulse = [1.0] + [0.0] * (_BLOCK - 1)
    out, states = _run(pulse, s, 0.0, 0.0)
    free = [_run([0.0] * _BLOCK, s, *z) for z in ((1.0, 0.0), (0.0, 1.0))]
    at = np.arange(_BLOCK)
    forced = np.where(at[:, None] >= at, np.array(out)[np.maximum(at[:, None] - at, 0)], 0.0)
    return forced, np.array([f[0] for f in free]).T, np.array(states[::-1]).T, np.array([f[1][-1] for f in free]).T


def _section(x: np.ndarray, s: np.ndarray, z: tuple[float, float]) -> np.ndarray:
    """A section over x from the state z, block by block: products of matrices, and one small step a block for the state."""
    forced, free, push, carry = _block(tuple(s.tolist()))
    n = -(-len(x) // _BLOCK)
    blocks = np.zeros((n, _BLOCK))
    blocks.ravel()[: len(x)] = x
    pushed, state, states = blocks @ push.T, np.array(z), np.empty((n, 2))
    for k in range(n):
        states[k] = state
        state = carry @ state + pushed[k]
    return (blocks @ forced.T + states @ free.T).ravel()[: len(x)]


def steady(s: np.ndarray) -> tuple[float, float]:
    """State of a section that has seen a constant 1 for ever."""
    b0, b1, b2, a1, a2 = s
    y = (b0 + b1 + b2) / (1 + a1 + a2)
    return (b1 + b2) - (a1 + a2) * y, b2 - a2 * y


def zero_phase(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Forward and backward, with odd extension of both ends and steady initial states."""
    if len(x) < 2:
        return x.copy()
    pad = min(len(x) - 1, 3 * (2 * len(sections) + 1))
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for s in sections:
            z1, z2 = steady(s)
            ext = _section(ext, s, (z1 * ext[0], z2 * ext[0]))
        ext = ext[::-1]
    return ext[pad : len(ext) - pad]


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal of the whole session."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * gain))


def _arcsinh_poles(order: int, ripple: float) -> np.ndarray:
    """Poles of the analog Chebyshev prototype with `ripple` dB in the pass band."""
    mu = math.asinh(1 / math.sqrt(10 ** (ripple / 10) - 1)) / order
    theta = math.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    return -np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)


def chebyshev_lowpass(order: int, ripple: float, high: float, fs: float) -> np.ndarray:
    """Second-order sections of a digital Chebyshev low-pass of even order whose pass band ends at `high`."""
    analog = _arcsinh_poles(order, ripple) * 2 * fs * math.tan(math.pi * high / fs)
    z = (2 * fs + analog) / (2 * fs - analog)
    upper = sorted(z[z.imag > 1e-12], key=abs)
    sections = []
    for k, p in enumerate(upper):
        a1, a2 = -2 * p.real, abs(p) ** 2
        gain = (1 + a1 + a2) / 4 * (10 ** (-ripple / 20) if k == 0 else 1.0)  # an even order starts at the ripple's floor
        sections.append([gain, 2 * gain, gain, a1, a2])
    return np.array(sections)


def antialias(factor: int) -> np.ndarray:
    """A Chebyshev low-pass of order 8 and 0.05 dB ripple at 0.8 of the new Nyquist frequency."""
    return chebyshev_lowpass(8, 0.05, 0.8 / factor, 2.0)


def decimated(x: np.ndarray, factor: int) -> np.ndarray:
    """Every factor-th sample after the anti-aliasing low-pass, forward and backward."""
    return zero_phase(x, antialias(factor))[::factor]


def resampled(x: np.ndarray, n: int) -> np.ndarray:
    """x at n equally spaced points, as a periodic band-limited signal (by the Fourier transform)."""
    if not len(x) or not n:
        return np.zeros(n)
    least, spectrum = min(len(x), n), np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, complex)
    out[: least // 2 + 1] = spectrum[: least // 2 + 1]
    if least % 2 == 0 and len(x) != n:  # the shared highest frequency of an even length is one bin here and two there
        out[least // 2] *= 2 if n < len(x) else 0.5
    return np.fft.irfft(out, n) * (n / len(x))


def spaced_peaks(x: np.ndarray, height: float, distance: float, plateaus: bool = True) -> np.ndarray:
    """Positions of strict local maxima (a plateau's middle, or none) of at least `height`, the highest first, without those nearer than `distance` samples to a higher one; of equal ones the later goes first."""
    change = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    ends = np.append(change[1:], len(x)) - 1
    v = x[change] if len(x) else x
    top = np.zeros(len(change), bool)
    if len(change) > 2:
        top[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    if not plateaus:
        top &= change == ends
    at = ((change + ends) // 2)[top]
    at = at[x[at] >= height]
    keep, gap = np.ones(len(at), bool), math.ceil(distance)
    for k in np.argsort(x[at], kind="stable")[::-1]:
        if keep[k]:
            lo, hi = np.searchsorted(at, at[k] - gap, side="right"), np.searchsorted(at, at[k] + gap, side="left")
            keep[lo:k] = keep[k + 1 : hi] = False
    return at[keep]


def _theta_modulus(q: float) -> float:
    """The elliptic modulus of a nome."""
    m = np.arange(12)
    return 4 * math.sqrt(q) * (float(np.sum(q ** (m * (m + 1)))) / (1 + 2 * float(np.sum(q ** ((m + 1) ** 2))))) ** 2


def _complete(k: float) -> float:
    """The complete elliptic integral of the first kind, by the arithmetic-geometric mean."""
    a, g = 1.0, math.sqrt(1 - k * k)
    while abs(a - g) > 1e-15 * a:
        a, g = (a + g) / 2, math.sqrt(a * g)
    return math.pi / (a + g)


def _cd(u: np.ndarray, k: float) -> np.ndarray:
    """cd(u * K, k) for complex u, by descending Landen steps."""
    steps = []
    while k > 1e-12:
        k = (k / (1 + math.sqrt(1 - k * k))) ** 2
        steps.append(k)
    w = np.cos(u * math.pi / 2)
    for v in reversed(steps):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def elliptic(d: Design) -> np.ndarray:
    """Second-order sections of the digital elliptic band-pass of even order: `ripple` dB inside low..high, `depth` dB far outside."""
    if d.order % 2 or not (d.low and d.high):
        raise ValueError("an elliptic design is a band-pass of even order")
    inner, outer = (math.sqrt(10 ** (db / 10) - 1) for db in (d.ripple, d.depth))
    k1 = inner / outer
    k = _theta_modulus(math.exp(-math.pi * _complete(math.sqrt(1 - k1 * k1)) / _complete(k1) / d.order))
    # where the prototype's poles leave the axis: an incomplete integral of the complementary modulus, smooth on its short range
    x, weight = np.polynomial.legendre.leggauss(128)
    top = math.atan(1 / inner)
    part = top / 2 * float(np.sum(weight / np.sqrt(1 - (1 - k1 * k1) * np.sin(top / 2 * (x + 1)) ** 2)))
    u = (2 * np.arange(1, d.order // 2 + 1) - 1) / d.order
    zeros, poles = 1j / (k * _cd(u, k)), 1j * _cd(u + 1j * part / (d.order * _complete(k1)) * -1, k)
    lo, hi = (2 * d.fs * math.tan(math.pi * f / d.fs) for f in (d.low, d.high))

    def band(roots: np.ndarray) -> list[complex]:
        """Upper half of the digital band-pass roots of conjugate pairs of prototype roots."""
        half = np.concatenate([roots, roots.conj()]) * (hi - lo) / 2
        analog = np.concatenate([half + np.sqrt(half * half - lo * hi), half - np.sqrt(half * half - lo * hi)])
        z = (2 * d.fs + analog) / (2 * d.fs - analog)
        return sorted(z[z.imag > 0], key=lambda r: np.angle(r))

    probe = np.exp(-2j * math.atan(math.sqrt(lo * hi) / (2 * d.fs)) * np.arange(3))
    sections = []
    for zero, pole in zip(band(zeros), band(poles), strict=True):
        b, a = np.array([1, -2 * zero.real, abs(zero) ** 2]), np.array([1, -2 * pole.real, abs(pole) ** 2])
        gain = abs((a @ probe) / (b @ probe)) * (10 ** (-d.ripple / 20) if not sections else 1.0)  # an even order starts at the ripple's floor
        sections.append([*(b * gain), a[1], a[2]])
    return np.array(sections)


def sections_of(d: Design) -> np.ndarray:
    return elliptic(d) if d.kind == "elliptic" else butterworth(d)


def kernel(d: Design) -> Callable[[np.ndarray], np.ndarray]:
    return envelope if d.kind == "hilbert" else partial(zero_phase, sections=sections_of(d))


#: Samples of a block; shorter sessions are one block and are filtered at once.
BLOCK = 1 << 15


def _cascade(x: np.ndarray, sections: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sections over x from a state (two numbers a section), and the state after x."""
    after = np.empty_like(state)
    for k, s in enumerate(sections):
        _, b1, b2, a1, a2 = s
        y = _section(x, s, (state[2 * k], state[2 * k + 1]))
        held = b2 * x[-2] - a2 * y[-2] if len(x) > 1 else state[2 * k + 1]
        after[2 * k], after[2 * k + 1] = b1 * x[-1] - a1 * y[-1] + held, b2 * x[-1] - a2 * y[-1]
        x = y
    return x, after


def _steady_state(first: float, sections: np.ndarray) -> np.ndarray:
    """The state of sections that have seen the value `first` for ever."""
    out = []
    for b0, b1, b2, a1, a2 in sections:
        z1, z2 = steady((b0, b1, b2, a1, a2))
        out += [z1 * first, z2 * first]
        first *= (b0 + b1 + b2) / (1 + a1 + a2)
    return np.array(out)


def _one_step(sections: np.ndarray) -> np.ndarray:
    """The matrix of the states' change by one sample of 0."""
    return np.array([_cascade(np.zeros(1), sections, unit)[1] for unit in np.eye(2 * len(sections))]).T


def _extended(batch: pa.RecordBatch, pad: int, block: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """Of each row of packed blocks: its number in the batch, its samples, with the odd extension where the session begins or ends, and the extension's length."""
    for i, (own, k, n) in enumerate(zip(batch.column("x"), batch.column("block").to_pylist(), batch.column("n").to_pylist(), strict=True)):
        x = np.asarray(own.values.field("value"))
        reach = min(n - 1, pad)
        body = x[min(k * block, pad) :]
        if k == 0:
            body = np.concatenate([2 * x[0] - x[reach:0:-1], body])
        if (k + 1) * block >= n:
            body = np.concatenate([body, 2 * x[-1] - x[-2 : -reach - 2 : -1]])
        yield i, body, reach


def _ends(batches: Iterator[pa.RecordBatch], sections: np.ndarray, pad: int, block: int) -> Iterator[pa.RecordBatch]:
    """(session_id, block, n, length, first, last_state) of extended blocks, from a zero state."""
    for batch in batches:
        found = [(len(x), float(x[0]), _cascade(x, sections, np.zeros(2 * len(sections)))[1]) for _, x, _ in _extended(batch, pad, block)]
        yield _end_rows(batch, found)


def _end_rows(batch: pa.RecordBatch, found: list[tuple[int, float, np.ndarray]]) -> pa.RecordBatch:
    made = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column("block"), *made], names=["session_id", "block", "length", "first", "after"])


def _back_ends(batches: Iterator[pa.RecordBatch], sections: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for own in batch.column("y"):
            y = np.asarray(own.values)[::-1]
            found.append((len(y), float(y[0]), _cascade(y, sections, np.zeros(2 * len(sections)))[1]))
        yield _end_rows(batch, found)


def _states(batches: Iterator[pa.RecordBatch], sections: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(session_id, block, state): the state in front of each block, from the blocks' ends in their order."""
    step = _one_step(sections)
    powers: dict[int, np.ndarray] = {}
    for batch in batches:
        for session, own in zip(batch.column("session_id").to_pylist(), batch.column("own").to_pylist(), strict=True):
            states, state = [], _steady_state(own[0]["first"], sections)
            for end in own:
                states.append(state)
                n = end["length"]
                if n not in powers:
                    powers[n] = np.linalg.matrix_power(step, n)
                state = powers[n] @ state + np.array(end["after"])
            yield pa.RecordBatch.from_arrays([pa.array([session] * len(own), pa.int64()), pa.array([e["block"] for e in own], pa.int64()), pa.array(states, pa.list_(pa.float64()))], names=["session_id", "block", "state"])


def _forward(batches: Iterator[pa.RecordBatch], sections: np.ndarray, pad: int, block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        states = batch.column("state")
        y = [_cascade(x, sections, np.asarray(states[i].values))[0] for i, x, _ in _extended(batch, pad, block)]
        yield pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column("block"), batch.column("n"), pa.array(y, pa.list_(pa.float64()))], names=["session_id", "block", "n", "y"])


def _rows(session: int, first: int, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(session, pa.int64()), len(value)), pa.array(np.arange(first, first + len(value))), pa.array(value)], names=["session_id", "idx", "value"])


def _backward(batches: Iterator[pa.RecordBatch], sections: np.ndarray, pad: int, block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for session, k, n, own, state in zip(*(batch.column(c).to_pylist() for c in ("session_id", "block", "n")), batch.column("y"), batch.column("state"), strict=True):
            y = _cascade(np.asarray(own.values)[::-1], sections, np.asarray(state.values))[0][::-1]
            reach = min(n - 1, pad)
            yield _rows(session, k * block, y[reach if k == 0 else 0 : len(y) - (reach if (k + 1) * block >= n else 0)])


def _at_once(batches: Iterator[pa.RecordBatch], sections: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for session, own in zip(batch.column("session_id").to_pylist(), batch.column("x"), strict=True):
            yield _rows(session, 0, zero_phase(np.asarray(own.values.field("value")), sections))


def zero_phased(df: DataFrame, sections: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(session_id, idx, value) of df(session_id, idx from 0 without gaps, value) filtered forward and backward.

    Sessions of one block are filtered at once; of longer ones, each block is a row of its own in all steps, and only the
    blocks' end states, two numbers a section, meet in one task a session.
    """
    pad = 3 * (2 * len(sections) + 1)
    if block <= pad:
        raise ValueError(f"a block must be longer than {pad} samples")
    dealt = with_halo(df.select("session_id", "idx", F.col("value").cast("double").alias("value")), block, pad, 0)
    packed = dealt.groupBy("session_id", "block").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("x"), F.count_if("own").alias("size"))
    facts = df.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    spread = facts.select("session_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(block)).cast("long"))).alias("block"))
    blocks = packed.filter("size > 0").join(spread, ["session_id", "block"]).select("session_id", "block", "n", "x")
    schema = "session_id long, idx long, value double"
    short = blocks.filter(F.col("n") <= block).mapInArrow(partial(_at_once, sections=sections), schema)
    long = blocks.filter(F.col("n") > block)
    ends = "session_id long, block long, length long, first double, after array<double>"
    held = "session_id long, block long, state array<double>"

    def entered(found: DataFrame, rising: bool) -> DataFrame:
        own = found.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("block", "length", "first", "after")), rising).alias("own"))
        return own.mapInArrow(partial(_states, sections=sections), held)

    first = entered(long.mapInArrow(partial(_ends, sections=sections, pad=pad, block=block), ends), True)
    forth = long.join(first, ["session_id", "block"]).mapInArrow(partial(_forward, sections=sections, pad=pad, block=block), "session_id long, block long, n long, y array<double>")
    forth = forth.repartition("session_id", "block")
    second = entered(forth.mapInArrow(partial(_back_ends, sections=sections), ends), False)
    back = forth.join(second, ["session_id", "block"]).mapInArrow(partial(_backward, sections=sections, pad=pad, block=block), schema)
    return short.unionByName(back)


def filtered(df: DataFrame, design: Design, block: int = BLOCK) -> DataFrame:
    """(session_id, idx, value) with the filtered value; sections are designed once, on the driver."""
    if design.kind != "hilbert":
        return zero_phased(df, sections_of(design), block)
    run = kernel(design)

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        return own.assign(value=run(own["value"].to_numpy(float)))

    return df.select("session_id", "idx", "value").groupBy("session_id").applyInPandas(one, "session_id long, idx long, value double")


def each_session(df: DataFrame, run: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(session_id, idx, value) with the sessions' values run through a function that may change their number."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        out = run(own.sort_values("idx")["value"].to_numpy(float))
        return pd.DataFrame({"session_id": own["session_id"].iloc[0], "idx": np.arange(len(out)), "value": out})

    return df.select("session_id", "idx", "value").groupBy("session_id").applyInPandas(one, "session_id long, idx long, value double")


def decimate(df: DataFrame, factor: int, block: int = BLOCK) -> DataFrame:
    """(session_id, idx, value) of every factor-th sample behind an anti-aliasing filter; idx counts the kept ones."""
    out = zero_phased(df, antialias(factor), block).filter(F.col("idx") % factor == 0)
    return out.withColumn("idx", F.floor(F.col("idx") / F.lit(factor)).cast("long"))


def resample(df: DataFrame, ratio: float) -> DataFrame:
    """(session_id, idx, value) with ratio times as many samples, cut to a whole number, by the Fourier transform."""
    return each_session(df, lambda x: resampled(x, int(len(x) * ratio)))


def each_session_at(df: DataFrame, run: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(session_id, idx) of the positions that a function finds in the sessions' values."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        return own.iloc[run(own["value"].to_numpy(float))][["session_id", "idx"]]

    return df.select("session_id", "idx", "value").groupBy("session_id").applyInPandas(one, "session_id long, idx long")


def peaks(df: DataFrame, height: float, distance: float, plateaus: bool = True) -> DataFrame:
    """(session_id, idx) of the peaks by height and distance."""
    return each_session_at(df, partial(spaced_peaks, height=height, distance=distance, plateaus=plateaus))
