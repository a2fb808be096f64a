"""Tremor of a voice contour: frequency, intensity and power of the slow oscillation of pitch or amplitude.

A contour is a row a frame (session_id, idx, value), idx without gaps, value null where there is none (unvoiced). Windows of a
contour are rows of bounded size, so a long recording spreads over tasks; only the few candidates of its windows meet again, in the search for the best path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.blocks import with_halo


# The analysis settings of the tremor script.
@dataclass(frozen=True)
class Settings:
    """Seconds a frame, lowest and highest tremor frequency, and the thresholds and costs of the frequency search."""

    step: float = 0.015
    low: float = 1.5
    high: float = 15.0
    voicing: float = 0.15
    silence: float = 0.01
    octave: float = 0.01
    jump: float = 0.35
    change: float = 0.14

    @property
    def longest(self) -> int:
        """The longest period in frames; a window correlates as many frames."""
        return int(1 / self.low / self.step)

    @property
    def shortest(self) -> int:
        return max(1, int(np.ceil(1 / self.high / self.step)))


# The keys of the result line, the columns that they become, and their decimals.
RESULTS = (("FTrF", "mov_freqtremfreq", 2), ("ATrF", "mov_amptremfreq", 2), ("FTrI", "mov_freqtremindex", 3), ("ATrI", "mov_amptremindex", 3), ("FTrP", "mov_freqtrempindex", 3), ("ATrP", "mov_amptrempindex", 3))


def relative(contour: DataFrame) -> DataFrame:
    """(session_id, idx, x): the contour without its linear trend, relative to its mean; 0 where it has no value or the session's mean is 0."""
    value = F.col("value").cast("double")
    at = F.when(value.isNotNull(), F.col("idx"))
    facts = contour.groupBy("session_id").agg(F.regr_slope(value, F.col("idx")).alias("slope"), F.avg(at).alias("middle"), F.avg(value).alias("mean"))
    flat = value - F.coalesce("slope", F.lit(0.0)) * (F.col("idx") - F.col("middle")) - F.col("mean")
    return contour.join(facts, "session_id").select("session_id", "idx", F.coalesce(F.try_divide(flat, F.col("mean")), F.lit(0.0)).alias("x"))


def contour_windows(x: DataFrame, longest: int) -> DataFrame:
    """(session_id, k, x): of each stretch of `longest` frames from k * longest on, with half as many frames in front of it and longest + 2 behind.

    Only stretches with all frames behind them are there; the first has none in front.
    """
    before, reach = longest // 2 + 1, 2 * longest + 1
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - reach) / F.lit(longest))).cast("long")
    dealt = x.select("session_id", F.explode(F.sequence(first, F.floor((F.col("idx") + before) / F.lit(longest)).cast("long"))).alias("k"), F.struct("idx", "x").alias("s"))
    packed = dealt.groupBy("session_id", "k").agg(F.sort_array(F.collect_list("s")).alias("own"))
    whole = F.element_at("own", -1)["idx"] == F.col("k") * longest + reach
    return packed.filter(whole).select("session_id", "k", F.transform("own", lambda s: s["x"]).alias("x"))


def correlation(x: np.ndarray, n: int, most: int) -> np.ndarray:
    """The correlation of x[0:n] with x[lag:lag+n] for lags 0..most, over the roots of their energies; 0 without energy."""
    x = x - x.mean()
    shifted = np.lib.stride_tricks.sliding_window_view(x, n)[: most + 1]
    energy = np.sqrt((x[:n] ** 2).sum() * (shifted**2).sum(axis=1))
    return np.divide(shifted @ x[:n], energy, out=np.zeros(len(shifted)), where=energy > 0)


def _candidates(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """(session_id, k, freqs, strengths): no tremor (frequency 0) first, then each peak of the correlation, refined by a parabola."""
    n = s.longest
    for batch in batches:
        freqs, strengths = [], []
        for own, peak in zip(batch.column("x"), batch.column("peak").to_pylist(), strict=True):
            x = np.asarray(own.values)[-(2 * n + 2) :]
            r = correlation(x, n, n + 1)
            level = np.abs(x - x.mean()).max() / peak if peak else 0.0
            f, strength = [0.0], [s.voicing + max(0.0, 2.0 - level * (1.0 + s.voicing) / s.silence)]
            for lag in range(s.shortest, n + 1):
                if r[lag] > 0.5 * s.voicing and r[lag] > r[lag - 1] and r[lag] >= r[lag + 1]:
                    slope, bend = (r[lag + 1] - r[lag - 1]) / 2, 2 * r[lag] - r[lag - 1] - r[lag + 1]
                    top = r[lag] + slope**2 / bend / 2
                    f.append(1 / s.step / (lag + slope / bend))
                    strength.append(1 / top if top > 1 else top)
            freqs.append(f)
            strengths.append(strength)
        yield pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column("k"), pa.array(freqs, pa.list_(pa.float64())), pa.array(strengths, pa.list_(pa.float64()))], names=["session_id", "k", "freqs", "strengths"])


def best_path(freqs: list[list[float]], strengths: list[list[float]], s: Settings) -> list[float]:
    """The frequencies of the path through one candidate a window with the largest strengths less costs: of low frequencies, jumps and changes between tremor and none."""
    share = 0.01 / (s.longest * s.step)
    total, back = None, []
    before = np.zeros(0)
    for f, strength in zip(map(np.array, freqs), map(np.array, strengths), strict=True):
        own = strength - np.where(f > 0, s.octave * np.log2(s.high / np.where(f > 0, f, s.high)), 0.0)
        if total is None:
            total = own
        else:
            both = (before[:, None] > 0) & (f > 0)
            jump = s.jump * np.abs(np.log2(np.where(before > 0, before, 1.0)[:, None] / np.where(f > 0, f, 1.0)))
            cost = share * np.where(both, jump, np.where((before[:, None] > 0) != (f > 0), s.change, 0.0))
            reach = total[:, None] - cost
            back.append(reach.argmax(axis=0))
            total = reach.max(axis=0) + own
        before = f
    if total is None:
        return []
    at = [int(total.argmax())]
    for step in reversed(back):
        at.append(int(step[at[-1]]))
    return [f[i] for f, i in zip(freqs, reversed(at), strict=True)]


def _paths(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for session, own in zip(batch.column("session_id").to_pylist(), batch.column("own").to_pylist(), strict=True):
            f = best_path([w["freqs"] for w in own], [w["strengths"] for w in own], s)
            yield pa.RecordBatch.from_arrays([pa.array([session] * len(f), pa.int64()), pa.array([w["k"] for w in own], pa.int64()), pa.array(f, pa.float64())], names=["session_id", "k", "freq"])


def extrema(x: np.ndarray, first: int, last: int, half: int) -> np.ndarray:
    """Positions in first..last-1 of samples above the one before, not below the one after, and largest within `half` samples."""
    return np.array([i for i in range(max(first, 1), min(last, len(x) - 1)) if x[i - 1] < x[i] >= x[i + 1] and x[i] >= x[max(i - half, 0) : i + half + 1].max()], np.int64)


def _extrema(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """(session_id, highs, high, lows, low): numbers of extrema of each stretch and the sums of their sizes."""
    n = s.longest
    for batch in batches:
        rows = []
        for own, freq in zip(batch.column("x"), batch.column("freq").to_pylist(), strict=True):
            x = np.asarray(own.values)
            first, half = len(x) - (2 * n + 2), max(1, round(1 / freq / s.step / 2))
            high, low = extrema(x, first, first + n, half), extrema(-x, first, first + n, half)
            rows.append((len(high), float(np.abs(x[high]).sum()), len(low), float(np.abs(x[low]).sum())))
        columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch.column("session_id"), *columns], names=["session_id", "highs", "high", "lows", "low"])


def tremor(contour: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(session_id, freq, index, power) of every session: the mean frequency of the windows with tremor, the mean size in percent of the
    contour's maxima and minima, one a period, and index * freq / (freq + 1). Null where there is none; a session shorter than two windows has none.
    """
    x = relative(contour)
    windows = contour_windows(x, s.longest)
    peaks = x.groupBy("session_id").agg((F.max("x") - F.min("x")).alias("peak"))
    scored = windows.join(peaks, "session_id").mapInArrow(partial(_candidates, s=s), "session_id long, k long, freqs array<double>, strengths array<double>")
    packed = scored.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("k", "freqs", "strengths"))).alias("own"))
    path = packed.mapInArrow(partial(_paths, s=s), "session_id long, k long, freq double").filter("freq > 0")
    marked = windows.join(path, ["session_id", "k"]).mapInArrow(partial(_extrema, s=s), "session_id long, highs long, high double, lows long, low double")
    sizes = marked.groupBy("session_id").agg((50 * (F.try_divide(F.sum("high"), F.sum("highs")) + F.try_divide(F.sum("low"), F.sum("lows")))).alias("index"))
    freqs = path.groupBy("session_id").agg(F.avg("freq").alias("freq"))
    out = contour.select("session_id").distinct().join(freqs, "session_id", "left").join(sizes, "session_id", "left")
    return out.select("session_id", "freq", "index", (F.col("index") * F.col("freq") / (F.col("freq") + 1)).alias("power"))


def resampled(points: DataFrame, lengths: DataFrame, step: float, start: float, block: int = 4096) -> DataFrame:
    """(session_id, idx, value): an irregular contour, points(session_id, idx, t, value), as means around start + frame * step, from its first point to its last.

    A frame without points is the mean of the contour at its two borders. Else it is made of two trapezoids that meet at the points'
    mean time, at the mean of their values, each weighted with its distance from the point before it in the frame, the first with
    its time. Beyond the first point the contour keeps its value; behind the last it runs, until the session's end in
    lengths(session_id, length), to the value of the last frame's first point. idx counts frames from 0. Points and frames spread over
    tasks by position; no session is gathered.
    """
    w = Window.partitionBy("session_id", "block").orderBy("idx")
    near = with_halo(points.select("session_id", "idx", "t", "value"), block, 1, 1)
    near = near.withColumn("before", F.lag("t").over(w)).withColumn("after", F.struct(F.lead("t").over(w).alias("t"), F.lead("value").over(w).alias("value"))).filter("own")
    border = lambda t: F.ceil((t - F.lit(start)) / F.lit(step) + 0.5)  # the number of the first frame border at t or later
    placed = near.select("session_id", "idx", "t", "value", "before", "after", border(F.col("t")).alias("first"), (border(F.col("after.t")) - 1).alias("last"))
    # the contour at the borders between a point and the next; the first point also gives the border in front of it
    spans = placed.select("session_id", "t", "value", "after", F.explode(F.when(F.col("after.t").isNotNull() & (F.col("first") <= F.col("last")), F.sequence("first", "last"))).alias("at"))
    time = F.col("at") * step - step / 2 + start
    inner = spans.select("session_id", "at", (((F.col("after.t") - time) * F.col("value") + (time - F.col("t")) * F.col("after.value")) / (F.col("after.t") - F.col("t"))).alias("level"))
    borders = inner.unionByName(placed.filter("idx = 0").select("session_id", (F.col("first") - 1).alias("at"), F.col("value").alias("level")))
    gap = F.when(border(F.col("before")) == F.col("first"), F.col("t") - F.col("before")).otherwise(F.col("t"))
    frames = placed.withColumn("gap", gap).groupBy("session_id", (F.col("first") - 1).alias("frame")).agg(
        F.avg("t").alias("centre"), F.try_divide(F.sum(F.col("value") * F.col("gap")), F.sum("gap")).alias("middle"), F.min_by("value", "t").alias("head"), F.max(F.struct("t", "value")).alias("tail")
    )
    facts = points.groupBy("session_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).join(lengths, "session_id")
    left = borders.select("session_id", F.col("at").alias("frame"), F.col("level").alias("low"))
    right = borders.select("session_id", (F.col("at") - 1).alias("frame"), F.col("level").alias("high"))
    rows = left.join(right, ["session_id", "frame"], "left").join(frames, ["session_id", "frame"], "left").join(facts, "session_id")
    mid = F.col("frame") * step + start
    rows = rows.filter((mid >= F.col("t0")) & (mid <= F.col("t1")))
    tl, tu = mid - step / 2, mid + step / 2
    beyond = ((F.col("length") - tu) * F.col("tail.value") + (tu - F.col("tail.t")) * F.col("head")) / (F.col("length") - F.col("tail.t"))
    rows = rows.withColumn("high", F.coalesce("high", beyond))
    area = ((F.col("centre") - tl) * (F.col("low") + F.col("middle")) / 2 + (tu - F.col("centre")) * (F.col("middle") + F.col("high")) / 2) / step
    value = F.when(F.col("centre").isNull(), (F.col("low") + F.col("high")) / 2).otherwise(area)
    return rows.select("session_id", (F.col("frame") - F.ceil((F.col("t0") - start) / step)).cast("long").alias("idx"), value.alias("value"))


def result_line(pitch: DataFrame, amplitude: DataFrame) -> DataFrame:
    """(session_id, line): the tremor of both contours as a line of JSON, rounded; `--undefined--` where there is none."""
    names = dict(zip(("F", "I", "P"), ("freq", "index", "power"), strict=True))
    both = pitch.alias("F").join(amplitude.alias("A"), "session_id", "full")

    def shown(key: str, digits: int) -> Column:
        return F.concat(F.lit(f'"{key}": '), F.coalesce(F.format_string(f"%.{digits}f", F.col(f"{key[0]}.{names[key[-1]]}")), F.lit("--undefined--")))

    known = lambda key: F.col(f"{key[0]}.{names[key[-1]]}").isNotNull()
    parts = [F.when(known(key), shown(key, digits)).otherwise(F.lit(f'"{key}": --undefined--')) for key, _, digits in RESULTS]
    return both.select("session_id", F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("line"))


def parsed_results(lines: DataFrame) -> DataFrame:
    """(session_id, the six tremor columns) of lines(session_id, line): undefined values are 0; a line that is no JSON gives nulls."""
    schema = ", ".join(f"{key} double" for key, _, _ in RESULTS)
    read = lines.select("session_id", F.from_json(F.regexp_replace("line", "--undefined--", "0"), schema).alias("r"))
    return read.select("session_id", *(F.col("r")[key].alias(name) for key, name, _ in RESULTS))
