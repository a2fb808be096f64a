"""Peak prominences: the height of a peak above the higher of the two lowest points that separate it from higher samples.

Inside a block of samples, one pass with a stack of falling values finds them. A peak that is the highest of its block towards a side looks
on in the blocks' maxima and minima, of which running extremes make a search, and then in the one block that holds a higher sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.signals import local_maxima

BLOCK = 1 << 14


def lows(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sample the lowest value back to the nearest higher sample, and whether there is none."""
    low, alone = np.empty(len(v)), np.zeros(len(v), bool)
    stack: list[tuple[float, float]] = []
    for i, x in enumerate(v.tolist()):
        least = x
        while stack and stack[-1][0] <= x:
            least = min(least, stack.pop()[1])
        alone[i] = not stack
        stack.append((x, least))
        low[i] = least
    return low, alone


def peaks_of(v: np.ndarray) -> np.ndarray:
    """Positions of strict maxima; a plateau counts once, at its middle rounded down; ends never count."""
    if not len(v):
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    end = np.append(start[1:], len(v)) - 1
    h = v[start]
    top = np.zeros(len(h), bool)
    top[1:-1] = (h[1:-1] > h[:-2]) & (h[1:-1] > h[2:])
    return (start[top] + end[top]) // 2


def peak_prominences(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The peaks of v and their prominences, in linear time."""
    at = peaks_of(v)
    return at, v[at] - np.maximum(lows(v)[0][at], lows(v[::-1])[0][::-1][at])


def _beyond(value: np.ndarray, highs: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the entries, nearest first, come before one with a high above each value, and the least low of those."""
    if not len(highs):
        return np.zeros(len(value), np.int64), np.full(len(value), np.inf)
    passed = np.searchsorted(np.maximum.accumulate(highs), value, side="right")
    return passed, np.concatenate([[np.inf], np.minimum.accumulate(least)])[passed]


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(session_id, idx, value, side, low, target) of every peak and side; target is the block to look on in, null where low is final."""
    for batch in batches:
        for row, session, block in zip(range(batch.num_rows), batch.column("session_id").to_pylist(), batch.column("block").to_pylist(), strict=True):
            own = batch.column("own")[row].values
            idx, v = np.asarray(own.field("idx")), np.asarray(own.field("value"))
            at = np.searchsorted(idx, np.asarray(batch.column("peaks")[row].values))
            seen = batch.column("blocks")[row].values
            number, high, low = (np.asarray(seen.field(c)) for c in ("block", "high", "low"))
            here = int(np.searchsorted(number, block))
            for side, (own_low, alone), near in ((0, lows(v), slice(None, here)), (1, tuple(a[::-1] for a in lows(v[::-1])), slice(here + 1, None))):
                least, target = own_low[at], np.full(len(at), -1)
                out = np.flatnonzero(alone[at])
                turn = -1 if side == 0 else 1
                passed, beyond = _beyond(v[at[out]], high[near][::turn], low[near][::turn])
                least[out] = np.minimum(least[out], beyond)
                left = passed < len(high[near])
                target[out[left]] = number[near][::turn][passed[left]]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(session, pa.int64()), len(at)), pa.array(idx[at]), pa.array(v[at]), pa.repeat(pa.scalar(side, pa.int32()), len(at)), pa.array(least), pa.array(target, mask=target < 0)],
                    names=["session_id", "idx", "value", "side", "low", "target"],
                )


def _in_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(session_id, idx, value, side, low): the peaks that look on in a block, with what lies there in front of its first higher sample."""
    for batch in batches:
        for row, session in enumerate(batch.column("session_id").to_pylist()):
            v = np.asarray(batch.column("own")[row].values.field("value"))
            asked = batch.column("asked")[row].values
            idx, value, side, low = (np.asarray(asked.field(c)) for c in ("idx", "value", "side", "low"))
            for one in (0, 1):
                mine = side == one
                near = v[::-1] if one == 0 else v
                _, beyond = _beyond(value[mine], near, near)
                n = int(mine.sum())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(session, pa.int64()), n), pa.array(idx[mine]), pa.array(value[mine]), pa.repeat(pa.scalar(one, pa.int32()), n), pa.array(np.minimum(low[mine], beyond))], names=["session_id", "idx", "value", "side", "low"])


def prominences(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """(session_id, idx, value, prominence) of the local maxima of df(session_id, idx, value): height above the higher of the minima on both sides up to a higher sample.

    Samples are packed by blocks of positions; beside a block there are only the extremes of its session's other blocks.
    """
    place = F.floor(F.col("idx") / F.lit(block)).alias("block")
    rows = df.select("session_id", "idx", F.col("value").cast("double").alias("value"), place)
    packed = rows.groupBy("session_id", "block").agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("own"))
    extremes = rows.groupBy("session_id", "block").agg(F.max("value").alias("high"), F.min("value").alias("low"))
    blocks = extremes.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("block", "high", "low"))).alias("blocks"))
    peaks = local_maxima(df).select("session_id", "idx", place).groupBy("session_id", "block").agg(F.sort_array(F.collect_list("idx")).alias("peaks"))
    found = packed.join(peaks, ["session_id", "block"]).join(blocks, "session_id").mapInArrow(_in_blocks, "session_id long, idx long, value double, side int, low double, target long")
    final = found.filter("target is null").select("session_id", "idx", "value", "side", "low")
    asked = found.filter("target is not null").groupBy("session_id", F.col("target").alias("block")).agg(F.collect_list(F.struct("idx", "value", "side", "low")).alias("asked"))
    more = packed.join(asked, ["session_id", "block"]).mapInArrow(_in_targets, "session_id long, idx long, value double, side int, low double")
    return final.unionByName(more).groupBy("session_id", "idx", "value").agg(F.max("low").alias("top")).select("session_id", "idx", "value", (F.col("value") - F.col("top")).alias("prominence"))


def _beat_peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(session_id, heartbeat_id, r, offsets, prominences) of each packed beat."""
    for batch in batches:
        offsets, sizes = [], []
        for own, r in zip(batch.column("own"), batch.column("r_peak_sample").to_pylist(), strict=True):
            at, size = peak_prominences(np.asarray(own.values.field("value")))
            offsets.append(np.asarray(own.values.field("idx"))[at] - r)
            sizes.append(size)
        yield pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column("heartbeat_id"), batch.column("r_peak_sample"), pa.array(offsets, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.float64()))], names=["session_id", "heartbeat_id", "r", "offsets", "sizes"])


def chosen_offset(offsets: list[int], sizes: list[float], past: list[int], history: int) -> int | None:
    """The offset of the peaks that reach the highest prominence level, from 1.0 down in steps of 0.1: not before R, and of several the nearest to the mean of the last found ones."""
    levels = [max(k / 10, 1e-16) for k in range(10, -1, -1)]
    level = next((one for one in levels if any(p >= one for p in sizes)), None)
    near = [o for o, p in zip(offsets, sizes, strict=True) if level is not None and p >= level]
    if len(near) > 1:
        near = [o for o in near if o >= 0]
        if near and past:
            mean = sum(past[-history:]) / len(past[-history:])
            near = [min(near, key=lambda o: (abs(o - mean), o))]
    return near[0] if near and near[0] >= 0 else None


def _chosen(batches: Iterator[pa.RecordBatch], history: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for session, beats in zip(batch.column("session_id").to_pylist(), batch.column("beats").to_pylist(), strict=True):
            past: list[int] = []
            points = []
            for beat in beats:
                offset = chosen_offset(beat["offsets"], beat["sizes"], past, history)
                if offset is not None:
                    past.append(offset)
                points.append(None if offset is None else beat["r"] + offset)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(session, pa.int64()), len(beats)), pa.array([b["heartbeat_id"] for b in beats], pa.int64()), pa.array(points, pa.int64())], names=["session_id", "heartbeat_id", "c_point"])


def chosen_by_history(packed: DataFrame, history: int) -> DataFrame:
    """(session_id, heartbeat_id, c_point) of beats packed as (session_id, heartbeat_id, r_peak_sample, own): peaks are found beat by beat, and only they are folded in the order of a session's beats."""
    peaks = packed.mapInArrow(_beat_peaks, "session_id long, heartbeat_id long, r long, offsets array<long>, sizes array<double>")
    listed = peaks.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("heartbeat_id", "r", "offsets", "sizes"))).alias("beats"))
    return listed.mapInArrow(partial(_chosen, history=history), "session_id long, heartbeat_id long, c_point long")
