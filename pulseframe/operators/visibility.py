"""C points by natural visibility graphs, one beat at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.cardiac import BEAT, window_rows


def visible_pairs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of all samples that see each other: every sample between lies below the line from one to the other.

    Seen from j, those are the samples whose slope to j is less than that of all samples nearer to j.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    steps = np.arange(1, len(v) + 1)
    for j in range(1, len(v)):
        slope = (v[j] - v[j - 1 :: -1]) / steps[:j] if j > 1 else v[1:2] - v[0]
        nearest = np.minimum.accumulate(slope)
        seen = np.flatnonzero(np.append(True, slope[1:] < nearest[:-1]))
        left.append(j - 1 - seen)
        right.append(np.full(len(seen), j))
    return np.concatenate(left), np.concatenate(right)


def node_weights(v: np.ndarray, sparse: float = 0.55) -> np.ndarray:
    """For each sample the number of walks of h steps that start at it and go down along visible pairs, up to a common factor.

    h is the least number of steps for which at least the share `sparse` of the samples has none, or the greatest for which some sample has one.
    """
    i, j = visible_pairs(v)
    falls = v[i] != v[j]
    high, low = np.where(v[i] > v[j], i, j)[falls], np.where(v[i] > v[j], j, i)[falls]
    w = np.ones(len(v))
    while np.count_nonzero(w) > (1 - sparse) * len(v):
        further = np.bincount(high, weights=w[low], minlength=len(v))
        if not further.any():
            break
        w = further * 2.0**-500 if further.max() > 2.0**500 else further
    return w


def _found(batches: Iterator[pa.RecordBatch], sparse: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = []
        for own in batch.column("own"):
            at = np.asarray(own.values.field("idx"))
            v = np.asarray(own.values.field("value"))
            score = node_weights(v, sparse) * (v - v.min())
            points.append(int(at[score.argmax()]))
        yield pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column("heartbeat_id"), pa.array(points, pa.int64())], names=["session_id", "heartbeat_id", "c_point"])


def c_points_by_visibility(beats: DataFrame, samples: DataFrame, sparse: float = 0.55) -> DataFrame:
    """(beat, c_point): the sample of the beat with the largest product of its node weight and its height above the beat's minimum, the first on ties.

    Beats are packed one by one, a session never. Null samples are left out; a beat without samples has a null point.
    """
    rows = window_rows(beats, samples.select("session_id", "idx", "value").filter(F.col("value").isNotNull()), F.col("start_sample"), F.col("end_sample") - 1)
    packed = rows.groupBy(*BEAT).agg(F.sort_array(F.collect_list(F.struct("idx", F.col("value").cast("double").alias("value")))).alias("own"))
    found = packed.mapInArrow(partial(_found, sparse=sparse), "session_id long, heartbeat_id long, c_point long")
    return beats.select(*BEAT).join(found, list(BEAT), "left")
