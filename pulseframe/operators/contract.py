"""The contract of point extractions: anything that turns samples and heartbeats into one point a heartbeat."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.cardiac import BEAT


class Extraction(Protocol):
    """samples(session_id, idx, value), heartbeats and the sampling rate in; (session_id, heartbeat_id, one point column) out, lazily."""

    def __call__(self, samples: DataFrame, heartbeats: DataFrame, fs: float) -> DataFrame: ...


def extracted(extractions: Mapping[str, Extraction], samples: DataFrame, heartbeats: DataFrame, fs: float) -> DataFrame:
    """(extraction, session_id, heartbeat_id, point) of all extractions. One whose result is not a point a heartbeat by its columns raises."""
    out = None
    for name, extract in extractions.items():
        found = extract(samples, heartbeats, fs)
        points = [c for c in found.columns if c not in BEAT]
        if len(points) != 1 or not set(BEAT) <= set(found.columns):
            raise ValueError(f"{name} gives {found.columns}, not a heartbeat and a point")
        rows = found.select(F.lit(name).alias("extraction"), *BEAT, F.col(points[0]).cast("double").alias("point"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return heartbeats.select(F.lit("").alias("extraction"), *BEAT, F.lit(None).cast("double").alias("point")).limit(0)
    return out
