"""Feature tables over event-time windows of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.features import FUNCTIONS, Catalog


def windowed_features(stream: DataFrame, keys: Sequence[str], catalog: Catalog, time: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, stop, keys, <raw>_<function>) of a stream, or of a table, for each window of `width`; rows later than `late` behind the newest are left out.

    The state is one row of partial sums for each open window and key; with the watermark, windows close and leave it.
    """
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(F.window(time, width, slide), *keys).agg(*(FUNCTIONS[f](clean(c)).alias(f"{c}_{f}") for c, fs in catalog.items() for f in fs))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *keys, *(f"{c}_{f}" for c, fs in catalog.items() for f in fs))
