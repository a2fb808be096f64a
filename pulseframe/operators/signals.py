"""Sampled-signal operators as window expressions over (session, idx). All take frames with session_id, idx and value."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def ordered() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("idx")


def whole() -> WindowSpec:
    return Window.partitionBy("session_id")


def norm(*axes: str) -> Column:
    return F.sqrt(sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0])))


def logarithm(value: Column) -> Column:
    """The natural logarithm, minus infinity for 0; null below."""
    return F.when(value == 0, F.lit(-math.inf)).otherwise(F.log(value))


def rounded(value: str, digits: int) -> Column:
    """The value times a power of ten, rounded half away from zero, over that power: DuckDB's rounding, where Spark's rounds the shortest decimal notation."""
    scale = F.lit(10.0**digits)
    up = F.abs(F.col(value) * scale)
    whole = F.rint(up)
    return F.when(up < 2.0**52, F.signum(value) * (whole + F.when(up - whole == 0.5, 1.0).otherwise(0.0)) / scale).otherwise(F.col(value))


def gradient(value: str, w: WindowSpec | None = None) -> Column:
    """Central differences, one-sided at the ends; null for a single sample."""
    w = w or ordered()
    x, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    return F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)


def local_maxima(df: DataFrame, keys: tuple[str, ...] = ("session_id",), value: str = "value") -> DataFrame:
    """(keys, idx, value) of strict maxima; a plateau counts once, at its middle rounded down; ends never count."""
    w = Window.partitionBy(*keys).orderBy("idx")
    fresh = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    runs = df.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    flat = runs.groupBy(*keys, "run").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.first(value).alias("value"))
    r = Window.partitionBy(*keys).orderBy("run")
    found = flat.withColumn("before", F.lag("value").over(r)).withColumn("after", F.lead("value").over(r)).filter("before < value and after < value")
    return found.select(*keys, F.floor((F.col("lo") + F.col("hi")) / 2).cast("long").alias("idx"), "value")


def wrapped_minima() -> Column:
    """Strict minima, with the ends of the signal as neighbours."""
    x = F.col("value")
    first = F.first("value").over(ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last("value").over(ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (x < F.coalesce(F.lag("value").over(ordered()), last)) & (x < F.coalesce(F.lead("value").over(ordered()), first))


def flat_maxima() -> Column:
    """Non-strict maxima; an end is compared with its one neighbour."""
    x = F.col("value")
    return (x >= F.coalesce(F.lag("value").over(ordered()), x)) & (x >= F.coalesce(F.lead("value").over(ordered()), x))


def crosses_zero(value: str) -> Column:
    """Whether the sign changes between the sample and the next; 0 counts as positive."""
    return F.coalesce((F.col(value) < 0) != (F.lead(value).over(ordered()) < 0), F.lit(False))


def moving_average(n: int = 100) -> Column:
    """Zero-padded mean of n samples, i - n/2 .. i + n/2 - 1 for even n, without renormalisation at the ends."""
    return F.sum("value").over(ordered().rowsBetween(-(n // 2), n - n // 2 - 1)) / n


def unwrapped(phase: str) -> Column:
    """phase with jumps of more than pi taken out."""
    turn = 2 * math.pi
    jump = F.col(phase) - F.lag(phase).over(ordered())
    return F.when(F.abs(jump) == math.pi, 0.0).otherwise(F.coalesce(-turn * F.rint(jump / turn), F.lit(0.0)))


def zscore(value: str = "value") -> Column:
    spread = F.stddev_pop(value).over(whole())
    return F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(whole()), spread), F.lit(0.0))


def interpolated(value: str = "value") -> Column:
    """Nulls filled on the line between their neighbours by position; leading ones stay, trailing ones take the last value."""
    at = F.when(F.col(value).isNotNull(), F.struct(F.col("idx").alias("i"), F.col(value).alias("v")))
    before = F.last(at, True).over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, True).over(ordered().rowsBetween(0, Window.unboundedFollowing))
    between = before.v + (after.v - before.v) * F.try_divide(F.col("idx") - before.i, after.i - before.i)
    return F.when(F.col(value).isNotNull(), F.col(value)).when(after.isNull(), before.v).otherwise(between)


def savgol_weights(window: int = 61, order: int = 3) -> list[float]:
    """Smoothing weights of the centre sample."""
    half = window // 2
    design = np.vander(np.arange(-half, half + 1), order + 1, increasing=True).astype(float)
    return [float(x) for x in np.linalg.pinv(design)[0]]


def savgol_interior(window: int = 61, order: int = 3) -> Column:
    """The smoothed value where a full window fits, else null."""
    half = window // 2
    around = [F.lag("value", -k).over(ordered()) * w for k, w in zip(range(-half, half + 1), savgol_weights(window, order), strict=True)]
    return sum(around[1:], around[0])


def savgol_edges(window: int = 61, order: int = 3) -> np.ndarray:
    """Weights (samples of the first half window, samples of the window) of the polynomial fitted to the first window; mirrored for the last."""
    design = np.vander(np.arange(window), order + 1, increasing=True).astype(float)
    return design[: window // 2] @ np.linalg.pinv(design)


def savgol(df: DataFrame, window: int = 61, order: int = 3) -> DataFrame:
    """(session_id, idx, smooth): a Savitzky-Golay filter whose ends are the polynomials fitted to the first and last window. Sessions shorter than the window give null."""
    half = window // 2
    weights = [(j, [float(w) for w in column]) for j, column in enumerate(savgol_edges(window, order).T)]
    table = df.sparkSession.createDataFrame(weights, "j int, w array<double>")
    placed = df.select("session_id", "idx", "value").withColumn("smooth", savgol_interior(window, order)).withColumn("n", F.count(F.lit(1)).over(whole()))

    def edge(j: Column, at: Column) -> DataFrame:
        own = placed.filter((F.col("n") >= window) & (j < window)).withColumn("j", j.cast("int")).join(F.broadcast(table), "j")  # `window` rows
        spread = own.select("session_id", "n", "value", F.posexplode("w").alias("i", "weight"))
        return spread.groupBy("session_id", at.cast("long").alias("idx")).agg(F.sum(F.col("value") * F.col("weight")).alias("edge"))

    ends = edge(F.col("idx"), F.col("i")).unionByName(edge(F.col("n") - 1 - F.col("idx"), F.col("n") - 1 - F.col("i")))
    short = placed.filter((F.col("idx") >= half) & (F.col("idx") < F.col("n") - half) | (F.col("n") < window)).select("session_id", "idx", "smooth")
    return short.unionByName(ends.withColumnRenamed("edge", "smooth"))


def runs_of(df: DataFrame, flag: Column) -> DataFrame:
    """(session_id, run, first_idx, last_idx, n): runs of consecutive samples with the flag, numbered from 0."""
    hit = df.filter(flag).withColumn("g", F.col("idx") - F.row_number().over(ordered()))
    out = hit.groupBy("session_id", "g").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("n"))
    return out.select("session_id", (F.row_number().over(Window.partitionBy("session_id").orderBy("first_idx")) - 1).cast("long").alias("run"), "first_idx", "last_idx", "n")


def windows_of(df: DataFrame, steps: int, stride: int) -> DataFrame:
    """(session_id, start, values): overlapping windows; the last possible start is left out. Samples are dealt to the windows they lie in, never a session to one row."""
    # a window's next sample goes along, so that the last possible start, which has none, is the one left incomplete
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - steps) / F.lit(stride)) * stride).cast("long")
    last = (F.floor(F.col("idx") / F.lit(stride)) * stride).cast("long")
    dealt = df.filter(first <= last).select("session_id", F.explode(F.sequence(first, last, F.lit(stride).cast("long"))).alias("start"), F.struct("idx", "value").alias("s"))
    packed = dealt.groupBy("session_id", "start").agg(F.array_sort(F.collect_list("s")).alias("own")).filter(F.size("own") == steps + 1)
    return packed.select("session_id", "start", F.transform(F.slice("own", 1, steps), lambda s: s.value).alias("values"))
