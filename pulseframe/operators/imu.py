"""Gravity alignment of inertial sensors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import vectors as V
from pulseframe.operators.signals import norm, ordered

ACC, GYR = ("acc_x", "acc_y", "acc_z"), ("gyr_x", "gyr_y", "gyr_z")
_METRICS = {"maximum": F.max, "mean": F.avg, "variance": F.var_pop, "median": lambda c: F.percentile(c, F.lit(0.5))}


def static_vector(df: DataFrame, window: int, threshold: float, metric: str = "median") -> DataFrame:
    """(session_id, g): the median acceleration of static samples, one row a session that has any.

    A sample is static if a full window of `window` samples that covers it has a metric of the gyroscope's norm of at most the threshold.
    """
    gyro = df.withColumn("rate", norm(*GYR))
    frame = ordered().rowsBetween(-(window - 1), 0)
    calm = gyro.withColumn("calm", (F.count(F.lit(1)).over(frame) == window) & (_METRICS[metric]("rate").over(frame) <= threshold))
    static = calm.withColumn("static", F.max("calm").over(ordered().rowsBetween(0, window - 1))).filter("static")
    return static.groupBy("session_id").agg(F.array(*(F.percentile(a, F.lit(0.5)) for a in ACC)).alias("g"))


def rotate(df: DataFrame, rotations: DataFrame) -> DataFrame:
    """df with both sensors turned by the matrix of rotations(session_id, matrix), a row for each session; without one, unchanged."""
    joined = df.join(rotations, "session_id", "left")
    for axes in (ACC, GYR):
        joined = joined.withColumn("turned", F.coalesce(V.applied(F.col("matrix"), F.array(*axes)), F.array(*axes)))
        joined = joined.withColumns({a: F.col("turned")[k] for k, a in enumerate(axes)})
    return joined.drop("turned", "matrix")


def align_to_gravity(df: DataFrame, fs: float, window_s: float = 0.7, threshold: float = 2.5, metric: str = "median") -> DataFrame:
    """df rotated so that each session's static acceleration points along z. Sessions without a static window stay as they are."""
    g = static_vector(df, round(window_s * fs), threshold, metric)
    return rotate(df, g.select("session_id", V.gravity_rotation(F.col("g")).alias("matrix")))


