"""Feature tables: one aggregate for all features of a catalog, wide and long."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Raw feature -> names of functions.
Catalog = Mapping[str, Sequence[str]]


def _weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


FUNCTIONS = {
    "mean": lambda x: F.avg(x),
    "std": lambda x: F.stddev_samp(x),
    "range": lambda x: F.max(x) - F.min(x),
    "pct": lambda x: F.try_divide(F.count_if(x > 0), F.count(x)),
}


def wide(df: DataFrame, keys: Sequence[str], catalog: Catalog) -> DataFrame:
    """One row for each key with a column feature_function for each entry of the catalog, in one aggregation. Nulls and NaN are left out."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return df.groupBy(*keys).agg(*(FUNCTIONS[f](clean(c)).alias(f"{c}_{f}") for c, fs in catalog.items() for f in fs))


def long(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, feature, metric, data) of a wide table; the metric is the name's last part."""
    values = [c for c in table.columns if c not in keys]
    rows = table.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in values], "name", "data")
    return rows.select(*keys, F.regexp_replace("name", "_[^_]*$", "").alias("feature"), F.substring_index("name", "_", -1).alias("metric"), "data")


def weighted(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """(keys, wmean, wstd): the weighted mean and the standard deviation with reliability weights, in two passes."""
    clean = df.filter(F.col(value).isNotNull() & F.col(weight).isNotNull())
    means = clean.groupBy(*keys).agg(_weighted_mean(F.col(value), F.col(weight)).alias("wmean"))
    joined = clean.join(means, list(keys))
    total, squares = F.sum(weight), F.sum(F.col(weight) * F.col(weight))
    spread = F.try_divide(F.sum(F.col(weight) * (F.col(value) - F.col("wmean")) * (F.col(value) - F.col("wmean"))), total - F.try_divide(squares, total))
    return joined.groupBy(*keys).agg(F.first("wmean").alias("wmean"), F.sqrt(spread).alias("wstd"))


def per_minute(df: DataFrame, value: str, time: str = "idx") -> DataFrame:
    """(session_id, count): the sum of value a minute, by the last time in seconds."""
    return df.groupBy("session_id").agg(F.try_divide(F.sum(value) * 60.0, F.max(time)).alias("count"))


def gaps(df: DataFrame, flag: Column, time: str = "idx") -> DataFrame:
    """(session_id, dur_mean, dur_std): mean and population deviation of the gaps between flagged rows."""
    hit = df.filter(flag).withColumn("gap", F.col(time) - F.lag(time).over(Window.partitionBy("session_id").orderBy(time)))
    return hit.groupBy("session_id").agg(F.avg("gap").alias("dur_mean"), F.stddev_pop("gap").alias("dur_std"))


def pauses(df: DataFrame, keys: Sequence[str], columns: Sequence[str], pause: str, total: str) -> DataFrame:
    """(keys, <column>_mean, pause_frac_mean): sums, in spite of the name, and the share of pauses."""
    return df.groupBy(*keys).agg(*(F.sum(c).alias(f"{c}_mean") for c in columns), F.try_divide(F.sum(pause), F.sum(total)).alias("pause_frac_mean"))




def perturbation(df: DataFrame, keys: Sequence[str], order: str, value: str, low: float, high: float, factor: float) -> DataFrame:
    """(keys, perturbation): mean absolute difference of neighbouring values over the mean value (jitter of periods, shimmer of amplitudes).

    Values outside low..high are left out, and so are pairs that differ by more than the factor.
    """
    own = df.filter(F.col(value).between(low, high))
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    pairs = own.withColumn("before", before).withColumn("close", F.greatest("before", value) <= factor * F.least("before", value))
    return pairs.groupBy(*keys).agg(F.try_divide(F.avg(F.when(F.col("close") & F.col("before").isNotNull(), F.abs(F.col(value) - F.col("before")))), F.avg(value)).alias("perturbation"))


def noise_excitation(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, gne): the largest band value; -200 stands for an undefined one."""
    return df.groupBy(*keys).agg(F.max(F.nullif(F.col(value), F.lit(-200.0))).alias("gne"))


def blink_vector(videos: DataFrame, blinks: DataFrame) -> DataFrame:
    """(session_id, frame, blink 0/1) for every frame of videos(session_id, duration, fps), from blinks(session_id, frame)."""
    n = F.floor(F.col("duration") * F.col("fps"))
    frames = videos.filter(n > 0).select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("frame"))
    return frames.join(blinks.select("session_id", "frame", F.lit(1).alias("blink")).distinct(), ["session_id", "frame"], "left").withColumn("blink", F.coalesce("blink", F.lit(0)))


# The settings of the tremor of the face, and the landmarks that it is taken of.
@dataclass(frozen=True)
class TremorConfig:
    """The reference landmark, the area that faces are scaled to, the pairs of landmarks that give a face's width and height, and the landmarks."""

    reference: int = 28
    area: float = 350000.0
    width: tuple[int, int] = (15, 1)
    height: tuple[int, int] = (8, 27)
    landmarks: tuple[int, ...] = (5, 12, 8, 48, 54, 28, 51, 66, 57)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TremorConfig:
        """The settings of a JSON file of any store that Spark reads; what it does not name keeps its default."""
        text = spark.read.text(path, wholetext=True).first()[0]
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items() if k in cls.__dataclass_fields__}
        return cls(**known)


def configured_tremor(df: DataFrame, config: TremorConfig) -> DataFrame:
    """facial_tremor with the settings of a config."""
    return facial_tremor(df, config.landmarks, config.reference, config.area, config.width, config.height)


def facial_tremor(df: DataFrame, landmarks: Sequence[int], reference: int = 28, area: float = 350000.0, width: tuple[int, int] = (15, 1), height: tuple[int, int] = (8, 27)) -> DataFrame:
    """(session_id, tremor_<n>) of df(session_id, idx, l<n>_x, l<n>_y): median displacement, scaled by the face's size in the first frame, times 1 - correlation with the reference.

    Frames in which all landmarks are 0 are left out; the face is l15_x - l1_x wide and l8_y - l27_y high, or as width and height say. Without a size or a varying displacement the value is null.
    """
    points = [c for c in df.columns if c.startswith("l") and c[-2:] in ("_x", "_y")]
    zero = F.lit(True)
    for c in points:
        zero = zero & (F.col(c) == 0)
    w = Window.partitionBy("session_id").orderBy("idx")
    kept = df.filter(~zero)
    marks = sorted({*landmarks, reference})
    move = {n: F.coalesce(F.hypot(F.col(f"l{n}_x") - F.lag(f"l{n}_x").over(w), F.col(f"l{n}_y") - F.lag(f"l{n}_y").over(w)), F.lit(0.0)) for n in marks}
    moved = kept.select("session_id", "idx", (F.abs(F.col(f"l{width[0]}_x") - F.col(f"l{width[1]}_x")) * F.abs(F.col(f"l{height[0]}_y") - F.col(f"l{height[1]}_y"))).alias("face"), *(c.alias(f"d{n}") for n, c in move.items()))
    scale = F.try_divide(F.lit(area), F.min_by("face", "idx"))
    return moved.groupBy("session_id").agg(*((scale * F.percentile(f"d{n}", F.lit(0.5)) * (1 - F.corr(f"d{n}", f"d{reference}"))).alias(f"tremor_{n}") for n in landmarks))


def dominant(scores: Sequence[str]) -> Column:
    """Position of the largest of the columns, the first on ties; null without any."""
    top = F.greatest(*scores)
    out = F.lit(None).cast("int")
    for k in range(len(scores) - 1, -1, -1):
        out = F.when(F.col(scores[k]) == top, k).otherwise(out)
    return out


#: The emotions in the order of their codes.
EMOTIONS = ("happy", "surprise", "neutral", "sad", "angry", "disgust", "fear")


def emotion_code(name: Column, emotions: Sequence[str] = EMOTIONS) -> Column:
    """The position of an emotion's name in the list; null for any other name."""
    at = F.array_position(F.array(*map(F.lit, emotions)), name)
    return F.when(at > 0, at - 1).cast("int")


def scored_frames(scores: DataFrame, fps_out: float, emotions: Sequence[str] = EMOTIONS) -> DataFrame:
    """(session_id, time, the emotions, emotion, code) of a detector's frames(session_id, idx, emotions, ...): time is idx / fps_out, emotion the name of the largest score; other columns, boxes among them, go."""
    code = dominant(list(emotions))
    return scores.select("session_id", (F.col("idx") / F.lit(fps_out)).alias("time"), *emotions, F.get(F.array(*map(F.lit, emotions)), code).alias("emotion"), code.alias("code"))


def since_start(keys: Sequence[str], time: str) -> Column:
    return F.col(time) - F.first(time).over(Window.partitionBy(*keys).orderBy(time))


def sampled_frames(df: DataFrame, fps: float, fps_out: float) -> DataFrame:
    """Every (fps / fps_out)-th frame; fps_out must not exceed fps."""
    if fps_out > fps:
        raise ValueError("fps_out must not be larger than fps")
    return df.filter(F.col("idx") % int(fps / fps_out) == 0).withColumn("time", F.col("idx") / fps)
