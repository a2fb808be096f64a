"""B points from the steepest rise between A and C: windows over the samples between the two points, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.cardiac import BEAT, a_points, window_rows
from pulseframe.operators.signals import gradient

#: A third of the rise is searched; slopes count below 10 and jerks from 4 of the height between A and C a second.
_REST, _SLOPE, _JERK = 2 / 3, 10, 4


def _whole(x: Column) -> Column:
    """Cut towards zero."""
    return x.cast("long")


def rises(rows: DataFrame) -> DataFrame:
    """(beat, failed, rise_start, rise_end) of rows(beat, idx, a_point, c_point, value, d2, top) between A and C.

    Borders are A (a start), C (an end) and the sign changes of d2 before the last two samples. A start above half of `top`, the
    value at C, goes with the border after it; then an end below two thirds of it goes with the border before it, and where
    that one is gone already the beat has failed. Of more than two borders left, the rise is between the two neighbours with the largest
    difference, the first on ties; otherwise between the first and the last. A beat that has none left and has not failed is not returned.
    """
    w = Window.partitionBy(*BEAT).orderBy("idx")
    after = F.lead("d2").over(w)
    inner = F.col("idx") <= F.col("c_point") - 2
    start = F.when(F.col("idx") == F.col("c_point"), False).when(F.col("idx") == F.col("a_point"), True).when(inner & (F.col("d2") < 0) & (after >= 0), True).when(inner & (F.col("d2") >= 0) & (after < 0), False)
    edges = rows.withColumn("start", start).filter("start is not null")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False))
    edges = edges.withColumn("high", F.col("start") & (F.col("value") > _whole(F.col("top") / 2)))
    edges = edges.withColumn("left", ~F.col("high") & ~before("high"))
    edges = edges.withColumn("low", F.col("left") & ~F.col("start") & (F.col("value") < _whole(2 * F.col("top") / 3)))
    edges = edges.withColumn("bad", F.col("low") & ~before("left")).withColumn("failed", F.max("bad").over(Window.partitionBy(*BEAT)))
    kept = edges.withColumn("kept", F.col("left") & ~F.col("low") & ~F.coalesce(F.lead("low").over(w), F.lit(False))).filter("kept or failed")
    k = Window.partitionBy(*BEAT, "kept").orderBy("idx")
    steps = kept.withColumn("jump", F.when(F.col("kept"), F.col("value") - F.lag("value").over(k))).withColumn("from", F.lag("idx").over(k))
    best = F.max(F.when(F.col("jump").isNotNull(), F.struct("jump", (-F.col("idx")).alias("at"), "from")))
    found = steps.groupBy(*BEAT).agg(F.max("failed").alias("failed"), F.count_if("kept").alias("n"), F.min(F.when(F.col("kept"), F.col("idx"))).alias("lo"), F.max(F.when(F.col("kept"), F.col("idx"))).alias("hi"), best.alias("best"))
    many = F.col("n") > 2
    return found.select(*BEAT, "failed", F.when(many, F.col("best.from")).otherwise(F.col("lo")).alias("rise_start"), F.when(many, -F.col("best.at")).otherwise(F.col("hi")).alias("rise_end"))


def b_points_monotone(beats: DataFrame, samples: DataFrame, c: DataFrame, fs: float, correct_outliers: bool = False) -> DataFrame:
    """(beat, b_point): in the first third of the rise between A and C, the last significant sign change of the third derivative or
    significant maximum of it; without either, where the rise starts.

    A sign change counts where 0 <= d2 < 10 * height / fs, a maximum (also at an end, also flat) where d3 >= 4 * height / fs, height being
    the value at C above that at A. A beat without an A point (the first of a session, or one beside a missing C) has no B
    point; one without a rise has none, or R if correct_outliers.
    """
    curved = samples.withColumn("d2", gradient("value")).withColumn("d3", gradient("d2")).select("session_id", "idx", "value", "d2", "d3")
    own = beats.select(*BEAT, "r_peak_sample").join(c.select(*BEAT, "c_point"), list(BEAT)).join(a_points(beats, samples, c), list(BEAT)).filter("a_point is not null")
    both = Window.partitionBy(*BEAT)
    rows = window_rows(own, curved, F.col("a_point"), F.col("c_point"), ("a_point", "c_point"))
    rows = rows.withColumn("top", F.max_by("value", "idx").over(both)).withColumn("height", F.col("top") - F.min_by("value", "idx").over(both))
    rise = rises(rows)
    third = F.col("rise_end") - _whole(F.lit(_REST) * (F.col("rise_end") - F.col("rise_start")))
    inside = rows.join(rise.withColumn("until", third), list(BEAT)).filter("idx >= rise_start and idx < until")
    w = Window.partitionBy(*BEAT).orderBy("idx")
    d3, later, earlier = F.col("d3"), F.lead("d3").over(w), F.lag("d3").over(w)
    cross = F.coalesce((d3 < 0) != (later < 0), F.lit(False)) & (F.col("d2") >= 0) & (F.col("d2") < _SLOPE * F.col("height") / fs)
    peak = (d3 >= F.coalesce(earlier, d3)) & (d3 >= F.coalesce(later, d3)) & (d3 >= _JERK * F.col("height") / fs)
    last = inside.withColumn("hit", cross | peak).filter("hit").groupBy(*BEAT).agg(F.max("idx").alias("hit"))
    out = beats.select(*BEAT, "r_peak_sample").join(own.select(*BEAT, "a_point"), list(BEAT), "left").join(rise, list(BEAT), "left").join(last, list(BEAT), "left")
    none = F.col("rise_start").isNull() | ((F.col("rise_start") == F.col("a_point")) & (F.col("rise_end") == F.col("a_point")))
    rest = F.col("r_peak_sample") if correct_outliers else F.lit(None).cast("long")
    b = F.when(F.col("a_point").isNull() | F.coalesce("failed", F.lit(False)), None).when(none, rest).otherwise(F.coalesce("hit", "rise_start"))
    return out.select(*BEAT, b.alias("b_point"))
