"""Heartbeats and fiducial points.

Heartbeats are rows (session_id, heartbeat_id, start_sample, end_sample, r_peak_sample, rr_interval_samples) with an exclusive
end; points are null where they are not found. A window of samples is joined by exploding its positions into an equi-join on
(session_id, idx), so no join is a nested loop and windows of one session spread over tasks by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.prominence import chosen_by_history
from pulseframe.operators.signals import gradient, local_maxima, ordered

BEAT = ("session_id", "heartbeat_id")


def heartbeats(peaks: DataFrame, lengths: DataFrame, start_factor: float = 0.35) -> DataFrame:
    """Heartbeats of variable length between peaks(session_id, idx), in signals of lengths(session_id, n) samples.

    A beat starts start_factor of the interval before its R peak (half to even) and ends where the next starts. The first
    beat is dropped if it would start before the signal, the last if it would end at or after its end; ids are consecutive.
    Sessions with one peak have no beats.
    """
    by_r = Window.partitionBy("session_id").orderBy("r")
    r = peaks.join(lengths, "session_id").select("session_id", "n", F.col("idx").alias("r"))
    r = r.withColumn("before", F.lag("r").over(by_r)).withColumn("after", F.lead("r").over(by_r)).filter("before is not null or after is not null")
    back = F.col("r") - F.coalesce("before", F.lit(2) * F.col("r") - F.col("after"))
    raw = F.col("r") - start_factor * back
    r = r.withColumn("raw", raw).withColumn("start", F.rint("raw").cast("long")).withColumn("rr", F.coalesce(F.col("after") - F.col("r"), back).cast("double"))
    r = r.withColumn("end", F.coalesce(F.lead("start").over(by_r), F.rint(F.col("r") + (1 - start_factor) * back).cast("long")))
    r = r.filter(~((F.col("before").isNull() & (F.col("raw") < 0)) | (F.col("after").isNull() & (F.rint(F.col("r") + (1 - start_factor) * back) >= F.col("n")))))
    return r.select("session_id", (F.row_number().over(by_r) - 1).cast("long").alias("heartbeat_id"), F.col("start").alias("start_sample"), F.col("end").alias("end_sample"), F.col("r").alias("r_peak_sample"), F.col("rr").alias("rr_interval_samples"))


def fixed_heartbeats(peaks: DataFrame, before: float = 0.35, after: float = 0.5) -> DataFrame:
    """Heartbeats of one length a session: shares of its mean interval before and after each R peak."""
    gaps = peaks.withColumn("gap", F.col("idx") - F.lag("idx").over(ordered()))
    mean = F.avg("gap").over(Window.partitionBy("session_id"))
    out = gaps.withColumn("mean", mean).filter("mean is not null")
    return out.select("session_id", (F.row_number().over(ordered()) - 1).cast("long").alias("heartbeat_id"), F.rint(F.col("idx") - before * F.col("mean")).cast("long").alias("start_sample"), F.rint(F.col("idx") + after * F.col("mean")).cast("long").alias("end_sample"), F.col("idx").alias("r_peak_sample"))


def bad_borders(beats: DataFrame) -> DataFrame:
    """The heartbeats that do not have start < R peak < end."""
    return beats.filter("not (start_sample < r_peak_sample and r_peak_sample < end_sample)").select(*BEAT)


def window_rows(beats: DataFrame, samples: DataFrame, first: Column, last: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(beat, keep, idx, the samples' columns) for positions first..last, both included."""
    span = beats.filter(first <= last).select(*BEAT, *keep, F.explode(F.sequence(first, last)).alias("idx"))
    return span.join(samples, ["session_id", "idx"])


def _joined(beats: DataFrame, points: DataFrame, name: str) -> DataFrame:
    return beats.select(*BEAT).join(points.select(*BEAT, name), list(BEAT), "left")


def c_points(beats: DataFrame, samples: DataFrame) -> DataFrame:
    """(beat, c_point): the first position of the largest value from the R peak to the beat's end."""
    rows = window_rows(beats, samples, F.col("r_peak_sample"), F.col("end_sample") - 1)
    return _joined(beats, rows.groupBy(*BEAT).agg((-F.max(F.struct("value", -F.col("idx")))["col2"]).alias("c_point")), "c_point")


def c_points_by_prominence(beats: DataFrame, samples: DataFrame, history: int = 3) -> DataFrame:
    """(beat, c_point): of the beat's peaks that reach the highest prominence level from 1.0 down in steps of 0.1, the one whose
    distance from the R peak is nearest to the mean of the last `history` found ones; peaks before R only as a last resort null.

    The choice depends on the beats before, so a session's peaks, not its samples, are one ordered pass.
    """
    rows = window_rows(beats, samples.select("session_id", "idx", "value"), F.col("start_sample"), F.col("end_sample") - 1, ("r_peak_sample",))
    packed = rows.groupBy(*BEAT, "r_peak_sample").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("value").cast("double").alias("value")))).alias("own"))
    return _joined(beats, chosen_by_history(packed, history), "c_point")


def q_peaks(beats: DataFrame, candidates: DataFrame) -> DataFrame:
    """(beat, q_peak): the last candidate(session_id, q) strictly inside a beat, null if it lies after the R peak or there is none."""
    inside = beats.select(*BEAT, "r_peak_sample", F.explode(F.sequence(F.col("start_sample") + 1, F.greatest(F.col("start_sample") + 1, F.col("end_sample") - 1))).alias("q"))
    found = inside.join(candidates.select("session_id", "q"), ["session_id", "q"]).groupBy(*BEAT, "r_peak_sample").agg(F.max("q").alias("q"))
    return _joined(beats, found.withColumn("q_peak", F.when(F.col("q") <= F.col("r_peak_sample"), F.col("q"))), "q_peak")


def q_onsets(beats: DataFrame, fs: float, interval_ms: float = 40) -> DataFrame:
    """(beat, q_onset): a fixed interval before the R peak."""
    return beats.select(*BEAT, (F.col("r_peak_sample") - interval_ms / 1000 * fs).alias("q_onset"))


def b_points_second_derivative(beats: DataFrame, samples: DataFrame, c: DataFrame, correct_outliers: bool = False) -> DataFrame:
    """(beat, b_point): the last local minimum of the signal's second derivative between R and C, both included; without one null, or R."""
    curved = samples.withColumn("d1", gradient("value")).withColumn("down", -gradient("d1")).select("session_id", "idx", "down")
    own = beats.join(c, list(BEAT))
    rows = window_rows(own.filter("c_point is not null"), curved, F.col("r_peak_sample"), F.col("c_point"))
    last = local_maxima(rows, BEAT, "down").groupBy(*BEAT).agg(F.max("idx").alias("b_point"))
    out = own.select(*BEAT, "r_peak_sample", "c_point").join(last, list(BEAT), "left")
    rest = F.when(F.col("c_point").isNotNull(), F.col("r_peak_sample")) if correct_outliers else F.lit(None).cast("long")
    return out.select(*BEAT, F.coalesce("b_point", rest).alias("b_point"))


def b_points_chord(beats: DataFrame, samples: DataFrame, c: DataFrame, fs: float) -> DataFrame:
    """(beat, b_point): where the signal is farthest below the chord from 150 ms before C to C, the first on ties."""
    n = int(0.15 * fs)
    own = beats.join(c, list(BEAT)).filter("c_point is not null").withColumn("a", F.col("c_point") - n)
    at = samples.select("session_id", F.col("idx").alias("at"), F.col("value").alias("level"))
    left = own.join(at, (own.session_id == at.session_id) & (own.a == at["at"])).select(*(own[k] for k in BEAT), "a", "c_point", F.col("level").alias("y0"))
    both = left.join(at, (left.session_id == at.session_id) & (left.c_point == at["at"])).select(*(left[k] for k in BEAT), "a", "c_point", "y0", F.col("level").alias("y1"))
    rows = window_rows(both, samples.select("session_id", "idx", "value"), F.col("a"), F.col("c_point") - 1, ("a", "c_point", "y0", "y1"))
    chord = F.col("y0") + (F.col("y1") - F.col("y0")) / (F.col("c_point") - F.col("a")) * (F.col("idx") - F.col("a"))
    best = rows.withColumn("gap", F.round(chord - F.col("value"), 9)).groupBy(*BEAT).agg((-F.max(F.struct("gap", -F.col("idx")))["col2"]).alias("b_point"))
    return _joined(beats, best, "b_point")


def b_points_third_derivative(beats: DataFrame, samples: DataFrame, c: DataFrame, fs: float, window_ms: float | None = 150) -> DataFrame:
    """(beat, b_point): the first largest third derivative, taken within the beat, in the window_ms before C, or from R to C if window_ms is None."""
    rows = window_rows(beats, samples.select("session_id", "idx", "value"), F.col("start_sample"), F.col("end_sample") - 1)
    w = Window.partitionBy(*BEAT).orderBy("idx")
    d3 = rows.withColumn("d1", gradient("value", w)).withColumn("d2", gradient("d1", w)).withColumn("d3", F.round(gradient("d2", w), 9))
    own = beats.join(c, list(BEAT)).filter("c_point is not null")
    first = F.col("r_peak_sample") if window_ms is None else F.col("c_point") - int(window_ms / 1000 * fs)
    own = own.withColumn("a", first).filter("a >= start_sample").select(*BEAT, "a", "c_point")
    inside = d3.join(own, list(BEAT)).filter("idx >= a and idx < c_point and d3 is not null")
    return _joined(beats, inside.groupBy(*BEAT).agg((-F.max(F.struct("d3", -F.col("idx")))["col2"]).alias("b_point")), "b_point")


def a_points(beats: DataFrame, samples: DataFrame, c: DataFrame) -> DataFrame:
    """(beat, a_point): the smallest wrap-around local minimum of the third of the interval between C points that ends at C; the first beat has none."""
    own = beats.join(c, list(BEAT)).withColumn("last_c", F.lag("c_point").over(Window.partitionBy("session_id").orderBy("heartbeat_id")))
    own = own.filter("c_point is not null and last_c is not null").withColumn("a", F.col("c_point") - F.floor((F.col("c_point") - F.col("last_c")) / 3))
    rows = window_rows(own, samples.select("session_id", "idx", "value"), F.col("a"), F.col("c_point") - 1)
    w = Window.partitionBy(*BEAT).orderBy("idx")
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low = (F.col("value") < F.coalesce(F.lag("value").over(w), F.last("value").over(ends))) & (F.col("value") < F.coalesce(F.lead("value").over(w), F.first("value").over(ends)))
    best = rows.withColumn("low", low).filter("low").groupBy(*BEAT).agg(F.min(F.struct("value", "idx"))["idx"].alias("a_point"))
    return _joined(beats, best, "a_point")


def ao_points(beats: DataFrame, samples: DataFrame, fs: float, window_ms: float = 200) -> DataFrame:
    """(beat, ivc_point, ao_point) in the window after R, cut at the beat's end.

    IVC is the first local minimum below the window's mean by more than half the depth of its lowest value; AO the first local
    maximum after it that rises from it by more than 0.7 of its distance from the mean. The mean adds up in the order of the samples,
    so that values on a threshold fall on the same side in every run.
    """
    n = int(window_ms / 1000 * fs)
    rows = window_rows(beats, samples.select("session_id", "idx", "value"), F.col("r_peak_sample"), F.least(F.col("r_peak_sample") + n, F.col("end_sample")) - 1)
    held = rows.filter("value is not null").groupBy(*BEAT).agg(F.sort_array(F.collect_list(F.struct("idx", F.col("value").cast("double").alias("value")))).alias("own"), F.min("value").alias("low"))
    facts = held.select(*BEAT, "low", (F.aggregate("own", F.lit(0.0), lambda s, x: s + x["value"]) / F.size("own")).alias("mean"))
    lows = local_maxima(rows.withColumn("down", -F.col("value")), BEAT, "down").join(facts, list(BEAT))
    ivc = lows.filter(-F.col("value") < F.col("mean") - 0.5 * F.abs(F.col("low") - F.col("mean"))).groupBy(*BEAT).agg(F.min(F.struct("idx", (-F.col("value")).alias("v"))).alias("ivc"), F.first("mean").alias("mean"))
    highs = local_maxima(rows, BEAT).join(ivc, list(BEAT)).filter((F.col("idx") > F.col("ivc.idx")) & (F.col("value") > F.col("ivc.v") + 0.7 * F.abs(F.col("ivc.v") - F.col("mean"))))
    ao = highs.groupBy(*BEAT).agg(F.min("idx").alias("ao_point"))
    return beats.select(*BEAT).join(ivc.select(*BEAT, F.col("ivc.idx").alias("ivc_point")), list(BEAT), "left").join(ao, list(BEAT), "left")


def outliers(points: DataFrame, value: str = "value") -> DataFrame:
    """points(session_id, idx, value) with outlier: more than 3 median absolute deviations above the median. Low values are none."""
    own = Window.partitionBy("session_id")
    centred = points.withColumn("off", F.col(value) - F.percentile(value, F.lit(0.5)).over(own))
    return centred.withColumn("outlier", F.coalesce(F.col("off") > 3 * F.percentile(F.abs("off"), F.lit(0.5)).over(own), F.lit(False))).drop("off")
