"""Queries of vocal tremor. The events of a user are frames of pitch; their times, in hours, are those of amplitude points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.operators import speech
from pulseframe.operators import tremor as T
from pulseframe.plans.registry import query
from pulseframe.sources.tables import samples, table

#: A frame lasts 50 ms, so that the sessions of the tables hold several periods.
SETTINGS = T.Settings(step=0.05)
STEP, START = 6.0, 3.0


def pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are unvoiced frames."""
    return samples(spark, sf_dir).select("session_id", "idx", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))


def amplitudes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(points, lengths): events at their hours since 2024-01-01, and sessions that end 12 hours after their last point."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / F.lit(3.6e9)
    points = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), hours.alias("t"), "value")
    return points, points.groupBy("session_id").agg((F.max("t") + 12.0).alias("length"))


@query()
def m8_frequency_tremor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.tremor(pitch(spark, sf_dir), SETTINGS)
    return out.select("session_id", *(F.round(c, 6).alias(c) for c in ("freq", "index", "power")))


@query(f"""WITH p AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9::DOUBLE AS t, value FROM events),
f AS (SELECT session_id, min(t) AS t0, max(t) AS t1, max(t) + 12 AS len FROM p GROUP BY 1),
g AS (SELECT session_id, t0, t1, len, unnest(range(CAST(ceil((t0 - {START}::DOUBLE) / {STEP}::DOUBLE) AS BIGINT), CAST(floor((t1 - {START}::DOUBLE) / {STEP}::DOUBLE) AS BIGINT) + 1)) AS frame FROM f),
c AS (SELECT *, frame * {STEP}::DOUBLE + {START}::DOUBLE - {STEP / 2}::DOUBLE AS tl, frame * {STEP}::DOUBLE + {START}::DOUBLE + {STEP / 2}::DOUBLE AS tu, frame - min(frame) OVER (PARTITION BY session_id) AS k FROM g),
a AS (SELECT c.*, (SELECT max(idx) FROM p WHERE p.session_id = c.session_id AND t <= tl) AS lol, (SELECT max(idx) FROM p WHERE p.session_id = c.session_id AND t <= tu) AS lou FROM c),
i AS (SELECT a.session_id, frame, avg(t) AS tin, sum(value * gap) / sum(gap) AS vin FROM (SELECT a.session_id, a.frame, t, value, CASE WHEN idx = coalesce(lol, -1) + 1 THEN t ELSE t - (SELECT t FROM p q WHERE q.session_id = p.session_id AND q.idx = p.idx - 1) END AS gap
  FROM a JOIN p ON p.session_id = a.session_id AND idx > coalesce(lol, -1) AND idx <= lou) a GROUP BY 1, 2),
b AS (SELECT a.session_id, k, a.frame, tl, tu, tin, vin,
  CASE WHEN lol IS NULL THEN hl.value ELSE ((hl.t - tl) * ll.value + (tl - ll.t) * hl.value) / (hl.t - ll.t) END AS vl,
  CASE WHEN hu.t IS NULL THEN ((len - tu) * lu.value + (tu - lu.t) * hl.value) / (len - lu.t) ELSE ((hu.t - tu) * lu.value + (tu - lu.t) * hu.value) / (hu.t - lu.t) END AS vu
  FROM a LEFT JOIN p ll ON ll.session_id = a.session_id AND ll.idx = lol LEFT JOIN p hl ON hl.session_id = a.session_id AND hl.idx = coalesce(lol, -1) + 1
  LEFT JOIN p lu ON lu.session_id = a.session_id AND lu.idx = lou LEFT JOIN p hu ON hu.session_id = a.session_id AND hu.idx = lou + 1 LEFT JOIN i ON i.session_id = a.session_id AND i.frame = a.frame)
SELECT session_id, k AS idx, round(CASE WHEN tin IS NULL THEN (vl + vu) / 2 ELSE ((tin - tl) * (vl + vin) / 2 + (tu - tin) * (vin + vu) / 2) / {STEP}::DOUBLE END, 6) AS value FROM b""")
def m9_resampled_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, lengths = amplitudes(spark, sf_dir)
    return T.resampled(points, lengths, STEP, START).withColumn("value", F.round("value", 6))


@query()
def m7_tremor_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result lines of both tremors, read back; sessions under 3 seconds have an error instead."""
    frames = pitch(spark, sf_dir)
    loud = T.resampled(*amplitudes(spark, sf_dir), STEP, START)
    lines = T.result_line(T.tremor(frames, SETTINGS), T.tremor(loud, SETTINGS))
    return speech.guarded(speech.durations(frames, 1 / SETTINGS.step), T.parsed_results(lines), 3.0)
