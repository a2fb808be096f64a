"""Queries of raw feature extraction. Orders are segments of the events of the user with the same number, so they overlap freely."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.operators import extraction as E
from pulseframe.operators.signals import logarithm, rounded
from pulseframe.operators.tremor import Settings
from pulseframe.plans.registry import query
from pulseframe.sources.tables import SAMPLES_SQL, samples, table

_SEGMENTS_SQL = """g AS (SELECT o_orderkey AS segment_id, o_custkey % 150 AS session_id, o_orderkey % 61 - 3 AS start, o_orderkey % 61 - 3 + o_custkey % 83 AS stop FROM orders)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("o_orderkey") % 61 - 3
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment_id"), (F.col("o_custkey") % 150).alias("session_id"), first.alias("start"), (first + F.col("o_custkey") % 83).alias("stop"))


@query(f"""WITH {SAMPLES_SQL}, {_SEGMENTS_SQL}
SELECT segment_id, g.session_id, start, stop, count(value) AS value_count, round(avg(ln(value)), 6) AS value_mean, round(stddev_samp(ln(value)), 6) AS value_std FROM g LEFT JOIN s ON s.session_id = g.session_id AND idx >= start AND idx < stop GROUP BY ALL""")
def g4_segment_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.segment_moments(samples(spark, sf_dir).withColumn("value", logarithm(F.col("value"))), segments(spark, sf_dir), ["value"])
    return out.withColumn("value_mean", rounded("value_mean", 6)).withColumn("value_std", rounded("value_std", 6))


_RUNS = f"""WITH {SAMPLES_SQL}, h AS (SELECT session_id, idx, value, event_type, idx - row_number() OVER (PARTITION BY session_id ORDER BY idx) AS k FROM s WHERE event_type <> 'error'),
r AS (SELECT session_id, k, min(idx) AS first_idx, max(idx) AS last_idx, row_number() OVER (PARTITION BY session_id ORDER BY min(idx)) - 1 AS run FROM h GROUP BY 1, 2),
f AS (SELECT h.*, run, first_idx, last_idx FROM h JOIN r USING (session_id, k)),
p AS (SELECT *, lag(value) OVER (PARTITION BY session_id, run ORDER BY idx) AS b FROM f WHERE value BETWEEN 1 AND 200), q AS (SELECT *, lag(value) OVER (PARTITION BY session_id, run ORDER BY idx) AS b FROM f WHERE value >= 0),
j AS (SELECT session_id, run, avg(CASE WHEN greatest(b, value) <= 1.3 * least(b, value) THEN abs(value - b) END) / avg(value) AS aco_jitter FROM p GROUP BY 1, 2),
m AS (SELECT session_id, run, avg(CASE WHEN greatest(b, value) <= 1.6 * least(b, value) THEN abs(value - b) END) / avg(value) AS aco_shimmer FROM q GROUP BY 1, 2),
n AS (SELECT session_id, run, max(CASE WHEN event_type <> 'view' THEN value END) AS aco_gne FROM f GROUP BY 1, 2)
SELECT session_id, run, first_idx, last_idx, round(aco_jitter, 6) AS aco_jitter, round(aco_shimmer, 6) AS aco_shimmer, aco_gne FROM r LEFT JOIN j USING (session_id, run) LEFT JOIN m USING (session_id, run) LEFT JOIN n USING (session_id, run)"""


@query(_RUNS)
def g2_acoustic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jitter, shimmer and glottal noise of every voiced run; errors are unvoiced, views have no noise value."""
    own = samples(spark, sf_dir)
    frames = own.select("session_id", "idx", "event_type", F.col("value").alias("period"), F.col("value").alias("amplitude"), F.when(F.col("event_type") == "view", -200.0).otherwise(F.col("value")).alias("gne"))
    jitter, shimmer, noise = E.acoustic(frames, F.col("event_type") != "error", ("period", 1.0, 200.0)).values()
    key = ["session_id", "run", "first_idx", "last_idx"]
    out = noise.join(jitter, key, "left").join(shimmer, key, "left")
    return out.select(*key, F.round("aco_jitter", 6).alias("aco_jitter"), F.round("aco_shimmer", 6).alias("aco_shimmer"), "aco_gne")


@query()
def g5_segmented_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses, voice prevalence and tremor of every segment that lies inside a session; clicks and views are speech."""
    frames = samples(spark, sf_dir).select("session_id", "idx", F.col("event_type").isin("click", "view").alias("speech"), F.when(F.col("event_type") != "error", F.col("value")).alias("pitch"), F.col("value").alias("amplitude"))
    cut = segments(spark, sf_dir).filter("start >= 0")
    tables = E.segmented(frames, cut, 0.05, Settings(step=0.05))
    key = ["segment_id", "start", "stop", "length"]
    named = [t.withColumnRenamed("error", f"{name[3:]}_error") for name, t in tables.items()]
    out = named[0].join(named[1], key).join(named[2], key)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))
