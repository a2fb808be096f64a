"""Queries of the RR-interval operators. An event's value is an interval in ms; a purchase is a peak."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.operators import rr as R
from pulseframe.plans.registry import query
from pulseframe.sources.tables import SAMPLES_SQL, samples

FS = 20.0
_PEAKS = "p AS (SELECT session_id, idx FROM s WHERE event_type = 'purchase')"


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).filter("event_type = 'purchase'").select("session_id", "idx")


@query(f"WITH {SAMPLES_SQL}, {_PEAKS} SELECT session_id, idx, (idx - lag(idx) OVER w) * 50.0::DOUBLE AS rr_ms, (idx - lag(idx) OVER w) / 20.0::DOUBLE AS rr_s FROM p WINDOW w AS (PARTITION BY session_id ORDER BY idx)")
def r8_peaks_to_rr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rr_from_peaks(peaks(spark, sf_dir), FS)


@query(f"WITH {SAMPLES_SQL} SELECT session_id, CAST(trunc(round(sum(value) OVER (PARTITION BY session_id ORDER BY idx), 6)) AS BIGINT) AS peak FROM s")
def r8_rr_to_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.peaks_from_rr(samples(spark, sf_dir).select("session_id", "idx", F.col("value").alias("rr_ms")))


@query(f"WITH {SAMPLES_SQL} SELECT session_id, idx, event_type = 'purchase' AS peak FROM s")
def r8_dense_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_peaks(samples(spark, sf_dir), peaks(spark, sf_dir))


@query(f"""WITH {SAMPLES_SQL}, {_PEAKS}, g AS (SELECT session_id, idx, lag(idx) OVER (PARTITION BY session_id ORDER BY idx) AS before FROM p)
SELECT session_id, idx FROM p UNION SELECT session_id, before + (idx - before) // 2 AS idx FROM g WHERE before IS NOT NULL AND idx - before >= 6""")
def r10_correct_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = peaks(spark, sf_dir)
    wide = R.rr_from_peaks(own, FS).filter("rr_ms >= 300").select("session_id", "idx")
    return R.correct_missed(own, wide)


_F = "(PARTITION BY session_id ORDER BY idx ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING)"
_ARTEFACTS = f"""a AS (SELECT session_id, idx, rr, row_number() OVER w - 1 AS i, count(*) OVER p AS n, rr - lag(rr) OVER w AS diff FROM x
  WINDOW w AS (PARTITION BY session_id ORDER BY idx), p AS (PARTITION BY session_id)),
b AS (SELECT *, coalesce(diff, avg(diff) OVER (PARTITION BY session_id)) AS d FROM a),
c AS (SELECT *, 5.2 * (quantile_cont(abs(d), 0.75) OVER {_F.format(45)} - quantile_cont(abs(d), 0.25) OVER {_F.format(45)}) / 2 AS t1, quantile_cont(rr, 0.5) OVER {_F.format(5)} AS med FROM b),
d AS (SELECT *, CASE WHEN rr - med < 0 THEN 2 * (rr - med) ELSE rr - med END AS m FROM c),
e AS (SELECT *, 5.2 * (quantile_cont(abs(m), 0.75) OVER {_F.format(45)} - quantile_cont(abs(m), 0.25) OVER {_F.format(45)}) / 2 AS t2, quantile_cont(rr, 0.5) OVER (PARTITION BY session_id) AS med_all FROM d),
f AS (SELECT *, d / nullif(t1, 0) AS s11, m / nullif(t2, 0) AS mrr FROM e),
g AS (SELECT *, CASE WHEN i = 0 OR i = n - 1 THEN 0 WHEN s11 >= 0 THEN greatest(lag(s11) OVER w, lead(s11) OVER w) ELSE least(lag(s11) OVER w, lead(s11) OVER w) END AS s12,
  CASE WHEN i >= n - 2 THEN 0 WHEN s11 >= 0 THEN least(lead(s11) OVER w, lead(s11, 2) OVER w) ELSE greatest(lead(s11) OVER w, lead(s11, 2) OVER w) END AS s22, coalesce(lead(rr) OVER w, 0) AS nxt
  FROM f WINDOW w AS (PARTITION BY session_id ORDER BY idx)),
h AS (SELECT *, coalesce((s11 > 1 AND s12 < -0.13 * s11 - 0.17) OR (s11 < -1 AND s12 > -0.13 * s11 + 0.17), false) AND i >= 2 AND i < n - 2 AS ectopic FROM g),
j AS (SELECT *, (coalesce(s11 > 1 AND s22 < -1, false) OR (coalesce(abs(mrr) > 3, false) AND rr > med_all)) AND NOT ectopic AS l0,
  (coalesce(s11 < -1 AND s22 > 1, false) OR (coalesce(abs(mrr) > 3, false) AND rr <= med_all)) AND NOT ectopic AS s0 FROM h),
k AS (SELECT *, l0 AND coalesce(abs(rr / 2 - med) < t2, false) AS missed, s0 AND coalesce(abs(rr + nxt - med) < t2, false) AS extra FROM j)"""


@query(f"""WITH {SAMPLES_SQL}, x AS (SELECT session_id, idx, value AS rr FROM s), {_ARTEFACTS}
SELECT session_id, idx, rr AS rr_ms, round(t1, 6) AS threshold1, round(t2, 6) AS threshold2, ectopic, l0 AND NOT missed AND i > 0 AND i < n - 1 AS "long",
  s0 AND NOT extra AND i > 0 AND i < n - 1 AS short, missed, extra FROM k""")
def r11_rr_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.artefacts(samples(spark, sf_dir).select("session_id", "idx", F.col("value").alias("rr_ms")))
    return out.select("session_id", "idx", "rr_ms", F.round("threshold1", 6).alias("threshold1"), F.round("threshold2", 6).alias("threshold2"), "ectopic", "long", "short", "missed", "extra")


def _classes(stage: str, peaks: str) -> str:
    """CTEs x, a .. k of one stage, with its name in front, over the intervals of peaks(session_id, idx)."""
    rr = f"x AS (SELECT * FROM (SELECT session_id, idx, (idx - lag(idx) OVER (PARTITION BY session_id ORDER BY idx)) * 1000.0::DOUBLE / {FS} AS rr FROM {peaks}) WHERE rr IS NOT NULL), "
    return re.sub(r"\b[a-hjkx](?= AS \(SELECT)|(?<=FROM )[a-hjkx]\b", lambda m: stage + m.group(), rr + _ARTEFACTS)


@query(f"""WITH {SAMPLES_SQL}, {_PEAKS}, {_classes("one_", "p")},
left_ AS MATERIALIZED (SELECT session_id, idx FROM (SELECT p.*, lag(coalesce(extra, false)) OVER (PARTITION BY p.session_id ORDER BY p.idx) AS gone FROM p LEFT JOIN one_k ON one_k.session_id = p.session_id AND one_k.idx = p.idx) WHERE NOT coalesce(gone, false)),
{_classes("two_", "left_")}, b4 AS (SELECT session_id, idx, lag(idx) OVER (PARTITION BY session_id ORDER BY idx) AS before FROM left_)
SELECT session_id, idx FROM left_ UNION SELECT session_id, before + (idx - before) // 2 FROM b4 JOIN two_k USING (session_id, idx) WHERE missed AND before IS NOT NULL""")
def r9_correct_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.correct_peaks(peaks(spark, sf_dir), FS)
