"""Queries of voice activity, pauses and speakers. Clicks, views and purchases are speech frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.operators import speech as P
from pulseframe.plans.registry import query
from pulseframe.sources.tables import SAMPLES_SQL, SEGMENTS_SQL, samples, segments, table

DUR = 0.02
_FLAGS = f"{SAMPLES_SQL}, fl AS (SELECT session_id, idx, event_type IN ('click', 'view', 'purchase') AS speech FROM s)"


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("session_id", "idx", F.col("event_type").isin("click", "view", "purchase").alias("speech"))


def _vad(m: int, x: str) -> str:
    return f"""{x}a AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, CASE WHEN idx >= {m - 1} THEN sum(speech::INT) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW) END AS k FROM fl),
{x}b AS (SELECT *, CASE WHEN k = {m} THEN 1 WHEN k = 0 THEN -1 END AS ev FROM {x}a),
{x}c AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING), -1) AS state FROM {x}b),
{x}d AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY session_id ORDER BY idx), -1) AS was FROM {x}c),
{x}e AS (SELECT *, sum(CASE WHEN state = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) - 1 AS segment FROM {x}d WHERE state <> was),
{x}f AS (SELECT session_id, segment, max(n) AS n, max(CASE WHEN state = 1 THEN idx END) AS i_on, max(CASE WHEN state = -1 THEN idx END) AS i_off FROM {x}e GROUP BY 1, 2),
{x} AS (SELECT session_id, CAST(segment AS BIGINT) AS segment, (i_on - {m} + 1) * 0.02::DOUBLE AS start,
  coalesce(i_off - {m} + 2, CASE WHEN i_on < n - 1 THEN greatest(i_on + 1, n - {m}) ELSE n END) * 0.02::DOUBLE AS stop FROM {x}f)"""


_ROUNDED = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"WITH {_FLAGS}, {_vad(3, 'v')} SELECT session_id, segment, round(start, 6) AS start, round(stop, 6) AS stop FROM v")
def a16_vad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ROUNDED(P.vad_segments(flags(spark, sf_dir), 3, DUR), "start", "stop")


@query(f"WITH {_FLAGS}, {_vad(3, 'v')} SELECT session_id, segment, CAST(round(stop / 0.02) - round(start / 0.02) AS BIGINT) AS n_frames FROM v")
def a17_vad_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.collected(flags(spark, sf_dir), 3, DUR).select("session_id", "segment", F.size("frame_ids").cast("long").alias("n_frames"))


_CUES = """SELECT session_id, round(max(stop) - min(start), 6) AS total, round(sum(stop - start), 6) AS speaking, count(*) - 1 AS n_pauses, round(coalesce(sum(gap), 0), 6) AS pause_time,
  round(coalesce(sum(gap), 0) / nullif(max(stop) - min(start), 0), 6) AS pause_fraction
FROM (SELECT *, lead(start) OVER (PARTITION BY session_id ORDER BY start) - stop AS gap FROM {0}) GROUP BY session_id"""
_CUE_COLUMNS = ("total", "speaking", "pause_time", "pause_fraction")


@query(f"WITH {_FLAGS}, {_vad(3, 'v')} " + _CUES.format("v"))
def a20_timing_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ROUNDED(P.timing_cues(P.vad_segments(flags(spark, sf_dir), 3, DUR)), *_CUE_COLUMNS)


@query(f"WITH {_FLAGS}, {_vad(4, 'l')}, {_vad(2, 'v')}, bo AS (SELECT session_id, min(start) AS lo, max(stop) AS hi FROM l GROUP BY 1), ins AS (SELECT v.* FROM v JOIN bo USING (session_id) WHERE start >= lo AND start <= hi) " + _CUES.format("ins"))
def a21_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ROUNDED(P.silence(flags(spark, sf_dir), DUR, 4, 2), *_CUE_COLUMNS)


@query(f"WITH {SEGMENTS_SQL}, l AS (SELECT session_id, min({{'a': start, 'b': stop}}) AS s FROM seg WHERE stop - start > 3.0 GROUP BY 1) SELECT session_id, round(s.a + 0.5, 6) AS t1, round(s.a + 3.0, 6) AS t2, round(greatest(s.a + 3.0, s.b - 0.5), 6) AS t3 FROM l")
def a19_first_long_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ROUNDED(P.first_long_segment(segments(spark, sf_dir)), "t1", "t2", "t3")


@query(f"WITH {_FLAGS} SELECT session_id, count(*) AS n_frames, count(*) FILTER (speech) AS n_voiced, round(count(*) FILTER (speech) / count(*) * 100, 6) AS voiced_pct FROM fl GROUP BY session_id")
def a13_voiced_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ROUNDED(P.voiced_share(flags(spark, sf_dir)), "voiced_pct")


@query("""SELECT conv_id, turn, i AS frame_idx, i * 320 AS "offset", round(i * 0.02, 6)::DOUBLE AS ts FROM (SELECT conv_id, turn, unnest(range(0, CAST(greatest(0, ceil((n - 320) / 320)) AS BIGINT))) AS i
FROM (SELECT conv_id, turn, length(text) * 10 AS n FROM conversations))""")
def i3_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(P.frames(F.length("text") * 10, 8000, 20)).alias("f"))
    return rows.select("conv_id", "turn", "f.frame_idx", "f.offset", F.round("f.ts", 6).alias("ts"))


_CLEAN = f"{SEGMENTS_SQL}, cl AS (SELECT *, stop - start AS length FROM seg WHERE stop - start >= 0.3), ts AS (SELECT session_id, speaker AS test FROM (SELECT session_id, speaker, round(sum(length), 6) AS t FROM cl GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t DESC, speaker) = 1)"


@query(f"WITH {_CLEAN} SELECT session_id, round(start, 6) AS start, round(stop, 6) AS stop, speaker, round(length, 6) AS length FROM cl")
def d2_clean_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ROUNDED(P.clean_segments(segments(spark, sf_dir)), "start", "stop", "length")


@query(f"WITH {_CLEAN} SELECT session_id, test FROM ts")
def d3_test_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.test_speaker(P.clean_segments(segments(spark, sf_dir)))


_LINE = f"""{_CLEAN}, o AS (SELECT cl.*, test, row_number() OVER (PARTITION BY session_id ORDER BY start, stop, speaker) AS ord FROM cl JOIN ts USING (session_id)),
sp AS (SELECT session_id, speaker, test, ord, unnest(range(CAST(ceil(round(start * 20, 6)) AS BIGINT), CAST(floor(round(stop * 20, 6)) AS BIGINT) + 1)) AS idx FROM o),
cv AS (SELECT session_id, idx, max((speaker = test)::INT) AS t, count(DISTINCT speaker) AS n, arg_max((speaker <> test)::INT, ord) AS p FROM sp GROUP BY 1, 2),
gr AS (SELECT session_id, unnest(range(0, CAST(floor(round(max(stop) * 20, 6)) AS BIGINT) + 1)) AS idx FROM cl GROUP BY session_id),
fl AS (SELECT gr.session_id, gr.idx, CASE WHEN n > 1 THEN 0 ELSE coalesce(t, 0) END AS test, coalesce(p, 0) AS panel FROM gr LEFT JOIN cv ON gr.session_id = cv.session_id AND gr.idx = cv.idx),
st AS (SELECT *, coalesce(abs(test - lag(test) OVER (PARTITION BY session_id ORDER BY idx)), 0) AS step FROM fl),
ru AS (SELECT *, sum(step) OVER (PARTITION BY session_id ORDER BY idx) AS run FROM st),
tl AS (SELECT session_id, idx, test, CASE WHEN max(test) OVER r = 0 AND max(panel) OVER r = 1 THEN 1 ELSE panel END AS panel FROM ru WINDOW r AS (PARTITION BY session_id, run))"""


@query(f"WITH {_LINE} SELECT session_id, idx, test, panel FROM tl")
def d4_speaker_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.speaker_timeline(P.clean_segments(segments(spark, sf_dir)), 20)


_EDGE = """SELECT session_id, CAST(max(CASE WHEN step > 0 THEN idx END) AS DOUBLE) / 20 AS start, CAST(max(CASE WHEN step < 0 THEN idx END) AS DOUBLE) / 20 AS stop
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id, step ORDER BY idx) AS k FROM (SELECT session_id, idx, {0} - lag({0}) OVER (PARTITION BY session_id ORDER BY idx) AS step FROM q) WHERE step <> 0) GROUP BY session_id, k"""


@query(f"""WITH {_LINE}, q AS (SELECT session_id, idx, test, CASE WHEN lag(idx) OVER w IS NULL OR lead(idx) OVER w IS NULL THEN 0 ELSE 1 - panel END AS quiet FROM tl WINDOW w AS (PARTITION BY session_id ORDER BY idx)),
al AS (SELECT e.session_id, start, stop, ts.test AS speaker FROM ({_EDGE.format('test')}) e JOIN ts USING (session_id) UNION ALL SELECT session_id, start, stop, 'PANEL_INV' FROM ({_EDGE.format('quiet')})
  UNION ALL SELECT cl.session_id, start, stop, speaker FROM cl JOIN ts USING (session_id) WHERE speaker <> test)
SELECT session_id, round(start, 6) AS start, round(stop, 6) AS stop, speaker, round(stop - start, 6) AS length FROM al""")
def d9_diarization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ROUNDED(P.diarization(segments(spark, sf_dir), 20), "start", "stop", "length")


@query(f"""WITH {SAMPLES_SQL}, d AS (SELECT session_id, count(*) / 1000.0::DOUBLE AS duration FROM s GROUP BY 1),
v AS (SELECT session_id, count(*) AS n_frames, count(*) FILTER (event_type = 'click') AS n_voiced FROM s WHERE event_type IN ('click', 'view') AND session_id % 9 > 0 GROUP BY 1)
SELECT d.session_id, CASE WHEN duration >= 0.064::DOUBLE THEN n_frames END AS n_frames, CASE WHEN duration >= 0.064::DOUBLE THEN n_voiced END AS n_voiced, CASE WHEN duration >= 0.064::DOUBLE THEN round(n_voiced / n_frames * 100, 6) END AS voiced_pct,
  CASE WHEN duration < 0.064::DOUBLE THEN 'shorter than 0.064 s' WHEN n_frames IS NULL THEN 'no result' END AS error FROM d LEFT JOIN v USING (session_id)""")
def a14_guarded_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voiced shares of every recording, with errors as data."""
    own = samples(spark, sf_dir)
    flags = own.filter(F.col("event_type").isin("click", "view") & (F.col("session_id") % 9 > 0)).withColumn("speech", F.col("event_type") == "click")
    shares = P.voiced_share(flags).withColumn("voiced_pct", F.round("voiced_pct", 6))
    return P.guarded(P.durations(own, 1000.0), shares, 0.064)
