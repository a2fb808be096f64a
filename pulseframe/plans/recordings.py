"""Queries of recordings: radar channels, WAV files and their segments. Ten samples of a user's events last a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.operators import radar
from pulseframe.plans.registry import query
from pulseframe.sources import wav, wav_source
from pulseframe.sources.tables import IMU_SQL, SAMPLES_SQL, imu, new_folder, samples

_FS = 10
_PCM_SQL = "greatest(-32768, least(32767, CAST(round(value * 10) AS BIGINT)))"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = samples(spark, sf_dir).select("session_id", "idx", (F.col("value") * 10).alias("value"))
    return wav.encoded(own, 8000).select(F.concat(F.lit("session-"), F.col("session_id").cast("string"), F.lit(".wav")).alias("path"), "content")


@query(f"WITH {SAMPLES_SQL} SELECT 'session-' || session_id || '.wav' AS path, 0 AS channel, idx, round_even(idx / 8000.0::DOUBLE, 10) AS t, {_PCM_SQL} AS value FROM s")
def i1_wav_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions written as WAV files and decoded again, with the time of each sample."""
    return wav.timed(wav.frames(_files(spark, sf_dir))).select("path", F.col("channel").cast("long").alias("channel"), "idx", "t", F.col("value").cast("long").alias("value"))


@query(f"WITH {SAMPLES_SQL} SELECT 'session-' || session_id || '.wav' AS path, 8000 AS fs, 1 AS channels, 2 AS width, count(*) AS n, CAST(NULL AS VARCHAR) AS error FROM s GROUP BY 1")
def i2_wav_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files say of themselves, and whether voice activity models take them."""
    return wav.checked(wav.info(_files(spark, sf_dir)))


_CUTS_SQL = "c AS (SELECT session_id, row_number() OVER w - 1 AS segment, idx / 10.0::DOUBLE AS start, lead(idx) OVER w / 10.0::DOUBLE AS stop FROM s WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY session_id ORDER BY idx))"


@query(f"""WITH {SAMPLES_SQL}, {_CUTS_SQL}, e AS (SELECT session_id, max(idx) + 1 AS n FROM s GROUP BY 1)
SELECT session_id, segment, start, coalesce(stop, n / 10.0::DOUBLE) AS stop, s.idx - CAST(start * 10 AS BIGINT) AS idx, value FROM c JOIN e USING (session_id) JOIN s USING (session_id)
WHERE s.idx >= CAST(start * 10 AS BIGINT) AND s.idx < coalesce(CAST(stop * 10 AS BIGINT), n)""")
def i12_cut_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of segments that last from one purchase to the next; the last has no stop."""
    own = samples(spark, sf_dir)
    w = Window.partitionBy("session_id").orderBy("idx")
    segments = own.filter("event_type = 'purchase'").select("session_id", (F.row_number().over(w) - 1).cast("long").alias("segment"), (F.col("idx") / _FS).alias("start"), (F.lead("idx").over(w) / _FS).alias("stop"))
    return wav.cut(own.select("session_id", "idx", "value"), segments, _FS)


@query(f"""WITH {SAMPLES_SQL}, {_CUTS_SQL}, e AS (SELECT session_id, max(idx) + 1 AS n FROM s GROUP BY 1)
SELECT 'user_' || session_id || '_seg_' || segment || '.wav' AS name, 8000 AS fs, s.idx - CAST(start * 10 AS BIGINT) AS idx, CAST(round(value * 10) AS INTEGER) AS value FROM c JOIN e USING (session_id) JOIN s USING (session_id)
WHERE s.idx >= CAST(start * 10 AS BIGINT) AND s.idx < coalesce(CAST(stop * 10 AS BIGINT), n)""")
def i12_segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written as WAV files in folders of the shared one and read back by byte ranges."""
    own = i12_cut_segments(spark, sf_dir).select("session_id", "segment", "idx", (F.col("value") * 10).alias("value"))
    folder = new_folder(spark, "segments")
    wav_source.write_segments(own, "user", folder, 8000, folders=True)
    found = wav_source.read_wav(spark, folder, 1 << 16)
    return found.select(F.substring_index("path", "/", -1).alias("name"), "fs", "idx", "value")


@query(f"""WITH {SAMPLES_SQL}, n AS (SELECT session_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT session_id, idx FROM s JOIN n USING (session_id) WHERE event_type = 'purchase' AND idx < (n - 1) // 20 * 20),
d AS (SELECT session_id, idx, coalesce((lead(idx) OVER w - idx) / 10.0::DOUBLE, 0) AS step, lead(idx) OVER w IS NULL AS tail FROM p WINDOW w AS (PARTITION BY session_id ORDER BY idx))
SELECT session_id, idx, 1.0::DOUBLE AS quality, 0.0::DOUBLE AS outlier, round(CASE WHEN tail THEN avg(step) OVER (PARTITION BY session_id) ELSE step END, 9) AS rr FROM d""")
def r1_beat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals between the beats of whole windows; purchases are the beats that a model found."""
    found = radar.whole_windows(samples(spark, sf_dir), _FS, 2).filter("event_type = 'purchase'")
    return radar.beat_intervals(found, _FS).withColumn("rr", F.round("rr", 9))


@query()
def r4_radar_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals derived from two channels; recursions over recursions, so no SQL."""
    return radar.prepared(imu(spark, sf_dir).select("session_id", "idx", F.col("acc_x").alias("i"), F.col("acc_y").alias("q")), 200.0)


@query(f"WITH {IMU_SQL} SELECT 'sensor-' || session_id AS path, 100 AS fs, idx, CAST(floor((CAST(floor(acc_x * 100) AS INT) + CAST(floor(acc_y * 100) AS INT)) / 2.0::DOUBLE) AS INT) AS value FROM m")
def i4_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels as one."""
    channels = F.posexplode(F.array(*(F.floor(F.col(c) * 100).cast("int") for c in ("acc_x", "acc_y")))).alias("channel", "value")
    own = imu(spark, sf_dir).select(F.concat(F.lit("sensor-"), F.col("session_id").cast("string")).alias("path"), F.lit(100).alias("fs"), "idx", channels)
    return wav.to_mono(own)
