"""Queries of feature tables, movement, voice measures and emotions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.operators import catalog as G
from pulseframe.operators import features as X
from pulseframe.operators.signals import logarithm, rounded
from pulseframe.plans.registry import query
from pulseframe.sources.tables import IMU_SQL, SAMPLES_SQL, imu, samples, stored, table

CATALOG = {"value": ("mean", "std", "range", "pct")}
_WIDE = "SELECT user_id, event_type, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std, round(max(value) - min(value), 6) AS value_range, round(count(*) FILTER (value > 0) / count(value), 6) AS value_pct FROM events GROUP BY 1, 2"


@query(_WIDE)
def g7_features_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.wide(table(spark, sf_dir, "events"), ["user_id", "event_type"], CATALOG)
    return out.select("user_id", "event_type", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@query(f"SELECT user_id, event_type, 'value' AS feature, substr(name, 7) AS metric, data FROM (UNPIVOT (SELECT * FROM ({_WIDE})) ON value_mean, value_range, value_pct INTO NAME name VALUE data) UNION ALL SELECT user_id, event_type, 'value', 'std', value_std FROM ({_WIDE})")
def g9_features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.long(g7_features_wide(spark, sf_dir), ["user_id", "event_type"])


@query(f"WITH {SAMPLES_SQL} SELECT session_id, round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 60.0::DOUBLE / nullif(max(idx), 0), 6) AS count FROM s GROUP BY 1")
def g14_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = samples(spark, sf_dir).withColumn("x", (F.col("event_type") == "error").cast("int"))
    return X.per_minute(own, "x").withColumn("count", F.round("count", 6))


@query(f"WITH {SAMPLES_SQL}, g AS (SELECT session_id, idx - lag(idx) OVER (PARTITION BY session_id ORDER BY idx) AS gap FROM s WHERE event_type = 'error') SELECT session_id, round(avg(gap), 6) AS dur_mean, round(stddev_pop(gap), 6) AS dur_std FROM g GROUP BY 1")
def g16_blink_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.gaps(samples(spark, sf_dir), F.col("event_type") == "error")
    return out.select("session_id", F.round("dur_mean", 6).alias("dur_mean"), F.round("dur_std", 6).alias("dur_std"))


@query("""WITH m AS (SELECT l_returnflag, l_linestatus, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS mu FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(any_value(mu), 4) AS wmean, round(sqrt(sum(l_quantity * (l_extendedprice - mu) * (l_extendedprice - mu)) / (sum(l_quantity) - sum(l_quantity * l_quantity) / sum(l_quantity))), 4) AS wstd
FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY 1, 2""")
def g18_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.weighted(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", "l_linestatus", F.round("wmean", 4).alias("wmean"), F.round("wstd", 4).alias("wstd"))


@query("SELECT l_suppkey, round(sum(l_quantity), 4) AS l_quantity_mean, round(sum(l_discount), 4) AS l_discount_mean, round(sum(l_discount) / nullif(sum(l_quantity), 0), 6) AS pause_frac_mean FROM lineitem GROUP BY 1")
def g20_pause_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.pauses(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_quantity", "l_discount"], "l_discount", "l_quantity")
    return out.select("l_suppkey", F.round("l_quantity_mean", 4).alias("l_quantity_mean"), F.round("l_discount_mean", 4).alias("l_discount_mean"), F.round("pause_frac_mean", 6).alias("pause_frac_mean"))


#: The catalog, by rules of its own.
_CATALOG_SQL = """em(e) AS (VALUES ('hap'), ('sad'), ('sur'), ('fea'), ('ang'), ('dis'), ('con')), lv(l) AS (VALUES ('soft'), ('hard')),
au AS (SELECT unnest([1, 2, 4, 5, 6, 7, 9, 10, 12, 14, 15, 17, 20, 23, 25, 26, 45]) AS i), tm AS (SELECT unnest([5, 12, 8, 48, 54, 28, 51, 66, 57]) AS i),
raws(grp, block, subgroup, raw, fs) AS (
  SELECT 'facial', 1, 'facial_landmarks', printf('fac_LMK%02ddisp', i), ['mean', 'std'] FROM range(68) t(i)
  UNION ALL SELECT 'facial', 1, 'action_units', printf('fac_AU%02dint', i), ['mean', 'std'] FROM au
  UNION ALL SELECT 'facial', 1, 'emotional_expressivity', 'fac_' || e || 'int' || l, ['mean', 'std'] FROM em, lv
  UNION ALL SELECT 'facial', 1, 'facial_asymmetry', 'fac_asymmask' || unnest(['mouth', 'eyebrow', 'eye', 'com']), ['mean', 'std']
  UNION ALL SELECT 'facial', 2, 'action_units', printf('fac_AU%02dpres', i), ['pct'] FROM (SELECT i FROM au UNION ALL SELECT 28)
  UNION ALL SELECT 'facial', 2, 'emotional_expressivity', 'fac_' || e || 'pres', ['pct'] FROM em
  UNION ALL SELECT 'facial', 3, CASE p WHEN 'pai' THEN 'pain_expressivity' ELSE 'overall_expressivity' END, 'fac_' || p || 'int' || l, ['mean', 'std', 'pct'] FROM (SELECT unnest(['com', 'comlow', 'comupp', 'pai', 'pos', 'neg']) AS p), lv
  UNION ALL SELECT 'acoustic', 1, CASE f WHEN 'ff' THEN 'fundamental_frequency' WHEN 'int' THEN 'audio_intensity' WHEN 'hnr' THEN 'hnr' ELSE 'formant_frequencies' END, 'aco_' || f, ['mean', 'std', 'range'] FROM (SELECT unnest(['ff', 'fm1', 'fm2', 'fm3', 'fm4', 'int', 'hnr']) AS f)
  UNION ALL SELECT 'acoustic', 2, 'mfcc', 'aco_mfcc' || i, ['mean'] FROM range(1, 13) t(i)
  UNION ALL SELECT 'movement', 1, 'head_movement', 'mov_' || unnest(['headvel', 'hposedist', 'hposepitch', 'hposeyaw', 'hposeroll']), ['mean', 'std']
  UNION ALL SELECT 'movement', 1, 'eye_gaze', 'mov_' || unnest(['lefteyex', 'lefteyey', 'lefteyez', 'righteyex', 'righteyey', 'righteyez', 'leyedisp', 'reyedisp']), ['mean', 'std']
  UNION ALL SELECT 'movement', 2, 'eye_blink', 'mov_eyeblink', ['count', 'dur_mean', 'dur_std']
  UNION ALL SELECT 'acoustic_seg', 1, f, 'aco_' || f, ['mean', 'wmean', 'std', 'wstd'] FROM (SELECT unnest(['jitter', 'shimmer', 'gne']) AS f)
  UNION ALL SELECT 'audio_seg', 1, 'vocal_tremor', 'mov_' || k || 'trem' || f, ['mean', 'wmean'] FROM (SELECT unnest(['freq', 'amp']) AS k), (SELECT unnest(['freq', 'index', 'pindex']) AS f)
  UNION ALL SELECT 'audio_seg', 1, 'voice_prevalence', 'aco_voicepct', ['mean', 'wmean']
  UNION ALL SELECT 'pause', 1, 'pause', 'aco_' || unnest(['pausetime', 'totaltime', 'numpauses', 'pausefrac']), ['mean']
  UNION ALL SELECT 'eyeblink_ear', 1, 'eye_blink', 'mov_blink_ear', ['mean', 'std']
  UNION ALL SELECT 'facial_tremor', 1, 'facial_tremor', 'fac_tremor_median_' || i, ['mean'] FROM tm),
cat AS (SELECT grp, block, raw, f AS function, CASE subgroup WHEN 'facial_tremor' THEN 'mov' ELSE split_part(raw, '_', 1) END AS label, subgroup,
  replace(regexp_replace(raw || '_' || f, '^[a-z]+_|_[a-z]+$', '', 'g'), '_', '') AS feature, split_part(raw || '_' || f, '_', -1) AS metric FROM (SELECT *, unnest(fs) AS f FROM raws))"""


@query("""WITH n AS (SELECT p_partkey, ['fac', 'aco', 'mov'][p_partkey % 3 + 1] AS label, CASE p_partkey % 11 WHEN 0 THEN printf('LMK%02ddisp', p_partkey % 80) WHEN 1 THEN printf('AU%02dint', p_partkey % 50) WHEN 2 THEN 'conintsoft' WHEN 3 THEN 'comlowinthard'
  WHEN 4 THEN 'mfcc' || p_partkey % 15 WHEN 5 THEN 'hnr' WHEN 6 THEN 'hposeyaw' WHEN 7 THEN 'leyedisp' WHEN 8 THEN 'eyeblinkdur' WHEN 9 THEN 'tremormedian' || p_partkey % 60 ELSE 'paiintsoft' END AS feature FROM part)
SELECT p_partkey, label, feature, CASE WHEN label = 'fac' AND regexp_full_match(feature, 'LMK([0-5][0-9]|6[0-7])disp') THEN 'facial_landmarks'
  WHEN label = 'fac' AND regexp_full_match(feature, 'AU(01|02|04|05|06|07|09|10|12|14|15|17|20|23|25|26|45)int') THEN 'action_units' WHEN label = 'fac' AND feature = 'conintsoft' THEN 'emotional_expressivity'
  WHEN label = 'fac' AND feature = 'comlowinthard' THEN 'overall_expressivity' WHEN label = 'fac' AND feature = 'paiintsoft' THEN 'pain_expressivity'
  WHEN label = 'fac' AND regexp_full_match(feature, 'tremormedian(5|12|8|48|54|28|51|66|57)') THEN 'facial_tremor' WHEN label = 'aco' AND feature = 'hnr' THEN 'hnr'
  WHEN label = 'aco' AND regexp_full_match(feature, 'mfcc([1-9]|1[0-2])') THEN 'mfcc' WHEN label = 'mov' AND feature = 'hposeyaw' THEN 'head_movement' WHEN label = 'mov' AND feature = 'leyedisp' THEN 'eye_gaze'
  WHEN label = 'mov' AND feature = 'eyeblinkdur' THEN 'eye_blink' END AS subgroup FROM n""")
def g23_subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 11 == 0, F.format_string("LMK%02ddisp", k % 80)).when(k % 11 == 1, F.format_string("AU%02dint", k % 50)).when(k % 11 == 4, F.concat(F.lit("mfcc"), (k % 15).cast("string")))
    name = name.when(k % 11 == 9, F.concat(F.lit("tremormedian"), (k % 60).cast("string")))
    for rest, feature in ((2, "conintsoft"), (3, "comlowinthard"), (5, "hnr"), (6, "hposeyaw"), (7, "leyedisp"), (8, "eyeblinkdur")):
        name = name.when(k % 11 == rest, feature)
    label = F.get(F.array(*map(F.lit, ("fac", "aco", "mov"))), (k % 3).cast("int"))
    return G.subgroup_of(table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), name.otherwise("paiintsoft").alias("feature")), "label", "feature")


_DERIVED_SQL = f"""WITH {SAMPLES_SQL}, {_CATALOG_SQL},
a AS (SELECT session_id, avg(value) AS fac_LMK00disp_mean, stddev_samp(value) AS fac_LMK00disp_std, count(*) FILTER (event_type = 'click') / count(*) AS fac_happres_pct, avg(ln(value)) AS mov_headvel_mean, stddev_samp(ln(value)) AS mov_headvel_std,
  sum(CASE WHEN event_type = 'error' THEN 60.0::DOUBLE ELSE 0 END) / nullif(max(idx), 0) AS mov_eyeblink_count FROM s GROUP BY 1),
b AS (SELECT session_id, avg(gap) AS mov_eyeblink_dur_mean, stddev_pop(gap) AS mov_eyeblink_dur_std FROM (SELECT session_id, idx - lag(idx) OVER (PARTITION BY session_id ORDER BY idx) AS gap FROM s WHERE event_type = 'error') GROUP BY 1),
l AS (SELECT l_suppkey AS session_id, avg(l_tax) AS aco_jitter_mean, stddev_samp(l_tax) AS aco_jitter_std, sum(l_tax * l_quantity) / sum(l_quantity) AS aco_jitter_wmean, sum(l_quantity) AS w1, sum(l_quantity * l_quantity) AS w2,
  avg(l_discount) AS aco_voicepct_mean, sum(l_discount * l_quantity) / sum(l_quantity) AS aco_voicepct_wmean, sum(l_discount) AS aco_pausetime_mean, sum(l_quantity) AS aco_totaltime_mean, CAST(sum(l_linenumber) AS DOUBLE) AS aco_numpauses_mean,
  sum(l_discount) / nullif(sum(l_quantity), 0) AS aco_pausefrac_mean FROM lineitem GROUP BY 1),
m AS (SELECT l.session_id, sqrt(sum(l_quantity * (l_tax - aco_jitter_wmean) ** 2) / (any_value(w1) - any_value(w2) / any_value(w1))) AS aco_jitter_wstd FROM l JOIN lineitem ON l_suppkey = l.session_id GROUP BY 1),
v AS (SELECT session_id, name, data FROM (UNPIVOT (SELECT * FROM a) ON COLUMNS(* EXCLUDE session_id) INTO NAME name VALUE data) UNION ALL SELECT session_id, name, data FROM (UNPIVOT (SELECT * FROM b) ON COLUMNS(* EXCLUDE session_id) INTO NAME name VALUE data)
  UNION ALL SELECT session_id, name, data FROM (UNPIVOT (SELECT * EXCLUDE (w1, w2) FROM l) ON COLUMNS(* EXCLUDE session_id) INTO NAME name VALUE data) UNION ALL SELECT session_id, 'aco_jitter_wstd', aco_jitter_wstd FROM m)
SELECT k.session_id, label AS "group", subgroup, feature, metric, round(data, 5) AS data FROM (SELECT session_id FROM s UNION SELECT l_suppkey FROM lineitem) k CROSS JOIN cat LEFT JOIN v ON v.session_id = k.session_id AND v.name = raw || '_' || function"""


@query(_DERIVED_SQL)
def g9_derived_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalog for every session, from tables that have a few raw columns of some groups each. Line items add up as they are stored."""
    own = samples(spark, sf_dir).select("session_id", "idx", F.col("value").alias("fac_LMK00disp"), (F.col("event_type") == "click").cast("int").alias("fac_happres"), logarithm(F.col("value")).alias("mov_headvel"), (F.col("event_type") == "error").cast("int").alias("mov_eyeblink"))
    items = stored(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("session_id"), "idx", F.col("l_tax").alias("aco_jitter"), F.col("l_quantity").alias("length"), F.col("l_discount").alias("aco_voicepct"), F.col("l_discount").alias("aco_pausetime"), F.col("l_quantity").alias("aco_totaltime"), F.col("l_linenumber").alias("aco_numpauses")
    )
    out = G.derived({"facial": own, "movement": own, "acoustic_seg": items, "audio_seg": items}, ["session_id"], {"acoustic_seg": "length", "audio_seg": "length"})
    return out.withColumn("data", rounded("data", 5))


@query(f"""WITH {_CATALOG_SQL}, d AS ({_DERIVED_SQL}), n AS (SELECT "group" AS label, feature, metric, count(data) AS sessions FROM d GROUP BY 1, 2, 3)
SELECT grp, CAST(block AS INT) AS block, raw, function, cat.label, subgroup, feature, metric, sessions FROM cat JOIN n USING (label, feature, metric)""")
def g21_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with the number of sessions that have data for each of its columns."""
    return G.filled(g9_derived_catalog(spark, sf_dir))


@query(f"""WITH {_CATALOG_SQL}, d AS ({_DERIVED_SQL}), n AS (SELECT "group" AS label, feature, metric, count(data) AS sessions FROM d GROUP BY 1, 2, 3)
SELECT grp, count(DISTINCT block) AS blocks, count(*) AS columns, count(*) FILTER (sessions > 0) AS filled FROM cat JOIN n USING (label, feature, metric) GROUP BY 1""")
def g22_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of blocks and columns of each group, and of columns with data."""
    return G.structure_of(G.filled(g9_derived_catalog(spark, sf_dir)))


@query(f"WITH {SAMPLES_SQL}, v AS (SELECT session_id, unnest(range(0, CAST(floor(count(*) * 0.5 * 2.0) AS BIGINT))) AS frame FROM s GROUP BY 1) SELECT v.session_id, frame, coalesce((event_type = 'error')::INT, 0) AS blink FROM v LEFT JOIN s ON s.session_id = v.session_id AND s.idx = frame")
def m1_blink_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = samples(spark, sf_dir)
    videos = own.groupBy("session_id").agg((F.count(F.lit(1)) * 0.5).alias("duration"), F.lit(2.0).alias("fps"))
    return X.blink_vector(videos, own.filter("event_type = 'error'").select("session_id", F.col("idx").alias("frame")))


@query(f"""WITH {IMU_SQL}, d AS (SELECT session_id, idx, (acc_x + 1) * (acc_y + 1) AS face, coalesce(sqrt((acc_x - lag(acc_x) OVER w) ** 2 + (acc_y - lag(acc_y) OVER w) ** 2), 0) AS d5,
  coalesce(sqrt((gyr_y - lag(gyr_y) OVER w) ** 2 + (gyr_z - lag(gyr_z) OVER w) ** 2), 0) AS d28 FROM m WINDOW w AS (PARTITION BY session_id ORDER BY idx))
SELECT session_id, round(350000.0 / arg_min(face, idx) * quantile_cont(d5, 0.5) * (1 - corr(d5, d28)), 4) AS tremor_5 FROM d GROUP BY 1""")
def m5_facial_tremor(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = imu(spark, sf_dir)
    marks = own.select(
        "session_id", "idx", F.col("acc_x").alias("l5_x"), F.col("acc_y").alias("l5_y"), F.col("gyr_y").alias("l28_x"), F.col("gyr_z").alias("l28_y"),
        (F.col("acc_x") + 1).alias("l15_x"), F.lit(0.0).alias("l1_x"), (F.col("acc_y") + 1).alias("l8_y"), F.lit(0.0).alias("l27_y"),
    )
    return X.facial_tremor(marks, [5]).withColumn("tremor_5", F.round("tremor_5", 4))


@query("""SELECT event_id, CAST(regexp_extract(regexp_replace(props, '--undefined--', '0', 'g'), '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events""")
def m7_json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json(F.regexp_replace("props", "--undefined--", "0"), "k long")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


_PERTURBED = "SELECT session_id, round(avg(CASE WHEN greatest(b, v) <= {0} * least(b, v) THEN abs(v - b) END) / avg(v), 6) AS perturbation FROM (SELECT session_id, value AS v, lag(value) OVER (PARTITION BY session_id ORDER BY idx) AS b FROM s WHERE value BETWEEN {1} AND {2}) GROUP BY 1"


@query(f"WITH {SAMPLES_SQL} " + _PERTURBED.format(1.3, 1, 200))
def a2_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.perturbation(samples(spark, sf_dir), ["session_id"], "idx", "value", 1.0, 200.0, 1.3).withColumn("perturbation", F.round("perturbation", 6))


@query(f"WITH {SAMPLES_SQL} " + _PERTURBED.format(1.6, 0, 1000000))
def a6_shimmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.perturbation(samples(spark, sf_dir), ["session_id"], "idx", "value", 0.0, 1e6, 1.6).withColumn("perturbation", F.round("perturbation", 6))


@query("SELECT user_id, max(nullif(CASE WHEN event_type = 'view' THEN -200.0 ELSE value END, -200.0))::DOUBLE AS gne FROM events GROUP BY 1")
def a9_noise_excitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = table(spark, sf_dir, "events").withColumn("band", F.when(F.col("event_type") == "view", -200.0).otherwise(F.col("value")))
    return X.noise_excitation(bands, ["user_id"], "band")


@query("SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS emotion FROM (SELECT vec_id, embedding[1:7] AS e FROM embeddings)")
def f5_dominant_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["happy", "surprise", "neutral", "sad", "angry", "disgust", "fear"]
    scores = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[k].alias(n) for k, n in enumerate(names)))
    return scores.select("vec_id", X.dominant(names).alias("emotion"))


@query("SELECT event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id, event_type) AS since_us FROM events")
def f7_relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))
    return events.select("event_id", X.since_start(["user_id", "event_type"], "us").alias("since_us"))


@query(f"WITH {SAMPLES_SQL} SELECT session_id, idx, round(idx / 30.0::DOUBLE, 6) AS time FROM s WHERE idx % 7 = 0")
def f2_sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sampled_frames(samples(spark, sf_dir), 30.0, 4.0).select("session_id", "idx", F.round("time", 6).alias("time"))


@query("""WITH e AS (SELECT vec_id, label, embedding[1:7] AS e FROM embeddings)
SELECT CAST(label AS BIGINT) AS session_id, round(vec_id / 4.0::DOUBLE, 6) AS time, ['happy', 'surprise', 'neutral', 'sad', 'angry', 'disgust', 'fear'][list_position(e, list_max(e))] AS emotion, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS code, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS code_by_name FROM e""")
def f4_scored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a detector with their times, emotions and codes."""
    scores = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("session_id"), F.col("vec_id").alias("idx"), *(F.col("embedding")[k].alias(n) for k, n in enumerate(X.EMOTIONS)), F.col("embedding").alias("box"))
    out = X.scored_frames(scores, 4.0)
    return out.select("session_id", F.round("time", 6).alias("time"), "emotion", "code", X.emotion_code(F.col("emotion")).alias("code_by_name"))
