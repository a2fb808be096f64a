"""Queries of heartbeats and fiducial points. Purchases are R peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.operators import cardiac as C
from pulseframe.operators import autoregression, contract, correction, ecg, monotone, visibility, wavelets
from pulseframe.operators.filters import Design
from pulseframe.operators.speech import diagnostics
from pulseframe.plans.filter_sql import zero_phase_ctes
from pulseframe.plans.registry import ORACLE_SQL, query
from pulseframe.sources.tables import SAMPLES_SQL, samples

FS = 20.0
_BASE = Design("butterworth", order=4, high=0.1, fs=1.0)
_BEATS_SQL = f"""{SAMPLES_SQL}, nn AS (SELECT session_id, count(*) AS n FROM s GROUP BY 1), p0 AS (SELECT session_id, idx AS r FROM s WHERE event_type = 'purchase'),
p1 AS (SELECT p0.*, n, lag(r) OVER w AS bf, lead(r) OVER w AS af FROM p0 JOIN nn USING (session_id) WINDOW w AS (PARTITION BY session_id ORDER BY r)),
p2 AS (SELECT *, r - coalesce(bf, 2 * r - af) AS back FROM p1 WHERE bf IS NOT NULL OR af IS NOT NULL),
p3 AS (SELECT *, r - 0.35::DOUBLE * back AS raw, CAST(round_even(r + 0.65::DOUBLE * back, 0) AS BIGINT) AS fin, CAST(coalesce(af - r, back) AS DOUBLE) AS rr FROM p2),
p4 AS (SELECT *, CAST(round_even(raw, 0) AS BIGINT) AS st FROM p3), p5 AS (SELECT *, coalesce(lead(st) OVER (PARTITION BY session_id ORDER BY r), fin) AS en FROM p4),
hb AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY r) - 1 AS heartbeat_id, st AS start_sample, en AS end_sample, r AS r_peak_sample, rr AS rr_interval_samples
  FROM p5 WHERE NOT ((bf IS NULL AND raw < 0) OR (af IS NULL AND fin >= n)))"""
_C_SQL = f"""{_BEATS_SQL}, cp AS (SELECT session_id, heartbeat_id, hb.start_sample, hb.end_sample, hb.r_peak_sample, (SELECT idx FROM s WHERE s.session_id = hb.session_id AND idx >= r_peak_sample AND idx < end_sample ORDER BY value DESC, idx LIMIT 1) AS c_point FROM hb)"""
_G = "CASE WHEN lag({0}) OVER w IS NULL THEN lead({0}) OVER w - {0} WHEN lead({0}) OVER w IS NULL THEN {0} - lag({0}) OVER w ELSE (lead({0}) OVER w - lag({0}) OVER w) / 2 END"
_PW = "WINDOW w AS (PARTITION BY session_id ORDER BY idx)"
_BW = "WINDOW w AS (PARTITION BY session_id, heartbeat_id ORDER BY idx)"


def beats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = samples(spark, sf_dir)
    lengths = own.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return C.heartbeats(own.filter("event_type = 'purchase'").select("session_id", "idx"), lengths), own.select("session_id", "idx", "value")


@query(f"WITH {_BEATS_SQL} SELECT * FROM hb")
def p2_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beats(spark, sf_dir)[0]


@query(f"""WITH {SAMPLES_SQL}, g AS (SELECT session_id, idx, idx - lag(idx) OVER w AS gap FROM s WHERE event_type = 'purchase' {_PW}), h AS (SELECT *, avg(gap) OVER (PARTITION BY session_id) AS mean FROM g)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS heartbeat_id, CAST(round_even(idx - 0.35::DOUBLE * mean, 0) AS BIGINT) AS start_sample, CAST(round_even(idx + 0.5::DOUBLE * mean, 0) AS BIGINT) AS end_sample, idx AS r_peak_sample FROM h WHERE mean IS NOT NULL""")
def p3_fixed_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fixed_heartbeats(samples(spark, sf_dir).filter("event_type = 'purchase'").select("session_id", "idx"))


@query(f"WITH {_BEATS_SQL} SELECT session_id, heartbeat_id FROM hb WHERE NOT (start_sample < r_peak_sample AND r_peak_sample < end_sample)")
def p4_bad_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bad_borders(beats(spark, sf_dir)[0])


@query(f"""WITH {_BEATS_SQL}, f AS (SELECT hb.session_id, heartbeat_id, r_peak_sample, max(idx) AS q FROM hb LEFT JOIN s ON s.session_id = hb.session_id AND event_type = 'error' AND idx > start_sample AND idx < end_sample GROUP BY 1, 2, 3)
SELECT session_id, heartbeat_id, CASE WHEN q <= r_peak_sample THEN q END AS q_peak FROM f""")
def p6_q_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = samples(spark, sf_dir).filter("event_type = 'error'").select("session_id", F.col("idx").alias("q"))
    return C.q_peaks(beats(spark, sf_dir)[0], candidates)


@query(f"WITH {_BEATS_SQL} SELECT session_id, heartbeat_id, r_peak_sample - 0.8::DOUBLE AS q_onset FROM hb")
def p7_q_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.q_onsets(beats(spark, sf_dir)[0], FS)


@query(f"WITH {_BEATS_SQL} SELECT session_id, heartbeat_id, r_peak_sample AS r_peak FROM hb")
def p8_r_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beats(spark, sf_dir)[0].select(*C.BEAT, F.col("r_peak_sample").alias("r_peak"))


@query(f"WITH {_C_SQL} SELECT session_id, heartbeat_id, c_point FROM cp")
def p9_c_points_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.c_points(*beats(spark, sf_dir))


@query()
def p9_c_points_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.c_points_by_prominence(*beats(spark, sf_dir))


@query(f"""WITH {_C_SQL}, d1 AS (SELECT *, {_G.format('value')} AS g FROM s {_PW}), d2 AS (SELECT session_id, idx, -({_G.format('g')}) AS value FROM d1 {_PW}),
x AS (SELECT cp.session_id, heartbeat_id, idx, value FROM cp JOIN d2 ON d2.session_id = cp.session_id AND idx BETWEEN r_peak_sample AND c_point),
f AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS fresh FROM x {_BW}), g AS (SELECT *, sum(fresh) OVER w AS run FROM f {_BW}),
h AS (SELECT session_id, heartbeat_id, run, (min(idx) + max(idx)) // 2 AS idx, first(value) AS value FROM g GROUP BY 1, 2, 3),
k AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM h WINDOW w AS (PARTITION BY session_id, heartbeat_id ORDER BY run)),
z AS (SELECT session_id, heartbeat_id, max(idx) AS b_point FROM k WHERE a < value AND b < value GROUP BY 1, 2)
SELECT cp.session_id, cp.heartbeat_id, b_point FROM cp LEFT JOIN z ON z.session_id = cp.session_id AND z.heartbeat_id = cp.heartbeat_id""")
def p11_b_points_second_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, x = beats(spark, sf_dir)
    return C.b_points_second_derivative(own, x, C.c_points(own, x))


@query(f"""WITH {_C_SQL}, e AS (SELECT cp.*, c_point - 3 AS a, l.value AS y0, r.value AS y1 FROM cp JOIN s l ON l.session_id = cp.session_id AND l.idx = c_point - 3 JOIN s r ON r.session_id = cp.session_id AND r.idx = c_point),
g AS (SELECT e.session_id, heartbeat_id, s.idx, round(y0 + (y1 - y0) / 3 * (s.idx - a) - value, 9) AS gap FROM e JOIN s ON s.session_id = e.session_id AND s.idx >= a AND s.idx < c_point),
z AS (SELECT session_id, heartbeat_id, idx AS b_point FROM g QUALIFY row_number() OVER (PARTITION BY session_id, heartbeat_id ORDER BY gap DESC, idx) = 1)
SELECT cp.session_id, cp.heartbeat_id, b_point FROM cp LEFT JOIN z ON z.session_id = cp.session_id AND z.heartbeat_id = cp.heartbeat_id""")
def p12_b_points_chord(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, x = beats(spark, sf_dir)
    return C.b_points_chord(own, x, C.c_points(own, x), FS)


@query(f"""WITH {_C_SQL}, x AS (SELECT cp.session_id, heartbeat_id, start_sample, c_point, idx, value FROM cp JOIN s ON s.session_id = cp.session_id AND idx >= start_sample AND idx < end_sample),
d1 AS (SELECT *, {_G.format('value')} AS g1 FROM x {_BW}), d2 AS (SELECT *, {_G.format('g1')} AS g2 FROM d1 {_BW}), d3 AS (SELECT *, round({_G.format('g2')}, 9) AS g3 FROM d2 {_BW}),
z AS (SELECT session_id, heartbeat_id, idx AS b_point FROM d3 WHERE c_point - 3 >= start_sample AND idx >= c_point - 3 AND idx < c_point AND g3 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, heartbeat_id ORDER BY g3 DESC, idx) = 1)
SELECT cp.session_id, cp.heartbeat_id, b_point FROM cp LEFT JOIN z ON z.session_id = cp.session_id AND z.heartbeat_id = cp.heartbeat_id""")
def p14_b_points_third_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, x = beats(spark, sf_dir)
    return C.b_points_third_derivative(own, x, C.c_points(own, x), FS)


@query(f"""WITH {_C_SQL}, e AS (SELECT *, lag(c_point) OVER (PARTITION BY session_id ORDER BY heartbeat_id) AS lc FROM cp),
x AS (SELECT e.session_id, heartbeat_id, idx, value FROM e JOIN s ON s.session_id = e.session_id AND idx >= c_point - (c_point - lc) // 3 AND idx < c_point WHERE lc IS NOT NULL),
k AS (SELECT *, coalesce(lag(value) OVER w, last(value) OVER u) AS a, coalesce(lead(value) OVER w, first(value) OVER u) AS b FROM x
  WINDOW w AS (PARTITION BY session_id, heartbeat_id ORDER BY idx), u AS (PARTITION BY session_id, heartbeat_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
z AS (SELECT session_id, heartbeat_id, idx AS a_point FROM k WHERE value < a AND value < b QUALIFY row_number() OVER (PARTITION BY session_id, heartbeat_id ORDER BY value, idx) = 1)
SELECT cp.session_id, cp.heartbeat_id, a_point FROM cp LEFT JOIN z ON z.session_id = cp.session_id AND z.heartbeat_id = cp.heartbeat_id""")
def p16_a_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, x = beats(spark, sf_dir)
    return C.a_points(own, x, C.c_points(own, x))


_A_SQL = f"""{_C_SQL}, e AS (SELECT *, lag(c_point) OVER (PARTITION BY session_id ORDER BY heartbeat_id) AS lc FROM cp),
ax AS (SELECT e.session_id, heartbeat_id, idx, value FROM e JOIN s ON s.session_id = e.session_id AND idx >= c_point - (c_point - lc) // 3 AND idx < c_point WHERE lc IS NOT NULL),
ak AS (SELECT *, coalesce(lag(value) OVER w, last(value) OVER u) AS a, coalesce(lead(value) OVER w, first(value) OVER u) AS b FROM ax
  WINDOW w AS (PARTITION BY session_id, heartbeat_id ORDER BY idx), u AS (PARTITION BY session_id, heartbeat_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ap AS (SELECT session_id, heartbeat_id, idx AS a_point FROM ak WHERE value < a AND value < b QUALIFY row_number() OVER (PARTITION BY session_id, heartbeat_id ORDER BY value, idx) = 1)"""


@query(f"""WITH {_A_SQL}, d1 AS (SELECT *, {_G.format('value')} AS d2 FROM s {_PW}), d AS (SELECT session_id, idx, value, d2, {_G.format('d2')} AS d3 FROM d1 {_PW}),
x AS (SELECT cp.session_id, cp.heartbeat_id, a_point, c_point, d.idx, d.value, d2, d3, arg_max(d.value, d.idx) OVER v AS top, arg_min(d.value, d.idx) OVER v AS foot, lead(d2) OVER (PARTITION BY cp.session_id, cp.heartbeat_id ORDER BY d.idx) AS nx
  FROM cp JOIN ap USING (session_id, heartbeat_id) JOIN d ON d.session_id = cp.session_id AND d.idx BETWEEN a_point AND c_point WINDOW v AS (PARTITION BY cp.session_id, cp.heartbeat_id)),
b0 AS (SELECT *, CASE WHEN idx = c_point THEN 'end' WHEN idx = a_point THEN 'start' WHEN idx <= c_point - 2 AND d2 < 0 AND nx >= 0 THEN 'start' WHEN idx <= c_point - 2 AND d2 >= 0 AND nx < 0 THEN 'end' END AS kind FROM x),
b1 AS (SELECT *, kind = 'start' AND value > trunc(top / 2) AS hs FROM b0 WHERE kind IS NOT NULL),
b2 AS (SELECT *, NOT hs AND NOT coalesce(lag(hs) OVER w, false) AS r1 FROM b1 {_BW}),
b3 AS (SELECT *, r1 AND kind = 'end' AND value < trunc(2 * top / 3) AS le FROM b2),
b4 AS (SELECT *, le AND NOT coalesce(lag(r1) OVER w, false) AS bad, r1 AND NOT le AND NOT coalesce(lead(le) OVER w, false) AS stays FROM b3 {_BW}),
f AS (SELECT session_id, heartbeat_id, bool_or(bad) AS failed FROM b4 GROUP BY 1, 2),
j AS (SELECT *, value - lag(value) OVER w AS jump, lag(idx) OVER w AS origin, count(*) OVER (PARTITION BY session_id, heartbeat_id) AS n FROM b4 WHERE stays {_BW}),
rm AS (SELECT session_id, heartbeat_id, origin AS rs, idx AS re FROM j WHERE n > 2 AND jump IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, heartbeat_id ORDER BY jump DESC, idx) = 1
  UNION ALL SELECT session_id, heartbeat_id, min(idx), max(idx) FROM j WHERE n <= 2 GROUP BY 1, 2),
i AS (SELECT x.session_id, x.heartbeat_id, x.idx, d2, d3, top - foot AS h, lag(d3) OVER q AS pv, lead(d3) OVER q AS nv FROM x JOIN rm USING (session_id, heartbeat_id) WHERE x.idx >= rs AND x.idx < re - CAST(trunc({2 / 3!r}::DOUBLE * (re - rs)) AS BIGINT)
  WINDOW q AS (PARTITION BY x.session_id, x.heartbeat_id ORDER BY x.idx)),
t AS (SELECT session_id, heartbeat_id, max(idx) AS hit FROM i WHERE (nv IS NOT NULL AND (d3 < 0) <> (nv < 0) AND d2 >= 0 AND d2 < 10 * h / 20.0::DOUBLE) OR (d3 >= coalesce(pv, d3) AND d3 >= coalesce(nv, d3) AND d3 >= 4 * h / 20.0::DOUBLE) GROUP BY 1, 2)
SELECT hb.session_id, hb.heartbeat_id, CASE WHEN a_point IS NULL OR failed OR rs IS NULL OR (rs = a_point AND re = a_point) THEN NULL ELSE coalesce(hit, rs) END AS b_point
FROM hb LEFT JOIN ap USING (session_id, heartbeat_id) LEFT JOIN f USING (session_id, heartbeat_id) LEFT JOIN rm USING (session_id, heartbeat_id) LEFT JOIN t USING (session_id, heartbeat_id)""")
def p15_b_points_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B points in the first third of the steepest rise between A and C."""
    own, x = beats(spark, sf_dir)
    return monotone.b_points_monotone(own, x, C.c_points(own, x), FS)


_EXTREMA = """{0}f AS (SELECT *, {1} AS u, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS fresh FROM x WINDOW w AS (PARTITION BY session_id, heartbeat_id ORDER BY idx)),
{0}g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, heartbeat_id ORDER BY idx) AS run FROM {0}f),
{0}h AS (SELECT session_id, heartbeat_id, run, (min(idx) + max(idx)) // 2 AS idx, first(u) AS u FROM {0}g GROUP BY 1, 2, 3),
{0}k AS (SELECT *, lag(u) OVER w AS a, lead(u) OVER w AS b FROM {0}h WINDOW w AS (PARTITION BY session_id, heartbeat_id ORDER BY run)), {0} AS (SELECT * FROM {0}k WHERE a < u AND b < u)"""


@query(f"""WITH {_BEATS_SQL}, x AS (SELECT hb.session_id, heartbeat_id, idx, value FROM hb JOIN s ON s.session_id = hb.session_id AND idx >= r_peak_sample AND idx < least(r_peak_sample + 8, end_sample)),
fa AS (SELECT session_id, heartbeat_id, avg(value) AS mean, min(value) AS low FROM x GROUP BY 1, 2), {_EXTREMA.format('lo', '-value')}, {_EXTREMA.format('hi', 'value')},
iv AS (SELECT lo.session_id, lo.heartbeat_id, min(idx) AS i, arg_min(-u, idx) AS v, first(mean) AS mean FROM lo JOIN fa USING (session_id, heartbeat_id) WHERE -u < mean - 0.5 * abs(low - mean) GROUP BY 1, 2),
ao AS (SELECT hi.session_id, hi.heartbeat_id, min(idx) AS ao_point FROM hi JOIN iv USING (session_id, heartbeat_id) WHERE idx > i AND u > v + 0.7 * abs(v - mean) GROUP BY 1, 2)
SELECT hb.session_id, hb.heartbeat_id, i AS ivc_point, ao_point FROM hb LEFT JOIN iv USING (session_id, heartbeat_id) LEFT JOIN ao USING (session_id, heartbeat_id)""")
def p26_ao_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, x = beats(spark, sf_dir)
    return C.ao_points(own, x, 40.0)


_OUT = f"""{SAMPLES_SQL}, o1 AS (SELECT session_id, idx, value, value - quantile_cont(value, 0.5) OVER (PARTITION BY session_id) AS o FROM s),
o2 AS (SELECT session_id, idx, value, o > 3 * quantile_cont(abs(o), 0.5) OVER (PARTITION BY session_id) AS outlier FROM o1)"""


@query(f"WITH {_OUT} SELECT * FROM o2")
def p22_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.outliers(samples(spark, sf_dir).select("session_id", "idx", "value"))


#: Points for the corrections: R stands for B, with some missing.
_BP = "CASE WHEN heartbeat_id % 7 <> 3 THEN r_peak_sample - 3 * CASE WHEN heartbeat_id % 5 = 2 THEN 1 ELSE 0 END END"
_POINTS_SQL = _C_SQL.replace(", cp AS (", ", cp AS MATERIALIZED (").replace("s AS (", "s0 AS (", 1).replace(" FROM s ", " FROM s0 ").replace("FROM s WHERE", "FROM s0 WHERE").replace("s.session_id", "s0.session_id")
_STATIONARY_SQL = f"""WITH RECURSIVE {_POINTS_SQL}, pt AS MATERIALIZED (SELECT session_id, heartbeat_id, b, c_point, (c_point - b) / 20.0::DOUBLE AS value, row_number() OVER (PARTITION BY session_id ORDER BY heartbeat_id) - 1 AS idx
  FROM (SELECT *, {_BP} AS b FROM cp) WHERE b IS NOT NULL AND c_point IS NOT NULL),
s AS MATERIALIZED (SELECT session_id, idx, value FROM pt UNION ALL SELECT session_id, unnest(range(m, 16)), last FROM (SELECT session_id, count(*) AS m, arg_max(value, idx) AS last FROM pt GROUP BY 1) WHERE m <= 15),
{zero_phase_ctes(_BASE)}, st AS MATERIALIZED (SELECT pt.*, y AS base, value - y AS u FROM pt JOIN n USING (session_id) JOIN g ON g.session_id = pt.session_id AND g.j = n + p - 1 - idx),
o1 AS (SELECT *, u - quantile_cont(u, 0.5) OVER (PARTITION BY session_id) AS o FROM st), o2 AS MATERIALIZED (SELECT *, o > 3 * quantile_cont(abs(o), 0.5) OVER (PARTITION BY session_id) AS outlier FROM o1)"""


def _b_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, x = beats(spark, sf_dir)
    b = F.when(F.col("heartbeat_id") % 7 != 3, F.col("r_peak_sample") - F.when(F.col("heartbeat_id") % 5 == 2, 3).otherwise(0))
    return own.join(C.c_points(own, x), list(C.BEAT)).select(*C.BEAT, b.alias("b_point"), "c_point")


@query(f"{_STATIONARY_SQL} SELECT session_id, heartbeat_id, round(u, 6) + 0.0 AS stationary, round(base, 6) + 0.0 AS baseline FROM st")
def p21_stationarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = correction.stationarised(_b_points(spark, sf_dir), FS)
    return out.select(*C.BEAT, *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("stationary", "baseline")))


@query(f"""{_STATIONARY_SQL}, a AS (SELECT *, CASE WHEN NOT outlier THEN u END AS v FROM o2),
b2 AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER q AS bi, last_value(v IGNORE NULLS) OVER q AS bv, first_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER r AS ai, first_value(v IGNORE NULLS) OVER r AS av FROM a
  WINDOW q AS (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (PARTITION BY session_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT *, CASE WHEN v IS NOT NULL THEN v WHEN av IS NULL THEN bv ELSE bv + (av - bv) * (idx - bi) / nullif(ai - bi, 0) END AS line FROM b2)
SELECT session_id, heartbeat_id, outlier, nullif(trunc(round(c_point - (line + base) * 20.0::DOUBLE, 6)), 0) AS corrected FROM l""")
def p23_correct_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cycle of the correction by interpolation."""
    return correction.stationarised(_b_points(spark, sf_dir), FS).select(*C.BEAT, "outlier", "corrected")


@query()
def p20_correct_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole loop."""
    return correction.corrected(_b_points(spark, sf_dir), FS)


@query()
def p24_correct_autoregressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop with forward and backward predictions instead of lines."""
    return autoregression.corrected(_b_points(spark, sf_dir), FS)


@query()
def p27_ao_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AO points at the largest smoothed envelope in the 200 ms after R."""
    own, x = beats(spark, sf_dir)
    window = own.withColumn("end_sample", F.col("r_peak_sample") + int(0.2 * 100))
    return C.c_points(window, ecg.scg_envelope(x.select("session_id", "idx", "value"), 100.0)).withColumnRenamed("c_point", "ao_point")


@query(f"WITH {_C_SQL} SELECT session_id, count(*) AS n_beats, count(*) FILTER (heartbeat_id % 4 = 1) AS n_failed, list(heartbeat_id ORDER BY heartbeat_id) FILTER (heartbeat_id % 4 = 1) AS failed FROM cp GROUP BY 1 HAVING n_failed > 0")
def i15_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats without a point, here every fourth one."""
    own = beats(spark, sf_dir)
    points = C.c_points(*own).withColumn("c_point", F.when(F.col("heartbeat_id") % 4 != 1, F.col("c_point")))
    return diagnostics(points, "c_point")


_HOPS = 24
_HOP = "w{0} AS (SELECT e.session_id, e.heartbeat_id, e.hi AS idx, sum(w) AS w FROM e JOIN w{1} u ON u.session_id = e.session_id AND u.heartbeat_id = e.heartbeat_id AND u.idx = e.lo GROUP BY 1, 2, 3)"


@query(f"""WITH {_BEATS_SQL}, x AS (SELECT hb.session_id, heartbeat_id, idx, value FROM hb JOIN s ON s.session_id = hb.session_id AND idx >= start_sample AND idx < end_sample),
v AS (SELECT i.session_id, i.heartbeat_id, i.idx AS i, j.idx AS j, i.value AS vi, j.value AS vj, (j.value - i.value) / (j.idx - i.idx) AS slope FROM x i JOIN x j ON j.session_id = i.session_id AND j.heartbeat_id = i.heartbeat_id AND i.idx < j.idx),
p AS (SELECT *, min(slope) OVER (PARTITION BY session_id, heartbeat_id, j ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearer FROM v),
e AS (SELECT session_id, heartbeat_id, CASE WHEN vi > vj THEN i ELSE j END AS hi, CASE WHEN vi > vj THEN j ELSE i END AS lo FROM p WHERE vi <> vj AND (nearer IS NULL OR slope < nearer)),
w0 AS (SELECT session_id, heartbeat_id, idx, 1.0::DOUBLE AS w FROM x), {", ".join(_HOP.format(k, k - 1) for k in range(1, _HOPS))},
h AS ({" UNION ALL ".join(f"SELECT session_id, heartbeat_id, idx, w, {k} AS h FROM w{k}" for k in range(_HOPS))}),
c AS (SELECT session_id, heartbeat_id, h, count(*) AS cnt FROM h GROUP BY 1, 2, 3), n AS (SELECT session_id, heartbeat_id, count(*) AS n, min(value) AS low FROM x GROUP BY 1, 2),
f AS (SELECT session_id, heartbeat_id, any_value(n) AS n, any_value(low) AS low, coalesce(min(h) FILTER (cnt <= (1 - 0.55::DOUBLE) * n), max(h)) AS h FROM c JOIN n USING (session_id, heartbeat_id) GROUP BY 1, 2),
z AS (SELECT f.session_id, f.heartbeat_id, x.idx AS c_point FROM f JOIN x USING (session_id, heartbeat_id) LEFT JOIN h ON h.session_id = f.session_id AND h.heartbeat_id = f.heartbeat_id AND h.h = f.h AND h.idx = x.idx
  QUALIFY row_number() OVER (PARTITION BY f.session_id, f.heartbeat_id ORDER BY coalesce(w, 0) * (value - low) DESC, x.idx) = 1)
SELECT hb.session_id, hb.heartbeat_id, c_point FROM hb LEFT JOIN z USING (session_id, heartbeat_id)""")
def p10_c_points_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.c_points_by_visibility(*beats(spark, sf_dir))


@query(f"""WITH {_BEATS_SQL}, a AS (SELECT session_id, idx, round(2 * value - 2 * lag(value) OVER w, 9) AS w1,
  round((lead(value, 2) OVER w + 3 * lead(value) OVER w + 2 * value - 2 * lag(value) OVER w - 3 * lag(value, 2) OVER w - lag(value, 3) OVER w) / 4, 9) AS w2 FROM s {_PW}),
m AS (SELECT *, CASE WHEN abs(w1) >= coalesce(abs(lag(w1) OVER w), -1) AND abs(w1) > coalesce(abs(lead(w1) OVER w), -1) THEN sign(w1) ELSE 0 END AS e1,
  CASE WHEN abs(w2) >= coalesce(abs(lag(w2) OVER w), -1) AND abs(w2) > coalesce(abs(lead(w2) OVER w), -1) THEN sign(w2) ELSE 0 END AS e2 FROM a {_PW}),
t AS (SELECT *, e2 < 0 AND min(e1) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) < 0 AS fall, w2 < 0 AND lead(w2) OVER w >= 0 AS turn FROM m {_PW}),
u AS (SELECT hb.session_id, heartbeat_id, idx AS rise, w2 AS size FROM hb JOIN t ON t.session_id = hb.session_id AND idx BETWEEN r_peak_sample - 8 AND r_peak_sample WHERE e2 > 0 QUALIFY row_number() OVER (PARTITION BY hb.session_id, heartbeat_id ORDER BY w2 DESC, idx) = 1),
d AS (SELECT u.session_id, heartbeat_id, max(idx) FILTER (fall AND -w2 >= 0.06 * size) AS down, max(idx) FILTER (turn) AS q FROM u JOIN t ON t.session_id = u.session_id AND idx BETWEEN rise - 8 AND rise - 1 GROUP BY 1, 2),
f AS (SELECT hb.session_id, hb.heartbeat_id, r_peak_sample, max(q) AS q FROM hb LEFT JOIN (SELECT session_id, q FROM d WHERE q >= down) c ON c.session_id = hb.session_id AND q > start_sample AND q < end_sample GROUP BY 1, 2, 3)
SELECT session_id, heartbeat_id, CASE WHEN q <= r_peak_sample THEN q END AS q_peak FROM f""")
def p6_q_peaks_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelets.q_peaks_by_wavelet(*beats(spark, sf_dir), FS, search=0.4)


_POINTS = {"c_highest": p9_c_points_argmax, "c_visibility": p10_c_points_visibility, "q_onset": p7_q_onsets, "q_wavelet": p6_q_peaks_wavelet}


@query(" UNION ALL ".join(f"SELECT '{name}' AS extraction, session_id, heartbeat_id, CAST({column} AS DOUBLE) AS point FROM ({ORACLE_SQL[f.__name__]})" for (name, f), column in zip(_POINTS.items(), ("c_point", "c_point", "q_onset", "q_peak"), strict=True)))
def p1_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of several extractions of one contract, in one table."""
    own, x = beats(spark, sf_dir)
    found: dict[str, contract.Extraction] = {
        "c_highest": lambda samples, heartbeats, fs: C.c_points(heartbeats, samples),
        "c_visibility": lambda samples, heartbeats, fs: visibility.c_points_by_visibility(heartbeats, samples),
        "q_onset": lambda samples, heartbeats, fs: C.q_onsets(heartbeats, fs),
        "q_wavelet": lambda samples, heartbeats, fs: wavelets.q_peaks_by_wavelet(heartbeats, samples, fs, search=0.4),
    }
    return contract.extracted(found, x, own, FS)
