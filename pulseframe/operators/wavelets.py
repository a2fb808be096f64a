"""Q peaks by an a-trous wavelet: its scales are windows of bounded reach, run on blocks of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.blocks import with_halo
from pulseframe.operators.cardiac import BEAT, q_peaks, window_rows

_BLOCK = 4096


def _convolved(a: dict[int, float], b: dict[int, float]) -> dict[int, float]:
    out: dict[int, float] = {}
    for i, x in a.items():
        for j, y in b.items():
            out[i + j] = out.get(i + j, 0.0) + x * y
    return out


def scale_taps(scale: int) -> dict[int, float]:
    """Offset -> weight of the quadratic spline wavelet at a scale, 1 the finest: every scale is a slope half a sample before its position."""
    smooth = {0: 1.0}
    for level in range(scale - 1):
        d = 1 << level
        smooth = _convolved(smooth, {d: 0.125, 0: 0.375, -d: 0.375, -2 * d: 0.125})
    return {k: w for k, w in sorted(_convolved(smooth, {(1 << (scale - 1)) - 1: 2.0, -1: -2.0}).items()) if w}


def scales(samples: DataFrame, n: int = 2, block: int = _BLOCK) -> DataFrame:
    """(session_id, idx, w1, e1, ...): the wavelet at scales 1..n, null where it reaches beyond the session, and its modulus maxima.

    e<j> is the sign of w<j> where its modulus is not below that of the sample before and above that of the sample after, else 0.
    """
    taps = [scale_taps(j) for j in range(1, n + 1)]
    reach = max(max(abs(k) for k in t) for t in taps) + 1
    w = Window.partitionBy("session_id", "block").orderBy("idx")
    dealt = with_halo(samples.select("session_id", "idx", "value"), block, reach, reach)
    at = lambda k: F.lead("value", k).over(w) if k > 0 else F.lag("value", -k).over(w) if k < 0 else F.col("value")
    for j, t in enumerate(taps, 1):
        dealt = dealt.withColumn(f"w{j}", F.round(sum((at(k) * v for k, v in t.items()), F.lit(0.0)), 9))
    size: dict[int, Column] = {j: F.abs(F.col(f"w{j}")) for j in range(1, n + 1)}
    for j in size:
        largest = (size[j] >= F.coalesce(F.lag(size[j]).over(w), F.lit(-1.0))) & (size[j] > F.coalesce(F.lead(size[j]).over(w), F.lit(-1.0)))
        dealt = dealt.withColumn(f"e{j}", F.when(largest, F.signum(f"w{j}")).otherwise(0.0).cast("int"))
    return dealt.filter("own").select("session_id", "idx", *(c for j in range(1, n + 1) for c in (f"w{j}", f"e{j}")))


def q_candidates(beats: DataFrame, samples: DataFrame, fs: float, search: float = 0.1, least: float = 0.06, apart: int = 2, block: int = _BLOCK) -> DataFrame:
    """(session_id, q): for each beat, the turn from falling to rising in front of its steepest rise, where there is one.

    The rise is the largest positive modulus maximum of scale 2 in the `search` seconds up to R. The fall is the last negative one in the
    `search` seconds before it, of at least the share `least` of its size, that has a negative modulus maximum of scale 1
    within `apart` samples. q is the last change of sign of scale 2 between the two.
    """
    n = max(1, int(search * fs))
    around = Window.partitionBy("session_id", "block").orderBy("idx").rowsBetween(-apart, apart)
    dealt = with_halo(scales(samples, 2, block), block, apart + 1, apart + 1)
    line = Window.partitionBy("session_id", "block").orderBy("idx")
    dealt = dealt.withColumn("fall", (F.col("e2") < 0) & (F.min("e1").over(around) < 0)).withColumn("turn", (F.col("w2") < 0) & (F.lead("w2").over(line) >= 0))
    waves = dealt.filter("own").select("session_id", "idx", "w2", "e2", "fall", "turn")
    up = window_rows(beats, waves, F.col("r_peak_sample") - n, F.col("r_peak_sample")).filter("e2 > 0")
    rise = up.groupBy(*BEAT).agg(F.max(F.struct("w2", (-F.col("idx")).alias("at"))).alias("top")).select(*BEAT, (-F.col("top.at")).alias("rise"), F.col("top.w2").alias("size"))
    before = window_rows(rise, waves, F.col("rise") - n, F.col("rise") - 1, ("rise", "size"))
    fall = before.groupBy(*BEAT, "rise").agg(F.max(F.when(F.col("fall") & (-F.col("w2") >= least * F.col("size")), F.col("idx"))).alias("down"), F.max(F.when(F.col("turn"), F.col("idx"))).alias("q"))
    return fall.filter("down is not null and q >= down").select("session_id", "q")


def q_peaks_by_wavelet(beats: DataFrame, samples: DataFrame, fs: float, search: float = 0.1, block: int = _BLOCK) -> DataFrame:
    """(beat, q_peak): q_candidates assigned to the beats that they lie in."""
    return q_peaks(beats, q_candidates(beats, samples, fs, search, block=block))
