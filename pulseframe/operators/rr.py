"""RR-interval operators: encodings of beat series, artefact classes and their correction, as window plans over a session."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.blocks import with_halo
from pulseframe.operators.signals import ordered, whole


def rr_from_peaks(peaks: DataFrame, fs: float) -> DataFrame:
    """(session_id, idx, rr_ms, rr_s) of peaks(session_id, idx): the time since the peak before, null for the first."""
    gap = F.col("idx") - F.lag("idx").over(ordered())
    return peaks.select("session_id", "idx", (gap * 1000.0 / fs).alias("rr_ms"), (gap / F.lit(fs)).alias("rr_s"))


def peaks_from_rr(rr: DataFrame, fs: float = 1000.0) -> DataFrame:
    """(session_id, peak) of rr(session_id, idx, rr_ms): positions are cumulative times, cut to whole samples."""
    return rr.select("session_id", F.round(F.sum("rr_ms").over(ordered()) * fs / 1000, 6).cast("long").alias("peak"))


def dense_peaks(samples: DataFrame, peaks: DataFrame) -> DataFrame:
    """(session_id, idx, peak): one boolean for each sample."""
    marks = peaks.select("session_id", "idx", F.lit(True).alias("peak"))
    return samples.select("session_id", "idx").join(marks, ["session_id", "idx"], "left").withColumn("peak", F.coalesce("peak", F.lit(False)))


def correct_missed(peaks: DataFrame, missed: DataFrame) -> DataFrame:
    """peaks(session_id, idx) with a new peak half way before each one that is also in missed(session_id, idx)."""
    gaps = peaks.withColumn("before", F.lag("idx").over(ordered())).join(missed.select("session_id", "idx").distinct(), ["session_id", "idx"], "left_semi")
    fresh = gaps.filter("before is not null").select("session_id", (F.col("before") + F.floor((F.col("idx") - F.col("before")) / 2)).cast("long").alias("idx"))
    return peaks.select("session_id", "idx").unionByName(fresh).distinct()


#: Intervals on each side of a quartile range and of a median; a block of positions sees both in front of it and behind it.
_WIDE, _NEAR = 45, 5
BLOCK = 1 << 13


def rolling_quantiles(x: np.ndarray, half: int, ps: tuple[float, ...]) -> np.ndarray:
    """The quantiles, between order statistics by the line, of the values up to `half` positions away that are there: rows by position, columns by p. NaN is no value."""
    padded = np.concatenate([np.full(half, np.nan), x, np.full(half, np.nan)])
    near = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)
    last = np.maximum((~np.isnan(near)).sum(axis=1) - 1, 0)
    out = np.empty((len(x), len(ps)))
    for k, p in enumerate(ps):
        place = last * p
        low = np.floor(place).astype(np.int64)
        below, above = (np.take_along_axis(near, i[:, None], axis=1)[:, 0] for i in (low, np.minimum(low + 1, last)))
        out[:, k] = below + (above - below) * (place - low)
    return out


def _thresholds(batches: Iterator[pa.RecordBatch], alpha: float) -> Iterator[pa.RecordBatch]:
    """The rows of packed blocks with both thresholds, the medians and what the intervals are off them."""
    for batch in batches:
        for session, own in zip(batch.column("session_id").to_pylist(), batch.column("rows"), strict=True):
            rows = own.values
            mine = np.asarray(rows.field("own").to_numpy(zero_copy_only=False))
            rr, d = (rows.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("rr_ms", "d"))
            spread = lambda x: alpha * np.diff(rolling_quantiles(np.abs(x), _WIDE, (0.25, 0.75)), axis=1)[:, 0] / 2
            med = rolling_quantiles(rr, _NEAR, (0.5,))[:, 0]
            off = rr - med
            m = np.where(off < 0, 2 * off, off)
            made = [spread(d), med, m, spread(m)]
            kept = pa.array(mine)
            columns = [rows.field(c).filter(kept) for c in ("idx", "rr_ms", "i", "n", "d")]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(session, pa.int64()), int(mine.sum())), *columns, *(pa.array(x[mine], mask=np.isnan(x[mine])) for x in made)], names=["session_id", "idx", "rr_ms", "i", "n", "d", "threshold1", "med", "m", "threshold2"])


def artefacts(rr: DataFrame, c1: float = 0.13, c2: float = 0.17, alpha: float = 5.2, block: int = BLOCK) -> DataFrame:
    """rr(session_id, idx, rr_ms) with the two thresholds, the normalised differences and the classes ectopic, long, short, missed, extra.

    Quartile ranges run over 91, medians over 11 intervals around each, on blocks of a session and what they reach. With a threshold of 0 nothing is flagged.
    """
    n = F.count(F.lit(1)).over(whole())
    base = rr.select("session_id", "idx", "rr_ms", (F.row_number().over(ordered()) - 1).alias("i"), n.alias("n"), (F.col("rr_ms") - F.lag("rr_ms").over(ordered())).alias("diff"))
    base = base.withColumn("d", F.coalesce("diff", F.avg("diff").over(whole())))
    base = base.select("session_id", "idx", F.col("rr_ms").cast("double").alias("rr_ms"), F.col("i").cast("long").alias("i"), "n", F.col("d").cast("double").alias("d"))
    dealt = with_halo(base, block, _WIDE + _NEAR, _WIDE + _NEAR, "i")
    packed = dealt.groupBy("session_id", "block").agg(F.sort_array(F.collect_list(F.struct("i", "idx", "rr_ms", "n", "d", "own"))).alias("rows"))
    base = packed.mapInArrow(partial(_thresholds, alpha=alpha), "session_id long, idx long, rr_ms double, i long, n long, d double, threshold1 double, med double, m double, threshold2 double")
    base = base.withColumn("s11", F.try_divide("d", "threshold1")).withColumn("mrr", F.try_divide("m", "threshold2")).withColumn("all", F.percentile("rr_ms", F.lit(0.5)).over(whole()))
    lag, lead, lead2 = F.lag("s11").over(ordered()), F.lead("s11").over(ordered()), F.lead("s11", 2).over(ordered())
    ends = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    tail = F.col("i") >= F.col("n") - 2
    base = base.withColumn("s12", F.when(ends, 0.0).when(F.col("s11") >= 0, F.greatest(lag, lead)).otherwise(F.least(lag, lead)))
    base = base.withColumn("s22", F.when(tail, 0.0).when(F.col("s11") >= 0, F.least(lead, lead2)).otherwise(F.greatest(lead, lead2))).withColumn("next", F.coalesce(F.lead("rr_ms").over(ordered()), F.lit(0.0)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    s11, s12, s22 = F.col("s11"), F.col("s12"), F.col("s22")
    inner = (F.col("i") >= 2) & (F.col("i") < F.col("n") - 2)
    base = base.withColumn("ectopic", yes(((s11 > 1) & (s12 < -c1 * s11 - c2)) | ((s11 < -1) & (s12 > -c1 * s11 + c2))) & inner)
    far = yes(F.abs("mrr") > 3)
    base = base.withColumn("long", (yes((s11 > 1) & (s22 < -1)) | (far & (F.col("rr_ms") > F.col("all")))) & ~F.col("ectopic"))
    base = base.withColumn("short", (yes((s11 < -1) & (s22 > 1)) | (far & (F.col("rr_ms") <= F.col("all")))) & ~F.col("ectopic"))
    base = base.withColumn("missed", F.col("long") & yes(F.abs(F.col("rr_ms") / 2 - F.col("med")) < F.col("threshold2")))
    base = base.withColumn("extra", F.col("short") & yes(F.abs(F.col("rr_ms") + F.col("next") - F.col("med")) < F.col("threshold2")))
    return base.select("session_id", "idx", "rr_ms", "threshold1", "threshold2", "s11", "s12", "s22", "mrr", "ectopic", (F.col("long") & ~F.col("missed") & ~ends).alias("long"), (F.col("short") & ~F.col("extra") & ~ends).alias("short"), "missed", "extra")


def correct_peaks(peaks: DataFrame, fs: float, n_iterations: int = 1) -> DataFrame:
    """peaks(session_id, idx) after each round of dropping the peak that follows an extra one and filling in missed ones."""
    for _ in range(n_iterations):
        for kind in ("extra", "missed"):
            followed = peaks.withColumn("after", F.lead("idx").over(ordered()))
            found = artefacts(rr_from_peaks(peaks, fs).filter("rr_ms is not null").select("session_id", "idx", "rr_ms")).filter(kind).select("session_id", "idx")
            if kind == "extra":
                gone = followed.join(found, ["session_id", "idx"], "left_semi").select("session_id", F.col("after").alias("idx"))
                peaks = peaks.join(gone, ["session_id", "idx"], "left_anti")
            else:
                peaks = correct_missed(peaks, found)
    return peaks
