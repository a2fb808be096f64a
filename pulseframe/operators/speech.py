"""Voice activity, pauses and speaker segments: gaps-and-islands plans over frames and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.signals import ordered


def frames(n_bytes: Column, fs: int, ms: int) -> Column:
    """array<struct<frame_idx, offset, ts, dur>> of PCM16 mono audio; a frame that ends exactly at the end is left out."""
    size = int(fs * ms / 1000 * 2)
    count = F.greatest(F.lit(0), F.ceil((n_bytes - size) / size)).cast("int")
    dur = size / fs / 2
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.cast("long").alias("frame_idx"), (i * size).cast("long").alias("offset"), (i * dur).alias("ts"), F.lit(dur).alias("dur"))))


def vad_segments(flags: DataFrame, pad_frames: int, dur: float) -> DataFrame:
    """(session_id, segment, start, stop) of flags(session_id, idx, speech boolean): on after pad_frames speech frames in a row, off after as many without.

    Equal to a ring buffer of up to 10 frames with a 90 % threshold. A start or end is the time of the oldest frame in the
    buffer; a segment still open at the end is closed there.
    """
    m = pad_frames
    voiced = F.sum(F.col("speech").cast("int")).over(ordered().rowsBetween(-(m - 1), 0))
    base = flags.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("session_id")))
    base = base.withColumn("k", F.when(F.col("idx") >= m - 1, voiced)).withColumn("event", F.when(F.col("k") == m, 1).when(F.col("k") == 0, -1))
    base = base.withColumn("state", F.coalesce(F.last("event", True).over(ordered().rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1)))
    base = base.withColumn("was", F.coalesce(F.lag("state").over(ordered()), F.lit(-1))).filter("state <> was")
    base = base.withColumn("segment", F.sum(F.when(F.col("state") == 1, 1).otherwise(0)).over(ordered()) - 1)
    out = base.groupBy("session_id", "segment").agg(F.max("n").alias("n"), F.max(F.when(F.col("state") == 1, F.col("idx"))).alias("on"), F.max(F.when(F.col("state") == -1, F.col("idx"))).alias("off"))
    open_end = F.when(F.col("on") < F.col("n") - 1, F.greatest(F.col("on") + 1, F.col("n") - m)).otherwise(F.col("n"))
    end = F.coalesce(F.col("off") - m + 2, open_end)
    return out.select("session_id", F.col("segment").cast("long").alias("segment"), ((F.col("on") - m + 1) * dur).alias("start"), (end * dur).alias("stop"))


def collected(flags: DataFrame, pad_frames: int, dur: float) -> DataFrame:
    """(session_id, segment, frame_ids): the frames of each segment in order."""
    segments = vad_segments(flags, pad_frames, dur).withColumnRenamed("session_id", "s")
    span = F.sequence(F.rint(F.col("start") / dur).cast("long"), F.rint(F.col("stop") / dur).cast("long") - 1)
    return segments.filter("stop > start").select(F.col("s").alias("session_id"), "segment", span.alias("frame_ids"))


def timing_cues(segments: DataFrame) -> DataFrame:
    """(session_id, total, speaking, n_pauses, pause_time, pause_fraction) of segments(session_id, start, stop)."""
    after = F.lead("start").over(Window.partitionBy("session_id").orderBy("start"))
    gaps = segments.withColumn("gap", after - F.col("stop"))
    out = gaps.groupBy("session_id").agg(
        (F.max_by("stop", "start") - F.min("start")).alias("total"), F.sum(F.col("stop") - F.col("start")).alias("speaking"),
        (F.count(F.lit(1)) - 1).alias("n_pauses"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("pause_time"),
    )
    return out.withColumn("pause_fraction", F.try_divide("pause_time", "total"))


def first_long_segment(segments: DataFrame, skip: float = 0.5, length: float = 2.5) -> DataFrame:
    """(session_id, t1, t2, t3) of the first segment longer than skip + length."""
    first = segments.filter(F.col("stop") - F.col("start") > skip + length).groupBy("session_id").agg(F.min(F.struct("start", "stop")).alias("s"))
    t2 = F.col("s.start") + skip + length
    return first.select("session_id", (F.col("s.start") + skip).alias("t1"), t2.alias("t2"), F.greatest(t2, F.col("s.stop") - skip).alias("t3"))


def silence(flags: DataFrame, dur: float, long_pad: int = 10, short_pad: int = 5) -> DataFrame:
    """timing_cues of the short-pad segments that start within the bounds of the long-pad ones."""
    bounds = vad_segments(flags, long_pad, dur).groupBy("session_id").agg(F.min("start").alias("lo"), F.max("stop").alias("hi"))
    inside = vad_segments(flags, short_pad, dur).join(bounds, "session_id").filter("start >= lo and start <= hi")
    return timing_cues(inside.select("session_id", "start", "stop"))


def voiced_share(flags: DataFrame) -> DataFrame:
    """(session_id, n_frames, n_voiced, voiced_pct)."""
    out = flags.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if("speech").alias("n_voiced"))
    return out.withColumn("voiced_pct", F.try_divide(F.col("n_voiced"), F.col("n_frames")) * 100)


def clean_segments(segments: DataFrame, least: float = 0.3) -> DataFrame:
    return segments.withColumn("length", F.col("stop") - F.col("start")).filter(F.col("length") >= least)


def test_speaker(segments: DataFrame) -> DataFrame:
    """(session_id, test): the speaker with the longest total, the first name on ties."""
    total = segments.groupBy("session_id", "speaker").agg(F.round(F.sum("length"), 6).alias("total"))
    w = Window.partitionBy("session_id").orderBy(F.col("total").desc(), "speaker")
    return total.withColumn("k", F.row_number().over(w)).filter("k = 1").select("session_id", F.col("speaker").alias("test"))


def speaker_intervals(segments: DataFrame, fs: int) -> DataFrame:
    """(session_id, k, lo, hi, test, panel): the runs of samples lo..hi-1 between the edges of segments, numbered in order, with the flags of all their samples.

    Segments are closed at both ends. The panel flag is that of the last segment, in order of start, that covers a run;
    where several speakers overlap, the test speaker is off. A stretch without the test speaker that has some panel is panel. The first and the
    last sample of a session are runs of their own. Rows grow with segments and their overlaps, not with samples.
    """
    at = lambda c, f: f(F.round(F.col(c) * fs, 6)).cast("long")
    who = segments.join(test_speaker(segments), "session_id")
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("start", "stop", "speaker"))
    spans = who.withColumn("ord", order).select("session_id", "speaker", "test", "ord", at("start", F.ceil).alias("a"), (at("stop", F.floor) + 1).alias("b"))
    ends = segments.groupBy("session_id").agg(F.floor(F.round(F.max("stop") * fs, 6)).cast("long").alias("end"))
    edges = spans.filter("a < b").select("session_id", F.explode(F.array("a", "b")).alias("cut")).union(ends.select("session_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("end"), F.col("end") + 1)).alias("cut"))).distinct()
    w = Window.partitionBy("session_id").orderBy("cut")
    cuts = edges.join(ends, "session_id").filter("cut between 0 and end + 1").withColumn("k", F.row_number().over(w)).withColumn("hi", F.lead("cut").over(w)).drop("end")
    begins, stops = cuts.select("session_id", F.col("cut").alias("a"), F.col("k").alias("first")), cuts.select("session_id", F.col("cut").alias("b"), F.col("k").alias("beyond"))
    placed = spans.join(begins, ["session_id", "a"]).join(stops, ["session_id", "b"]).filter("first < beyond").withColumn("k", F.explode(F.sequence("first", F.col("beyond") - 1)))
    covered = placed.groupBy("session_id", "k").agg(
        F.max((F.col("speaker") == F.col("test")).cast("int")).alias("test"), F.count_distinct("speaker").alias("n"), F.max(F.struct("ord", (F.col("speaker") != F.col("test")).cast("int").alias("p"))).alias("last")
    )
    flat = cuts.filter("hi is not null").join(covered, ["session_id", "k"], "left")
    flat = flat.select("session_id", "k", F.col("cut").alias("lo"), "hi", F.when(F.col("n") > 1, 0).otherwise(F.coalesce("test", F.lit(0))).alias("test"), F.coalesce("last.p", F.lit(0)).alias("panel"))
    by_k = Window.partitionBy("session_id").orderBy("k")
    run = flat.withColumn("step", F.coalesce(F.abs(F.col("test") - F.lag("test").over(by_k)), F.lit(0))).withColumn("run", F.sum("step").over(by_k))
    own = Window.partitionBy("session_id", "run")
    some = (F.max("test").over(own) == 0) & (F.max("panel").over(own) == 1)
    return run.select("session_id", "k", "lo", "hi", "test", F.when(some, 1).otherwise(F.col("panel")).alias("panel"))


def speaker_timeline(segments: DataFrame, fs: int) -> DataFrame:
    """(session_id, idx, test, panel): the flags of speaker_intervals for each sample that a session spans."""
    return speaker_intervals(segments, fs).select("session_id", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("idx"), "test", "panel")


def _edges(runs: DataFrame, flag: str, name: Column, fs: int) -> DataFrame:
    step = F.col(flag) - F.lag(flag).over(Window.partitionBy("session_id").orderBy("k"))
    moved = runs.withColumn("step", step).filter("step <> 0")
    w = Window.partitionBy("session_id", "step").orderBy("k")
    numbered = moved.withColumn("pair", F.row_number().over(w))
    out = numbered.groupBy("session_id", "pair").agg(F.max(F.when(F.col("step") > 0, F.col("lo"))).alias("a"), F.max(F.when(F.col("step") < 0, F.col("lo"))).alias("b"))
    return out.select("session_id", (F.col("a") / fs).alias("start"), (F.col("b") / fs).alias("stop"), name.alias("speaker"))


def diarization(segments: DataFrame, fs: int, least: float = 0.3) -> DataFrame:
    """(session_id, start, stop, speaker, length): the test speaker and the gaps without panel as cleaned segments, with the others' own ones.

    Starts and ends are paired by number, so a session that begins with speech pairs an end with a later start.
    """
    own = clean_segments(segments, least)
    line = speaker_intervals(own, fs)
    by_k = Window.partitionBy("session_id").orderBy("k")
    edge = (F.lag("k").over(by_k).isNull()) | (F.lead("k").over(by_k).isNull())  # the first and the last sample
    line = line.withColumn("quiet", F.when(edge, 0).otherwise(1 - F.col("panel")))
    names = test_speaker(own)
    test = _edges(line, "test", F.lit("test"), fs).join(names, "session_id").select("session_id", "start", "stop", F.col("test").alias("speaker"))
    quiet = _edges(line, "quiet", F.lit("PANEL_INV"), fs)
    others = own.join(names, "session_id").filter("speaker <> test").select("session_id", "start", "stop", "speaker")
    return test.unionByName(quiet).unionByName(others).withColumn("length", F.col("stop") - F.col("start"))


def durations(samples: DataFrame, fs: float) -> DataFrame:
    """(session_id, duration): seconds of each recording of samples(session_id, idx)."""
    return samples.groupBy("session_id").agg((F.count(F.lit(1)) / F.lit(fs)).alias("duration"))


def guarded(recordings: DataFrame, results: DataFrame, least: float) -> DataFrame:
    """(session_id, the columns of results, error) for every row of recordings(session_id, duration): errors are data.

    A recording shorter than `least` seconds, or without a result, has null columns and says why in error; others have a null error.
    """
    short = F.col("duration") < least
    joined = recordings.join(results.withColumn("_found", F.lit(True)), "session_id", "left")
    error = F.when(short, F.concat(F.lit("shorter than "), F.lit(str(least)), F.lit(" s"))).when(F.col("_found").isNull(), F.lit("no result"))
    values = [c for c in results.columns if c != "session_id"]
    return joined.select("session_id", *(F.when(~short, F.col(c)).alias(c) for c in values), error.alias("error"))


def diagnostics(points: DataFrame, point: str) -> DataFrame:
    """(session_id, n_beats, n_failed, failed): how many heartbeats of points(session_id, heartbeat_id, point) have no point, and which, in order; a row for each session with some."""
    failed = F.sort_array(F.collect_list(F.when(F.col(point).isNull(), F.col("heartbeat_id"))))
    out = points.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_beats"), F.count_if(F.col(point).isNull()).alias("n_failed"), failed.alias("failed"))
    return out.filter("n_failed > 0")
