"""Raw feature extraction of recordings: voice measures of voiced runs, and measures of the segments that a diarization cuts.

Segments may overlap and be many, so counts, means and deviations come from a table of the moments of aligned runs of frames (nodes): a
segment is a few lookups a level, however long it is. Only state machines (pauses, tremor) walk a segment's frames.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators import features as X
from pulseframe.operators import speech
from pulseframe.operators.signals import ordered
from pulseframe.operators.tremor import RESULTS, Settings, parsed_results, result_line, tremor


def _level(length: Column, block: int) -> Column:
    """One more than the highest level of which a run of frames holds a whole node, by floating-point logarithms one that is never too low."""
    return (F.floor(F.log(length) / math.log(block)) + 1).cast("int")


def node_moments(frames: DataFrame, sizes: DataFrame, values: Sequence[str], block: int = 4) -> DataFrame:
    """(session_id, level, k, and for each value the count n, the sum s, the sum of squares q off their own mean, and the numbers of infinities u and d) of the frames from k * block ** level on, block ** level of them.

    frames(session_id, idx, values) of the sessions in sizes(session_id, size) are numbered from 0 without gaps; nulls and NaN do not count.
    Infinities are counted, but left out of sums.
    """
    levels = frames.join(sizes, "session_id").withColumn("level", F.explode(F.sequence(F.lit(0), _level(F.col("size"), block))))
    parts = []
    for v in values:
        x = F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double"))
        own = F.when(F.abs(x) < math.inf, x)
        parts += [F.count(x).alias(f"{v}_n"), F.coalesce(F.sum(own), F.lit(0.0)).alias(f"{v}_s"), F.coalesce(F.var_pop(own) * F.count(own), F.lit(0.0)).alias(f"{v}_q"), F.count_if(x == math.inf).alias(f"{v}_u"), F.count_if(x == -math.inf).alias(f"{v}_d")]
    return levels.groupBy("session_id", "level", F.floor(F.col("idx") / F.pow(F.lit(float(block)), "level")).alias("k")).agg(*parts)


def _covered(spans: DataFrame, block: int) -> DataFrame:
    """spans(session_id, a, b) with the fewest nodes (level, k) that cover the frames a..b-1, and the frame that each begins at: at most 2 * (block - 1) a level."""
    own = spans.withColumn("level", F.explode(F.sequence(F.lit(0), _level(F.col("b") - F.col("a"), block)))).withColumn("unit", F.pow(F.lit(float(block)), "level"))
    own = own.withColumn("first", F.ceil(F.col("a") / F.col("unit"))).withColumn("after", F.floor(F.col("b") / F.col("unit"))).filter("first < after")
    low, high = F.ceil(F.col("first") / block) * block, F.floor(F.col("after") / block) * block  # what lies between is covered by higher levels
    span = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<long>"))
    left, right = F.when(low < high, low).otherwise(F.col("after")), F.when(low < high, high).otherwise(F.col("after"))
    return own.select("session_id", "a", "b", "level", F.explode(F.concat(span(F.col("first"), left), span(right, F.col("after")))).alias("k"), "unit").withColumn("at", F.col("k") * F.col("unit")).drop("unit")


def segment_moments(frames: DataFrame, segments: DataFrame, values: Sequence[str], block: int = 4) -> DataFrame:
    """(segment_id, session_id, start, stop, and for each value _count, _mean, _std): of frames start..stop-1 of segments(segment_id, session_id, start, stop).

    Bounds beyond the session are cut to it. A segment without values has count 0 and nulls; the deviation of one value is null. Infinities
    make the mean of the segments that they are in infinite, NaN if there are both, and the deviation NaN. Moments of nodes are put together,
    which cancels no digits, however small the deviation is next to that of the session.
    """
    sizes = frames.groupBy("session_id").agg((F.max("idx") + 1).alias("size")).join(segments.select("session_id").distinct(), "session_id", "left_semi")
    inside = lambda c: F.when(F.col(c).isNotNull() & F.col("size").isNotNull(), F.least(F.greatest(c, F.lit(0)), "size"))
    cut = segments.select("segment_id", "session_id", "start", "stop").join(sizes, "session_id", "left").withColumn("a", inside("start")).withColumn("b", inside("stop"))
    nodes = node_moments(frames, sizes, values, block)
    names = [f"{v}_{k}" for v in values for k in "nsqud"]
    found = _covered(cut.filter("a < b").select("session_id", "a", "b").distinct(), block).join(nodes, ["session_id", "level", "k"])
    found = found.groupBy("session_id", "a", "b").agg(F.array_sort(F.collect_list(F.struct("at", *names))).alias("nodes"))
    for v in values:
        total = lambda k, zero: F.aggregate("nodes", zero, lambda done, node: done + node[f"{v}_{k}"])  # noqa: B023, E731
        found = found.withColumns({f"{v}_count": total("n", F.lit(0).cast("long")), "up": total("u", F.lit(0).cast("long")), "down": total("d", F.lit(0).cast("long"))})
        found = found.withColumn("mean", F.try_divide(total("s", F.lit(0.0)), F.col(f"{v}_count")))
        off = lambda node: F.try_divide(node[f"{v}_s"], node[f"{v}_n"]) - F.col("mean")  # noqa: B023, E731
        square = F.aggregate("nodes", F.lit(0.0), lambda done, node: done + node[f"{v}_q"] + F.coalesce(node[f"{v}_n"] * off(node) * off(node), F.lit(0.0)))  # noqa: B023
        infinite = F.when(F.col("up") > 0, F.lit(math.inf)).otherwise(0.0) + F.when(F.col("down") > 0, F.lit(-math.inf)).otherwise(0.0)
        spread = F.when(F.col("up") + F.col("down") > 0, F.lit(math.nan)).otherwise(F.sqrt(square / (F.col(f"{v}_count") - 1)))
        found = found.withColumns({f"{v}_std": F.when(F.col(f"{v}_count") > 1, spread), f"{v}_mean": F.when(F.col("up") + F.col("down") > 0, infinite).otherwise(F.col("mean"))})
    out = [c for v in values for c in (F.coalesce(f"{v}_count", F.lit(0)).cast("long").alias(f"{v}_count"), F.col(f"{v}_mean"), F.col(f"{v}_std"))]
    return cut.join(found, ["session_id", "a", "b"], "left").select("segment_id", "session_id", "start", "stop", *out)


def sliced(frames: DataFrame, segments: DataFrame, *columns: str) -> DataFrame:
    """(session_id, idx, columns): the frames of each segment as a session of its own, numbered by segment_id, idx from 0."""
    span = segments.filter("start < stop").select("segment_id", "session_id", "start", F.explode(F.sequence(F.col("start").cast("long"), F.col("stop").cast("long") - 1)).alias("idx"))
    joined = span.join(frames.select("session_id", "idx", *columns), ["session_id", "idx"])
    return joined.select(F.col("segment_id").alias("session_id"), (F.col("idx") - F.col("start")).cast("long").alias("idx"), *columns)


def voiced_runs(frames: DataFrame, voiced: Column) -> DataFrame:
    """The voiced rows of frames(session_id, idx, ...) with run, first_idx and last_idx of the unbroken run that they are in, runs numbered from 0."""
    hit = frames.filter(voiced).withColumn("_g", F.col("idx") - F.row_number().over(ordered()))
    runs = hit.groupBy("session_id", "_g").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    runs = runs.withColumn("run", (F.row_number().over(Window.partitionBy("session_id").orderBy("first_idx")) - 1).cast("long"))
    return hit.join(runs, ["session_id", "_g"]).drop("_g")


def acoustic(frames: DataFrame, voiced: Column, period: tuple[str, float, float] = ("period", 0.0001, 0.02), amplitude: str = "amplitude", noise: str = "gne") -> dict[str, DataFrame]:
    """Jitter, shimmer and glottal noise of each voiced run of frames(session_id, idx, period, amplitude, noise): three tables
    (session_id, run, first_idx, last_idx, value) from the same runs. A recording without a voiced frame has no rows.
    """
    runs = voiced_runs(frames, voiced)
    keys = ["session_id", "run", "first_idx", "last_idx"]
    column, low, high = period
    return {
        "df_jitter": X.perturbation(runs, keys, "idx", column, low, high, 1.3).withColumnRenamed("perturbation", "aco_jitter"),
        "df_shimmer": X.perturbation(runs, keys, "idx", amplitude, 0.0, float("inf"), 1.6).withColumnRenamed("perturbation", "aco_shimmer"),
        "df_gne": X.noise_excitation(runs, keys, noise).withColumnRenamed("gne", "aco_gne"),
    }


def segmented(frames: DataFrame, segments: DataFrame, frame_s: float, settings: Settings | None = None, least_s: float = 0.064, least_tremor_s: float = 0.5) -> dict[str, DataFrame]:
    """Pauses, voice prevalence and vocal tremor of every segment(segment_id, session_id, start, stop in frames) of frames(session_id, idx, speech, pitch, amplitude).

    Three tables (segment_id, start, stop, length in seconds, values, error): errors are data. Voice prevalence comes from moments
    of nodes; pauses and tremor restart their state in each segment. Segments with the same frames are measured once, under the least
    of their ids, so that the work grows with the different ones.
    """
    settings = settings or Settings(step=frame_s)
    alike = Window.partitionBy("session_id", "start", "stop")
    own = segments.select("segment_id", "session_id", "start", "stop").withColumn("id", F.min("segment_id").over(alike))
    who = own.select("segment_id", "start", "stop", ((F.col("stop") - F.col("start")) * frame_s).alias("length"), "id")
    segments = own.filter(F.col("segment_id") == F.col("id")).drop("id")
    lasting = segments.select(F.col("segment_id").alias("session_id"), ((F.col("stop") - F.col("start")) * frame_s).alias("duration"))

    def table(results: DataFrame, least: float) -> DataFrame:
        return who.join(speech.guarded(lasting, results, least).withColumnRenamed("session_id", "id"), "id").drop("id")

    own = sliced(frames, segments, "speech", "pitch", "amplitude")
    pauses = speech.silence(own.select("session_id", "idx", "speech"), frame_s)
    names = {"total": "aco_totaltime", "speaking": "aco_speakingtime", "n_pauses": "aco_numpauses", "pause_time": "aco_pausetime", "pause_fraction": "aco_pausefrac"}
    moments = segment_moments(frames.select("session_id", "idx", F.when(F.col("speech"), 1.0).otherwise(0.0).alias("voiced")), segments, ["voiced"])
    voice = moments.select(F.col("segment_id").alias("session_id"), (F.col("voiced_mean") * 100).alias("aco_voicepct"))
    line = result_line(*(tremor(own.select("session_id", "idx", F.col(c).alias("value")), settings) for c in ("pitch", "amplitude")))
    return {
        "df_pause_segment": table(pauses.select("session_id", *(F.col(c).alias(n) for c, n in names.items())), least_s),
        "df_vfs": table(voice.filter("aco_voicepct is not null"), least_s),
        "df_vt": table(parsed_results(line).select("session_id", *(name for _, name, _ in RESULTS)), least_tremor_s),
    }


def extract_features(
    voice: tuple[DataFrame, Column] | None = None, blinks: tuple[DataFrame, DataFrame] | None = None, diarized: tuple[DataFrame, DataFrame, float] | None = None
) -> dict[str, DataFrame]:
    """The raw tables, by name, of what is given: voice(frames, voiced) gives three, blinks(videos, blinks) one, diarized(frames, segments, seconds a frame) three."""
    out: dict[str, DataFrame] = {}
    if voice is not None:
        out |= acoustic(*voice)
    if blinks is not None:
        out["df_eyeblink"] = X.blink_vector(*blinks)
    if diarized is not None:
        out |= segmented(*diarized)
    return out
