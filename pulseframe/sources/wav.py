"""WAV files as a source and a sink, and the segments of a recording.

Files come in as Spark's binaryFile rows (path, content), or any other frame with these columns, and are decoded in their tasks, a bounded number of samples at a time.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATES = (8000, 16000, 32000, 48000)
INFO = "path string, fs int, channels int, width int, n long, error string"
FRAMES = "path string, fs int, channel int, idx long, value int"
_CHUNK = 1 << 16


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, content) of the WAV files below a path or under a pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(pattern).select("path", "content")


def _opened(content: bytes | None) -> tuple[wave.Wave_read | None, str | None]:
    try:
        return wave.open(io.BytesIO(content or b""), "rb"), None
    except (EOFError, wave.Error) as why:
        return None, f"not a PCM WAV file: {why}"


def info(found: DataFrame) -> DataFrame:
    """INFO, a row a file; a file that is no PCM WAV has nulls and says so in error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                f, error = _opened(content)
                rows.append((path, None, None, None, None, error) if f is None else (path, f.getframerate(), f.getnchannels(), f.getsampwidth(), f.getnframes(), None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INFO.split(", ")]).astype({"fs": "Int32", "channels": "Int32", "width": "Int32", "n": "Int64"})

    return found.select("path", "content").mapInPandas(run, INFO)


def checked(facts: DataFrame) -> DataFrame:
    """info rows with error also for files that are not mono, 16 bit and of one of the four rates that voice activity models take."""
    rate = F.col("fs").isin(*RATES)
    wrong = F.when(F.col("channels") != 1, "not mono").when(F.col("width") != 2, "not 16 bit").when(~rate, "unsupported rate")
    return facts.withColumn("error", F.coalesce("error", wrong))


def frames(found: DataFrame) -> DataFrame:
    """FRAMES, a row for each sample of each channel of the 16-bit files; others have no rows (see info)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                f, _ = _opened(content)
                if f is None or f.getsampwidth() != 2:
                    continue
                k, at = f.getnchannels(), 0
                while raw := f.readframes(_CHUNK):
                    values = np.frombuffer(raw[: len(raw) // (2 * k) * 2 * k], "<i2").astype(np.int32)
                    n = len(values) // k
                    yield pd.DataFrame({"path": path, "fs": np.int32(f.getframerate()), "channel": np.tile(np.arange(k, dtype=np.int32), n), "idx": np.repeat(np.arange(at, at + n), k), "value": values})
                    at += n

    return found.select("path", "content").mapInPandas(run, FRAMES)


def timed(samples: DataFrame) -> DataFrame:
    """frames rows with t, their time in seconds, half to even at 10 decimals."""
    return samples.withColumn("t", F.bround(F.col("idx") / F.col("fs"), 10))


def to_mono(samples: DataFrame) -> DataFrame:
    """(path, fs, idx, value): the mean of a frame's channels, rounded down."""
    return samples.groupBy("path", "fs", "idx").agg(F.floor(F.avg("value")).cast("int").alias("value"))


def encoded(samples: DataFrame, fs: int) -> DataFrame:
    """(session_id, content): a mono 16-bit WAV file of each session of samples(session_id, idx, value), values rounded half away from zero and held in range. A session must fit a task."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(fs)
            f.writeframes(own.sort_values("idx")["value"].to_numpy("<i2").tobytes())
        return pd.DataFrame({"session_id": [own["session_id"].iloc[0]], "content": [out.getvalue()]})

    held = F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round("value").cast("long"))).cast("int")
    return samples.select("session_id", "idx", held.alias("value")).groupBy("session_id").applyInPandas(one, "session_id long, content binary")


def cut(samples: DataFrame, segments: DataFrame, fs: int) -> DataFrame:
    """(session_id, segment, start, stop, idx, value) of segments(session_id, segment, start, stop in seconds), idx from 0 in each.

    A segment without a stop goes to the recording's end, which also bounds the others. Times are whole samples, rounded down. The
    samples of a segment are found by second, an equi-join, so a long recording is not gathered.
    """
    ends = samples.groupBy("session_id").agg(((F.max("idx") + 1) / fs).alias("end"))
    own = segments.join(ends, "session_id").withColumn("stop", F.coalesce("stop", "end"))
    first = F.floor(F.round(F.col("start") * fs, 6))
    after = F.floor(F.round(F.least("stop", "end") * fs, 6))
    own = own.select("session_id", "segment", "start", "stop", first.alias("first"), after.alias("after")).filter("first < after")
    spans = own.withColumn("second", F.explode(F.sequence(F.floor(F.col("first") / fs), F.floor((F.col("after") - 1) / fs))))
    rows = samples.select("session_id", F.floor(F.col("idx") / fs).alias("second"), F.col("idx").alias("at"), "value")
    return spans.join(rows, ["session_id", "second"]).filter("at >= first and at < after").select("session_id", "segment", "start", "stop", (F.col("at") - F.col("first")).alias("idx"), "value")
