"""The WAV data source: byte ranges, round trips, and nothing left of a failed write."""

from __future__ import annotations

import io
import os
import wave

import numpy as np
import pytest
from pulseframe.sources import wav_source
from pyspark.sql import functions as F


def stored(path, values, channels=1, fs=16000, width=2):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(fs)
        f.writeframes(np.asarray(values).astype("<i2").tobytes())


@pytest.mark.parametrize("range_bytes", [1 << 24, 1000, 37])
def test_ranges_give_every_sample_once(spark, tmp_path, range_bytes):
    rng = np.random.default_rng(1)
    one, two = rng.integers(-32768, 32768, 777), rng.integers(-32768, 32768, (301, 2))
    os.makedirs(tmp_path / "sub")
    stored(tmp_path / "one.wav", one)
    stored(tmp_path / "sub" / "two.wav", two.ravel(), channels=2, fs=8000)
    stored(tmp_path / "empty.wav", [])
    stored(tmp_path / "wide.wav", rng.integers(0, 99, 300), width=3)
    (tmp_path / "no.wav").write_bytes(b"RIFF, but no more")
    (tmp_path / "other.txt").write_bytes(b"text")
    df = wav_source.read_wav(spark, f"file://{tmp_path}", range_bytes)
    rows = df.collect()
    name = lambda r: r.path.rsplit("/", 1)[1]
    assert sorted((name(r), r.fs, r.channel, r.idx, r.value) for r in rows) == sorted([("one.wav", 16000, 0, i, int(v)) for i, v in enumerate(one)] + [("two.wav", 8000, c, i, int(two[i, c])) for i in range(301) for c in (0, 1)])
    if range_bytes == 37:
        assert df.rdd.getNumPartitions() > 50


def test_segments_are_written_and_read_back(spark, tmp_path):
    rows = [(s, k, i, float(1000 * s + 10 * k - i * 0.6)) for s in (1, 2) for k in (0, 1, 2) for i in range(5 + 40 * k)] + [(3, 0, 0, 1e9)]
    cut = spark.createDataFrame(rows, "session_id long, segment long, idx long, value double").repartition(5)
    wav_source.write_segments(cut, "subject", f"file://{tmp_path}/out", 8000)
    assert sorted(os.listdir(tmp_path / "out")) == sorted([f"subject_{s}_seg_{k}.wav" for s in (1, 2) for k in (0, 1, 2)] + ["subject_3_seg_0.wav"])
    with wave.open(str(tmp_path / "out" / "subject_2_seg_1.wav")) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.getframerate(), f.getnframes()) == (1, 2, 8000, 45)
    found = {(r.path.rsplit("/", 1)[1], r.idx): r.value for r in wav_source.read_wav(spark, f"file://{tmp_path}/out", 64).collect()}
    half = lambda v: int(np.floor(abs(v) + 0.5) * np.sign(v))
    assert found == {(f"subject_{s}_seg_{k}.wav", i): min(half(v), 32767) for s, k, i, v in rows}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(2000).select(F.lit(1).alias("session_id"), (F.col("id") % 3).alias("segment"), F.col("id").alias("idx"), F.when(F.col("id") == 1999, F.raise_error(F.lit("broken")).cast("double")).otherwise(1.0).alias("value"))
    with pytest.raises(Exception, match="broken"):
        wav_source.write_segments(bad, "x", f"file://{tmp_path}/out", 8000)
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []


def test_header():
    with wave.open(io.BytesIO(wav_source.header(3, 44100) + b"\1\0\2\0\3\0")) as f:
        assert (f.getframerate(), f.getnframes(), f.readframes(3)) == (44100, 3, b"\1\0\2\0\3\0")
