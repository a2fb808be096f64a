"""Voice activity on a stream equals the batch plans, however frames are split and ordered."""

from __future__ import annotations

import random

import pytest
from pulseframe.operators import speech
from pulseframe.streaming import voice

DUR = 0.02


def made(seed):
    rng = random.Random(seed)
    rows = []
    for session in range(6):
        speaking = False
        for i in range(rng.randrange(3, 120)):
            speaking = speaking if rng.random() < 0.85 else not speaking
            rows.append((session, i, speaking != (rng.random() < 0.03)))
    return rows


def streamed(spark, folder, rows, split, run):
    """The rows of a stream whose micro-batches are the files of `split`."""
    schema = "session_id long, idx long, ts timestamp, speech boolean"
    timed = [(s, i, f"2024-01-01 00:00:{i * DUR:09.6f}", v) for s, i, v in rows]
    for k, part in enumerate([*split(timed), [(99, 0, "2024-01-01 02:00:00", False)]]):
        own = spark.createDataFrame(part, "session_id long, idx long, ts string, speech boolean").selectExpr("session_id", "idx", "CAST(ts AS TIMESTAMP) AS ts", "speech")
        own.coalesce(1).write.mode("append").parquet(f"{folder}/in/k{k:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    name = f"voice_{abs(hash(folder)) % 10**9}"
    query = run(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return sorted(tuple(r) for r in spark.table(name).collect() if r.session_id != 99)


def shuffled_in_parts(rows):
    rng = random.Random(1)
    rows = list(rows)
    rng.shuffle(rows)
    n = len(rows) // 3 + 1
    return [rows[i : i + n] for i in range(0, len(rows), n)]


@pytest.mark.parametrize("split", [lambda rows: [rows], shuffled_in_parts], ids=["one batch", "shuffled parts"])
def test_segments(spark, tmp_path, split):
    rows = made(3)
    batch = speech.vad_segments(spark.createDataFrame(rows, "session_id long, idx long, speech boolean"), 4, DUR).collect()
    wanted = sorted((r.session_id, r.segment, round(r.start, 6), round(r.stop, 6)) for r in batch)
    found = streamed(spark, str(tmp_path), rows, split, lambda s: voice.vad_segments(s, 4, DUR, late="1 hour"))
    assert [(s, k, round(a, 6), round(b, 6)) for s, k, a, b in found] == wanted and wanted


def test_silence(spark, tmp_path):
    rows = made(5)
    batch = speech.silence(spark.createDataFrame(rows, "session_id long, idx long, speech boolean"), DUR, 6, 3).collect()
    found = streamed(spark, str(tmp_path), rows, shuffled_in_parts, lambda s: voice.silence(s, DUR, 6, 3, late="1 hour"))
    plain = lambda r: tuple(None if v is None else round(v, 6) for v in r)
    assert list(map(plain, found)) == sorted(map(plain, batch)) and found


def test_detector_leaves_gaps_behind():
    session = voice.Session([voice.Detector(2)], kept=[[]])
    session.waiting = {0: True, 1: True, 3: True, 5: False, 6: False}
    assert session.judge(everything=False) == [[]] and session.detectors[0].n == 2
    assert voice.Session.read(session.text()) == session
    assert session.judge(everything=True) == [[(0, 0, 4)]]
