"""What a task of the WAV sink tells the driver does not grow with its files."""

from __future__ import annotations

import os
import pickle

import pyarrow as pa
from pulseframe.sources import wav_source


def test_messages_do_not_grow_with_files(tmp_path):
    sizes = []
    for n in (2, 2000):
        writer = wav_source.WavWriter({"path": f"file://{tmp_path}/{n}", "fs": "8000"})
        names = [f"user_{k}_seg_{k % 7}" for k in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array([1] * n), pa.array([0] * n), pa.array(list(range(n)))], names=["name", "n", "idx", "value"])
        message = writer.write(iter([batch]))
        assert [f for f in os.listdir(tmp_path / str(n)) if f.endswith(".wav")] == []
        sizes.append(len(pickle.dumps(message)))
        writer.commit([message, None])
        assert sorted(os.listdir(tmp_path / str(n))) == sorted(f"{name}.wav" for name in names)
    assert sizes[1] < sizes[0] + 20


def test_an_abort_leaves_nothing(tmp_path):
    writer = wav_source.WavWriter({"path": f"file://{tmp_path}", "fs": "8000"})
    batch = pa.RecordBatch.from_arrays([pa.array(["a/b", "c"]), pa.array([1, 1]), pa.array([0, 0]), pa.array([5, 6])], names=["name", "n", "idx", "value"])
    writer.abort([writer.write(iter([batch])), None])
    assert os.listdir(tmp_path) == []
