"""Segments in folders of bounded size: the driver plans their reading by folder, whatever number of files they hold."""

from __future__ import annotations

import os
import pickle

import pyarrow as pa
import pytest
from pulseframe.plans import recordings
from pulseframe.sources import wav_source


def stored(path, files, **options):
    """Writes files, a dict of names and samples, as one task does."""
    writer = wav_source.WavWriter({"path": f"file://{path}", "fs": "8000", **options})
    rows = [(name, len(values), i, v) for name, values in sorted(files.items()) for i, v in enumerate(values)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["name", "n", "idx", "value"])
    writer.commit([writer.write(iter([batch])), None])


def read(path, range_bytes):
    reader = wav_source.WavReader({"path": f"file://{path}", "range": str(range_bytes)})
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    return parts, sorted((r["path"].rsplit("/", 1)[1], r["idx"], r["value"]) for r in rows)


def test_plans_do_not_grow_with_files(tmp_path):
    sizes = []
    for n in (20, 2000):
        files = {f"user_{k}_seg_{k % 7}": [k, -k] for k in range(n)}
        stored(tmp_path / str(n), files, folders="true")
        parts, rows = read(tmp_path / str(n), 1 << 24)
        assert rows == sorted((f"{name}.wav", i, v) for name, values in files.items() for i, v in enumerate(values))
        sizes.append(len(pickle.dumps(parts)))
    assert sizes[1] < 3 * sizes[0]


@pytest.mark.parametrize("range_bytes", [1 << 24, 100, 37])
def test_ranges_of_a_folder_give_every_sample_once(tmp_path, monkeypatch, range_bytes):
    monkeypatch.setattr(wav_source, "_FILES", 3)
    files = {f"a{k}": list(range(k * k)) for k in range(1, 9)} | {"b/c": [1], "d e%41": [2, 3]}
    stored(tmp_path, files, folders="true")
    assert len(os.listdir(tmp_path)) == 4
    parts, rows = read(tmp_path, range_bytes)
    assert rows == sorted((name.replace("/", "%2F") + ".wav", i, v) for name, values in files.items() for i, v in enumerate(values))
    assert (len(parts) > 4) == (range_bytes < 200)


def test_what_is_not_committed_is_not_read(tmp_path):
    stored(tmp_path, {"a": [1]}, folders="true")
    writer = wav_source.WavWriter({"path": f"file://{tmp_path}", "fs": "8000", "folders": "true"})
    batch = pa.RecordBatch.from_arrays([pa.array(["b"]), pa.array([1]), pa.array([0]), pa.array([7])], names=["name", "n", "idx", "value"])
    message = writer.write(iter([batch]))
    assert read(tmp_path, 100)[1] == [("a.wav", 0, 1)]
    writer.abort([message])
    assert len(os.listdir(tmp_path)) == 1


def test_a_folder_that_lacks_a_file_is_an_error(tmp_path):
    stored(tmp_path, {"a": [1], "b": [2]}, folders="true")
    os.remove(tmp_path / os.listdir(tmp_path)[0] / "b.wav")
    with pytest.raises(ValueError, match="not those that were written"):
        read(tmp_path, 100)


def test_the_query_writes_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recordings, "new_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    rows = recordings.i12_segment_files(spark, "/root/testdata/sf0.001").collect()
    folders = os.listdir(tmp_path / "segments")
    assert all(wav_source._FOLDER.fullmatch(f) for f in folders)
    assert {f for folder in folders for f in os.listdir(tmp_path / "segments" / folder)} == {r.name for r in rows}
