"""WAV files as a Spark data source: long files are read by byte ranges in many tasks, and segments are written with commit and abort.

    spark.dataSource.register(WavSource)
    spark.read.format("wav").load("file:///recordings")        # path, fs, channel, idx, value
    segments.write.format("wav").option("fs", 8000).mode("append").save("file:///segments")

Paths are URIs of any store that pyarrow opens and all executors reach. Files of one folder are all listed by the driver. Where they are
too many for that, the option folders of a write puts them into folders of bounded size, of which the driver sees names only; a slash in
a segment's name is %2F there.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

READ = "path string, fs int, channel int, idx long, value int"
_RANGE, _BATCH = 16 << 20, 1 << 18
_FILES, _BYTES = 1000, 16 << 20  # a folder of the sink is closed at either
_HIDDEN, _FOLDER = re.compile(r"\.[0-9a-f]{32}"), re.compile(r"[0-9a-f]{32}-\d+-(\d+)")


@dataclass
class Spans(InputPartition):
    """Byte ranges (path, first, after) for one task; a frame belongs to the range that its first byte is in. The bytes of a folder of the sink are those of its files, in order of their names."""

    store: str
    spans: list[tuple[str, int, int]]


@dataclass
class Layout:
    """What a file's header says: where its samples are and how they lie."""

    fs: int
    channels: int
    width: int
    data: int
    size: int


def layout(source: pa.NativeFile) -> Layout | None:
    """The layout of a PCM file; None for any other file."""
    head = source.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    form = None
    while len(head := source.read(8)) == 8:
        name, size = struct.unpack("<4sI", head)
        if name == b"data":
            return None if form is None else Layout(*form, source.tell(), min(size, source.size() - source.tell()))
        body = source.read(size + size % 2)
        if name == b"fmt " and len(body) >= 16:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            form = (rate, channels, bits // 8) if kind == 1 and channels else None
    return None


class WavReader(DataSourceReader):
    """Files under a path, 16-bit PCM ones in ranges; others have no rows."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.range = options["path"], int(options.get("range", _RANGE))

    def partitions(self) -> list[Spans]:
        """Long files are cut; short ones share a task, up to a range's bytes. The sink's folders are not listed here, but in the tasks."""
        store, base = stores.FileSystem.from_uri(self.path)
        out: list[Spans] = []
        room = 0
        for path, size in sorted(_found(store, store.get_file_info(base))):
            for first in range(0, max(size, 1), self.range):
                span = (path, first, min(first + self.range, size))
                if room < span[2] - first or not out:
                    out.append(Spans(self.path, []))
                    room = self.range
                out[-1].spans.append(span)
                room -= span[2] - first
        return out

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        store, _ = stores.FileSystem.from_uri(partition.store)
        for place, begin, end in partition.spans:
            for path, first, after in _files(store, place, begin, end):
                with store.open_input_file(path) as source:
                    yield from _frames(source, path, first, after)


def _wav(f: stores.FileInfo) -> bool:
    return f.type == stores.FileType.File and f.base_name.lower().endswith(".wav")


def _found(store: stores.FileSystem, at: stores.FileInfo) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the WAV files, and of the sink's folders, at or below a place. What the sink has not committed is left out."""
    if at.type != stores.FileType.Directory:
        yield from [(at.path, at.size)] if _wav(at) else []
    elif own := _FOLDER.fullmatch(at.base_name):
        yield at.path, int(own[1])
    elif not _HIDDEN.fullmatch(at.base_name):
        for f in store.get_file_info(stores.FileSelector(at.path)):
            yield from _found(store, f)


def _files(store: stores.FileSystem, place: str, first: int, after: int) -> Iterator[tuple[str, int, int]]:
    """(path, first, after) of the files that a byte range of a file or of a folder of the sink lies in."""
    own = _FOLDER.fullmatch(place.rsplit("/", 1)[-1])
    if own is None:
        yield place, first, after
        return
    listed = sorted((f.path, f.size) for f in store.get_file_info(stores.FileSelector(place)) if _wav(f))
    if sum(size for _, size in listed) != int(own[1]):
        raise ValueError(f"the files of {place} are not those that were written")
    start = 0
    for path, size in listed:
        if start < after and first < start + size:
            yield path, max(first - start, 0), min(after - start, size)
        start += size


def _frames(source: pa.NativeFile, path: str, first_byte: int, after_byte: int) -> Iterator[pa.RecordBatch]:
    at = layout(source)
    if at is None or at.width != 2:
        return
    frame = 2 * at.channels
    frames = at.size // frame
    begin, end = (min(frames, max(0, -(-(edge - at.data) // frame))) for edge in (first_byte, after_byte))
    for first in range(begin, end, _BATCH):
        n = min(_BATCH, end - first)
        values = np.frombuffer(source.read_at(n * frame, at.data + first * frame), "<i2").astype(np.int32)
        rows = len(values)
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(path), rows), pa.repeat(pa.scalar(at.fs, pa.int32()), rows), pa.array(np.tile(np.arange(at.channels, dtype=np.int32), n)), pa.array(np.repeat(np.arange(first, first + n), at.channels)), pa.array(values)],
            names=["path", "fs", "channel", "idx", "value"],
        )


@dataclass
class Written(WriterCommitMessage):
    """The hidden folder of a task, and the bytes of each of the folders in it, which are numbered from 0 and hold at most _FILES files each."""

    folder: str
    sizes: list[int]


class WavWriter(DataSourceArrowWriter):
    """A mono 16-bit file for each name; rows(name, n, idx, value) come by name and idx, a name in one task."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.fs, self.folders = options["path"], int(options["fs"]), options.get("folders", "false").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = stores.FileSystem.from_uri(self.path)
        out = Written(f"{base}/.{uuid.uuid4().hex}", [])
        store.create_dir(out.folder, recursive=True)
        current, sink, files = None, None, 0
        try:
            for batch in iterator:
                names, values = batch.column("name"), batch.column("value").cast(pa.int16())
                for name, first, n in _runs(names):
                    if name != current:
                        if sink is not None:
                            sink.close()
                        current = name
                        if not out.sizes or files == _FILES or out.sizes[-1] >= _BYTES:
                            store.create_dir(f"{out.folder}/{len(out.sizes)}")
                            out.sizes.append(0)
                            files = 0
                        file = name.replace("/", "%2F") if self.folders else quote(name, safe="")
                        sink = store.open_output_stream(f"{out.folder}/{len(out.sizes) - 1}/{file}.wav")
                        sink.write(header(batch.column("n")[first].as_py(), self.fs))
                        files += 1
                        out.sizes[-1] += _HEADER
                    sink.write(np.asarray(values.slice(first, n)).astype("<i2").tobytes())
                    out.sizes[-1] += 2 * n
        except BaseException:
            _dropped(store, out.folder)
            raise
        finally:
            if sink is not None:
                sink.close()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        """With folders, whole ones get their names where the store has folders; files are moved one by one elsewhere, and to the path itself."""
        store, base = stores.FileSystem.from_uri(self.path)
        for message in filter(None, messages):
            for k, size in enumerate(message.sizes):
                hidden, name = f"{message.folder}/{k}", f"{base}/{message.folder[-32:]}-{k}-{size}"
                if self.folders and store.type_name in ("local", "hdfs"):
                    store.move(hidden, name)
                    continue
                if self.folders:
                    store.create_dir(name)
                for found in store.get_file_info(stores.FileSelector(hidden)):
                    store.move(found.path, f"{name}/{found.base_name}" if self.folders else f"{base}/{unquote(found.base_name)}")
            _dropped(store, message.folder)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = stores.FileSystem.from_uri(self.path)
        for message in filter(None, messages):
            _dropped(store, message.folder)


def _dropped(store: stores.FileSystem, path: str) -> None:
    if store.get_file_info(path).type == stores.FileType.Directory:
        store.delete_dir(path)


def _runs(names: pa.Array) -> Iterator[tuple[str, int, int]]:
    """(name, first row, rows) of the runs of equal names."""
    listed = names.to_pylist()
    first = 0
    for k in range(1, len(listed) + 1):
        if k == len(listed) or listed[k] != listed[first]:
            yield listed[first], first, k - first
            first = k


_HEADER = 44


def header(n: int, fs: int) -> bytes:
    """The 44 bytes in front of n mono 16-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * n, b"WAVE", b"fmt ", 16, 1, 1, fs, 2 * fs, 2, 16, b"data", 2 * n)


class WavSource(DataSource):
    """Format "wav": options path (of load or save), range (bytes of a read task), fs and folders (of a write)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        if overwrite:
            raise ValueError("WAV files can be appended only")
        return WavWriter(self.options)


def write_segments(cut: DataFrame, prefix: str, path: str, fs: int, folders: bool = False) -> None:
    """Writes cut(session_id, segment, idx from 0, value), as sources.wav.cut gives it, as <prefix>_<session>_seg_<segment>.wav files under a URI, all in one folder or in several.

    Values are rounded half away from zero and held in 16 bits. A segment is sorted in one task and streamed to its file; files
    appear under their names only when all tasks have ended, and not at all if one fails for good.
    """
    spark = cut.sparkSession
    spark.dataSource.register(WavSource)
    held = F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round("value").cast("long"))).cast("int")
    name = F.concat_ws("_", F.lit(prefix), F.col("session_id").cast("string"), F.lit("seg"), F.col("segment").cast("string"))
    rows = cut.select(name.alias("name"), F.col("idx").cast("long").alias("idx"), held.alias("value"))
    counted = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name")))
    counted.select("name", "n", "idx", "value").repartition("name").sortWithinPartitions("name", "idx").write.format("wav").option("fs", fs).option("folders", folders).mode("append").save(path)


def read_wav(spark, path: str, range_bytes: int = _RANGE) -> DataFrame:  # noqa: ANN001
    """READ, a row for each sample of each channel of the 16-bit files under a URI."""
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").option("range", range_bytes).load(path)
