"""Token-ID output in training order.

Texts become sequences of at most `length` token ids. A keyed Feistel network permutes 0..N-1, walking its cycles until the
number is below N, and so gives every sequence one global slot; slot div per_shard is its shard. One exchange deals slots to
shards, ranges of exactly per_shard slots, each is sorted, and a shard file holds fixed-stride records: the record of slot s
starts at byte (s mod per_shard) * stride, so a reader resumes anywhere by arithmetic. Tokens wait in a
table packed page by page, and shards are dealt in a few waves, so that one wave at a time is in exchange files beside that table and the shards.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.scratch import new_path, parallelism, written

#: The pre-tokenisation pattern that belongs to the byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256  # free in that vocabulary: ends a document, and pads the records' rest
LENGTH, PER_SHARD = 1024, 8192
_ROUNDS = 6
_WAVES = 4
_CODEC = "zstd"
_ROWS = "slot long, shard int, offset long, doc_id long, chunk int, n_tokens int, tokens binary"


@lru_cache(maxsize=1)
def _encoding(vocabulary: str):  # noqa: ANN202
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tokenised(batches: Iterator[pa.RecordBatch], vocabulary: str, length: int) -> Iterator[pa.RecordBatch]:
    encoding, part, k = _encoding(vocabulary), TaskContext.get().partitionId(), 0
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            rows = batch.slice(first, 256)
            ids, chunks, sizes, blobs = [], [], [], []
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text"), strict=True):
                tokens = np.array([*encoding.encode_ordinary(text.as_py() or ""), END], np.uint16)
                for c, at in enumerate(range(0, len(tokens), length)):
                    own = tokens[at : at + length]
                    ids.append(doc_id)
                    chunks.append(c)
                    sizes.append(len(own))
                    blobs.append(own.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(chunks, pa.int32()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary()), pa.array([part] * len(ids), pa.int32()), pa.array(range(k, k + len(ids)), pa.int64())],
                names=["doc_id", "chunk", "n_tokens", "tokens", "part", "k"],
            )
            k += len(ids)


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of 0..n-1 at each index: a balanced Feistel network on the next even number of bits, cycle-walked."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 1 << 63, _ROUNDS, dtype=np.uint64)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        x = (left << np.uint64(half)) | right
        out[todo] = x
        todo = todo[x >= n]
    return out.astype(np.int64)


def _slotted(batches: Iterator[pa.RecordBatch], offsets: dict[int, int], n: int, key: int, per_shard: int, stride: int, first: int, after: int) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec(_CODEC)
    for batch in batches:
        if not batch.num_rows:
            continue
        start = np.array([offsets[p] for p in batch.column("part").to_pylist()], np.int64)
        slot = permute(start + np.asarray(batch.column("k")), n, key)
        shard, at = slot // per_shard, slot % per_shard
        own = pa.array((shard >= first) & (shard < after))
        kept = pa.RecordBatch.from_arrays([pa.array(slot), pa.array(shard.astype(np.int32)), pa.array(at * stride), *(batch.column(c) for c in ("doc_id", "chunk", "n_tokens", "tokens"))], names=["slot", "shard", "offset", "doc_id", "chunk", "n_tokens", "tokens"]).filter(own)
        blobs = [codec.compress(blob.as_buffer(), asbytes=True) for blob in kept.column("tokens")]
        yield kept.set_column(kept.schema.get_field_index("tokens"), "tokens", pa.array(blobs, pa.binary()))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec(_CODEC)
    for batch in batches:
        blobs = [codec.decompress(blob.as_buffer(), 2 * n, asbytes=True) for blob, n in zip(batch.column("tokens"), batch.column("n_tokens").to_pylist(), strict=True)]
        yield batch.set_column(batch.schema.get_field_index("tokens"), "tokens", pa.array(blobs, pa.binary()))


def _in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges of (doc_id, text hash), sorted. Rows that tie in both are equal, so whichever way their place splits them, the result is one."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "h", "place"]
    return keyed.repartitionByRange(max(2, parallelism(docs.sparkSession)), *order).sortWithinPartitions(*order).select("doc_id", "text")


def _orders(docs: DataFrame, vocabulary: str, length: int, per_shard: int, key: int, waves: int) -> Iterator[DataFrame]:
    """training_order's rows, tokens still packed, in at most `waves` frames, each of a range of shards."""
    table = written(_in_order(docs).mapInArrow(partial(_tokenised, vocabulary=vocabulary, length=length), "doc_id long, chunk int, n_tokens int, tokens binary, part int, k long"), "tokens", codec=_CODEC)
    counts = {r.part: r.n for r in table.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, n = {}, 0
    for part in sorted(counts):
        offsets[part] = n
        n += counts[part]
    shards = max(1, -(-n // per_shard))
    step = -(-shards // waves)
    for first in range(0, shards, step):
        after = min(shards, first + step)
        dealt = table.mapInArrow(partial(_slotted, offsets=offsets, n=n, key=key, per_shard=per_shard, stride=2 * length, first=first, after=after), _ROWS)
        yield dealt.repartitionById(after - first, F.col("shard") - first).sortWithinPartitions("slot")


def training_order(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = 20240607) -> DataFrame:
    """(slot, shard, offset, doc_id, chunk, n_tokens, tokens): every sequence of docs(doc_id, text), in partitions of one shard each, by slot.

    tokens are little-endian 16-bit ids; each document ends with the END id. Null and empty texts are one sequence of END
    alone. Repeated rows are sequences of their own. Before the permutation, sequences are numbered by (doc_id, text hash, chunk),
    null ids first, so the order depends on the rows and the key alone, not on the input's files, splits or order. Only one count
    for each range and no token comes to the driver. One text must fit a task.
    """
    return next(_orders(docs, vocabulary, length, per_shard, key, waves=1)).mapInArrow(_unpacked, _ROWS)


def _write(batches: Iterator[pa.RecordBatch], out: str, length: int, packed: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(out)
    current, sink, name = None, None, ""

    def close() -> None:
        if sink is not None:
            sink.close()
            store.move(name, f"{base}/shard-{current:06d}.bin")

    for batch in _unpacked(batches) if packed else batches:
        for shard, n, blob in zip(batch.column("shard").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("tokens"), strict=True):
            if shard != current:
                close()
                current, name = shard, f"{base}/.{uuid.uuid4().hex}"
                sink = store.open_output_stream(name)
            sink.write(blob.as_buffer().to_pybytes() + struct.pack("<H", END) * (length - n))
        yield batch.select(["slot", "shard", "doc_id", "chunk", "n_tokens"])
    close()


def _index(ordered: DataFrame, out: str, length: int, path: str, packed: bool) -> None:
    """Writes the shards of ordered rows, tokens packed or not, under `out` and appends (slot, shard, doc_id, chunk, n_tokens) of their records to the table `path`."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(out)
    store.create_dir(base, recursive=True)
    ordered.mapInArrow(partial(_write, out=out, length=length, packed=packed), _INDEX).write.mode("append").parquet(path)


_INDEX = "slot long, shard int, doc_id long, chunk int, n_tokens int"


def write_shards(ordered: DataFrame, out: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Writes training_order's rows as shard-NNNNNN.bin files under the URI `out` of a store that all executors share, and returns their manifest.

    A task writes under a temporary name and moves the whole shard, so a repeated task only replaces a shard by an equal one. Nulls, empty
    texts and repeats are sequences like others; without rows there are no files and the manifest is empty. Further columns are ignored.
    """
    path = new_path(ordered.sparkSession, "manifest")
    _index(ordered, out, length, path, packed=False)
    return ordered.sparkSession.read.schema(_INDEX).parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("records"), F.sum("n_tokens").alias("tokens"))


@contextmanager
def _exchange_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, exchange files go as soon as the action that made them has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _read(batches: Iterator[pa.RecordBatch], out: str, length: int, per_shard: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(out)
    current, source, stride = None, None, 2 * length
    for batch in batches:
        offsets, sizes, blobs = [], [], []
        for slot in batch.column("slot").to_pylist():
            shard, at = slot // per_shard, slot % per_shard * stride
            if shard != current:
                if source is not None:
                    source.close()
                current, source = shard, store.open_input_file(f"{base}/shard-{shard:06d}.bin")
            record = source.read_at(stride, at)
            if len(record) != stride:
                raise ValueError(f"shard {shard} ends before the record of slot {slot}")
            ends = np.flatnonzero(np.frombuffer(record, "<u2") == END)
            n = int(ends[0]) + 1 if len(ends) else length
            offsets.append(at)
            sizes.append(n)
            blobs.append(record[: 2 * n])
        yield pa.RecordBatch.from_arrays(
            [batch.column("slot"), batch.column("shard"), pa.array(offsets, pa.int64()), batch.column("doc_id"), batch.column("chunk"), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())],
            names=["slot", "shard", "offset", "doc_id", "chunk", "n_tokens", "tokens"],
        )
    if source is not None:
        source.close()


def stored_order(docs: DataFrame, out: str, vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = 20240607) -> DataFrame:
    """training_order's rows after all shards have been written under the URI `out`: offset, n_tokens and tokens as read back from the shard files.

    doc_id and chunk come from the index that is kept beside the shards. A record's tokens end at its first END, as no text has one.
    Null and empty texts are records of END alone, repeated rows records of their own, and an empty table gives an empty result. Further
    columns of docs are ignored. ids must be bigint.
    """
    spark = docs.sparkSession
    path = new_path(spark, "index")
    with _exchange_files_dropped(spark):
        for ordered in _orders(docs, vocabulary, length, per_shard, key, _WAVES):
            _index(ordered, out, length, path, packed=True)
    return spark.read.schema(_INDEX).parquet(path).mapInArrow(partial(_read, out=out, length=length, per_shard=per_shard), _ROWS)


def read_record(out: str, slot: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> np.ndarray:
    """The token ids of one slot, padding included: one seek and one read."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(out)
    with store.open_input_file(f"{base}/shard-{slot // per_shard:06d}.bin") as f:
        return np.frombuffer(f.read_at(2 * length, slot % per_shard * 2 * length), "<u2")
