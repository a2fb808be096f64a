"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of `width` consecutive item words (a shorter item is one pattern of its own length). Patterns of equal
length m are searched together. The last two words of a search window, its block, index a shift table: how far the window may
move without passing an occurrence. Where the shift is 0, the block's bucket lists the patterns that end in it; the window's
word hashes select among them, and direct comparison of the bytes confirms.

All texts of a chunk are searched at once: each run of words has a cursor and every step moves all cursors by their shifts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm import vectext as V
from pulseframe.llm.scratch import in_small_batches, written

#: Bytes of benchmark text whose tables one task holds at a time; a larger benchmark is searched in so many blocks.
BLOCK_BYTES = 16 << 20
_RUN = 64  # words a cursor covers


@dataclass
class Patterns:
    """The patterns of one length m, with the tables to find them."""

    m: int
    words: np.ndarray  # (patterns, m) word hashes, sorted by bucket
    text: list[bytes]
    items: list[list[int]]  # the items, as indexes into Tables.ids, of each pattern
    shift: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # first pattern of each bucket
    bits: int = 0


@dataclass
class Tables:
    ids: list[int]
    by_length: list[Patterns]


def _block(words: np.ndarray, at: np.ndarray, m: int, bits: int) -> np.ndarray:
    """Index of the block of words that ends at each position."""
    last = words[at]
    if m > 1:
        last = last * np.uint64(3) + words[at - 1] * np.uint64(0x9E3779B97F4A7C15)
    return (V.mix(last) >> np.uint64(64 - bits)).astype(np.int64)


def build(items: list[tuple[int, str]], width: int) -> Tables:
    """Tables of the items (id, text); items without words have no pattern."""
    ids = sorted({i for i, _ in items})
    index = {i: k for k, i in enumerate(ids)}
    found: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        data = V.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        starts, ends, _ = V.word_spans(data, np.array([0, len(data)]), V.NOT_ALNUM)
        raw = data.tobytes()
        words = [raw[s:e] for s, e in zip(starts, ends, strict=True)]
        m = min(width, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            found[m][b" ".join(words[k : k + m])].add(index[item])
    tables = []
    for m, patterns in sorted(found.items()):
        text = sorted(patterns)
        flat = [w for t in text for w in t.split(b" ")]
        ends = np.cumsum([len(w) for w in flat])
        hashes = V.span_hashes(np.frombuffer(b"".join(flat), np.uint8), ends - [len(w) for w in flat], ends).reshape(-1, m)
        bits = max(12, min(24, int(np.log2(len(text) * m + 1)) + 5))
        last = np.array([_block(row, np.array([m - 1]), m, bits)[0] for row in hashes])
        order = np.argsort(last, kind="stable")
        size = min(2, m)
        shift = np.full(1 << bits, m - size + 1, np.uint8 if m < 256 else np.int64)
        for at in range(size - 1, m):
            blocks = _block(hashes.ravel(), np.arange(len(text)) * m + at, m, bits)
            np.minimum.at(shift, blocks, m - 1 - at)
        tables.append(
            Patterns(m, hashes[order], [text[k] for k in order], [sorted(patterns[text[k]]) for k in order], shift, np.searchsorted(last[order], np.arange((1 << bits) + 1)), bits)
        )
    return Tables(ids, tables)


def _candidates(words: np.ndarray, firsts: np.ndarray, p: Patterns) -> np.ndarray:
    """Last positions of windows whose shift is 0, in all rows."""
    lengths = np.diff(firsts)
    runs = np.where(lengths >= p.m, (lengths - p.m) // _RUN + 1, 0)
    row = np.repeat(np.arange(len(lengths)), runs)
    number = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = firsts[row] + p.m - 1 + number * _RUN
    stop = np.minimum(at + _RUN, firsts[row + 1])
    out = []
    while len(at):
        step = p.shift[_block(words, at, p.m, p.bits)].astype(np.int64)
        hit = step == 0
        if hit.any():
            out.append(at[hit])
        at = at + np.maximum(step, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def occurrences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(last word, pattern) of every occurrence."""
    words = V.span_hashes(data, starts, ends)
    at = _candidates(words, firsts, p)
    if not len(at):
        return at, at
    bucket = _block(words, at, p.m, p.bits)
    size = p.heads[bucket + 1] - p.heads[bucket]
    which = np.repeat(np.arange(len(at)), size)
    pattern = np.repeat(p.heads[bucket] - np.cumsum(size) + size, size) + np.arange(len(which))
    for k in range(p.m):  # prefix word first, as most candidates differ there
        same = words[at[which] - p.m + 1 + k] == p.words[pattern, k]
        which, pattern = which[same], pattern[same]
    last = at[which]
    raw = data
    keep = np.zeros(len(last), bool)
    for i, (e, k) in enumerate(zip(last, pattern, strict=True)):
        spans = range(e - p.m + 1, e + 1)
        keep[i] = b" ".join(raw[starts[j] : ends[j]].tobytes() for j in spans) == p.text[k]
    return last[keep], pattern[keep]


def _search(batch: pa.RecordBatch, tables: Tables) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[set[int]]]]:
    """For each chunk: (first row, rows, word counts, a flag for each word, item indexes of each row), with the rows' first words in between."""
    for first, data, offsets in V.chunks(batch.column("text")):
        data = V.LOWER[data]
        starts, ends, firsts = V.word_spans(data, offsets, V.NOT_ALNUM)
        covered = np.zeros(len(starts) + 1, np.int32)
        items: list[set[int]] = [set() for _ in range(len(offsets) - 1)]
        for p in tables.by_length:
            last, pattern = occurrences(data, starts, ends, firsts, p)
            np.add.at(covered, last - p.m + 1, 1)
            np.add.at(covered, last + 1, -1)
            for row, k in set(zip((np.searchsorted(firsts, last, side="right") - 1).tolist(), pattern.tolist(), strict=True)):
                items[row].update(p.items[k])
        yield first, firsts, np.cumsum(covered)[:-1] > 0, items


def _verdicts(batches: Iterator[pa.RecordBatch], shared: object) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, hits (one bit a word, empty if none) and item_ids of each row, with the other columns as they are."""
    tables = shared.value
    for batch in batches:
        others = [n for n in batch.schema.names if n != "text"]
        for first, firsts, hit, items in _search(batch, tables):
            rows = batch.slice(first, len(items))
            bits = [np.packbits(own).tobytes() if (own := hit[firsts[i] : firsts[i + 1]]).any() else b"" for i in range(len(items))]
            found = [[tables.ids[k] for k in sorted(own)] for own in items]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(n) for n in others), pa.array(np.diff(firsts)), pa.array(np.add.reduceat(np.append(hit, False), firsts[:-1]) * (np.diff(firsts) > 0)), pa.array(bits, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=[*others, "n_words", "n_hit", "hits", "item_ids"],
            )


def _popcount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the blocks' findings of a document: bits are or-ed, items united."""
    for batch in batches:
        hits, ids = [], []
        for maps, lists in zip(batch.column("maps").to_pylist(), batch.column("lists").to_pylist(), strict=True):
            full = [np.frombuffer(m, np.uint8) for m in maps if m]
            hits.append(int(np.unpackbits(np.bitwise_or.reduce(full)).sum()) if full else 0)
            ids.append(sorted({i for own in lists for i in own}))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "n_words", "n_hit", "item_ids"])


def _blocks(benchmark: DataFrame, width: int, block_bytes: int) -> list[object]:
    """The broadcast tables of the benchmark's blocks, one unless it is larger than block_bytes."""
    spark = benchmark.sparkSession
    bench = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    total = int(bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    n = max(1, -(-total // block_bytes))
    bench = bench if n == 1 else written(bench, "benchmark")
    return [spark.sparkContext.broadcast(build([(r.item_id, r.text) for r in bench.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).toLocalIterator()], width)) for k in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids): words of each document inside an occurrence of a benchmark window, and the items found, ascending.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. Null and empty texts have no words. Items with a null
    id or without words have no window. Repeated rows are judged alike, one result row each. An empty benchmark hits nothing. Very
    long texts are searched whole, in pieces of bounded size; other columns are ignored.

    The tables that a task holds are those of at most `block_bytes` of benchmark text, whose size is checked first. A larger
    benchmark is cut by hash into blocks; each is searched against all documents, and a document's findings are joined by
    an aggregate on (doc_id, hash of the text).
    """
    blocks = _blocks(benchmark, width, block_bytes)

    def searched(rows: DataFrame, block: object, keep: list[str]) -> DataFrame:
        schema = ", ".join([f"{n} long" for n in keep] + ["n_words long", "n_hit long", "hits binary", "item_ids array<long>"])
        return rows.select(*keep, "text").mapInArrow(partial(_verdicts, shared=block), schema)

    if len(blocks) == 1:
        return searched(docs, blocks[0], ["doc_id"]).select("doc_id", "n_words", "n_hit", "item_ids")
    key = ["doc_id", "t1", "t2"]
    keyed = in_small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    every = reduce(DataFrame.unionByName, (searched(keyed, block, key) for block in blocks))
    merged = every.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.collect_set("hits").alias("maps"), F.collect_list("item_ids").alias("lists"), (F.count(F.lit(1)) / len(blocks)).cast("long").alias("copies"))
    merged = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_words", "maps", "lists")
    return merged.mapInArrow(_popcount, "doc_id long, n_words long, n_hit long, item_ids array<long>")


def _clean(batches: Iterator[pa.RecordBatch], shared: object) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = [bool(items) for _, _, _, rows in _search(batch, shared.value) for items in rows]
        yield batch.filter(pa.array([not h for h in hit], pa.bool_()))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in whose text no benchmark window occurs, all columns unchanged; each block of the benchmark filters in turn, without a shuffle.

    Null and empty texts stay, as does everything where the benchmark is empty. Repeated rows stay or go together. docs may have any
    further columns, of any names. Very long texts are searched whole, in pieces of bounded size.
    """
    docs = in_small_batches(docs)
    for block in _blocks(benchmark, width, block_bytes):
        docs = docs.mapInArrow(partial(_clean, shared=block), docs.schema)
    return docs
