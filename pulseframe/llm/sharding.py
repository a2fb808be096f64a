"""Sharding by histogram sort: splitters are found by counting, then the rows are exchanged once.

The sort key is (xxhash64 of the text, doc_id), so equal texts are neighbours. Each round counts the exact bytes below
candidate boundaries (a map-side combined aggregate, a bounded number of bins for each open splitter) and refines only the
bins in which a wanted splitter still lies, until every splitter is within tolerance. First the bits of the hash are refined,
so groups of equal texts stay whole; only a group that is larger than the tolerance is cut, by doc_id.

Each shard is a run of finer ranges, as many in all as the session has shuffle partitions and one a task, so the exchange and
the sort are spread over the cluster and no task holds a shard. A row's slot is its number in its sorted range plus the rows of the
shard's ranges in front. Column expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.scratch import forget, parallelism, written

_BITS = 8  # bits of the key that a round refines at each open splitter
_FIRST = 14  # bits of the first round


@dataclass(frozen=True)
class Splitter:
    """Keys (hash, id) below it, as unsigned 64-bit numbers, belong to the ranges in front; `below` are their bytes."""

    hash: int
    id: int
    below: int


def _unsigned(value: int) -> int:
    return value + (1 << 63)


def _top(column: Column, bits: int) -> Column:
    """The first `bits` of a bigint in signed order, as a number from 0."""
    return F.shiftrightunsigned(column.bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits < 64 else column


def _bin(column: Column, done: int, bits: int) -> Column:
    """The `bits` that follow the first `done` bits of a bigint in signed order."""
    return F.shiftrightunsigned(column.bitwiseXOR(F.lit(-(1 << 63))), 64 - done - bits).bitwiseAND(F.lit((1 << bits) - 1))


def find_splitters(keys: DataFrame, n: int, tolerance: float = 0.01, cut_tolerance: float = 0.02) -> list[Splitter]:
    """n - 1 splitters of keys(h bigint, id bigint, size) into ranges of nearly equal bytes, within tolerance * bytes / n.

    A group of equal h is only cut if a boundary on either side of it misses by more than cut_tolerance * bytes / n.
    The driver sees at most 2**14 counts in the first round and 2**8 for each open splitter in later ones.
    """
    total = int(keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    wanted = [total * k / n for k in range(1, n)]
    slack = tolerance * total / n
    found: list[Splitter | None] = [None] * (n - 1)
    open_: dict[tuple[int, int], tuple[int, list[int]]] = {}  # prefix of the key -> bytes in front of it, the splitters inside

    def settle(prefix: tuple[int, int], bits: int, level: int, base: int, counts: dict[int, int], own: list[int], width: int) -> None:
        """Sets the splitters that a bin edge serves; the others go on to the bin that holds them."""
        edges, below = [(0, base)], base
        for b in sorted(counts):
            edges.append((b, below))
            below += counts[b]
            edges.append((b + 1, below))
        for k in own:
            edge, at = min(edges, key=lambda e: abs(e[1] - wanted[k]))
            whole = level == 0 and bits + width >= 64
            if abs(at - wanted[k]) <= (max(slack, cut_tolerance * total / n) if whole else slack) or (level == 1 and bits + width >= 64):
                key = ((prefix[level] << width) + edge) << (64 - bits - width)
                found[k] = Splitter(key, 0, at) if level == 0 else Splitter(prefix[0], key, at)
                continue
            inside, front = max(((b, at0) for b, at0 in edges[1::2] if at0 <= wanted[k]), default=(edges[1][0], base))
            nxt = ((prefix[0] << width) + inside, 0) if level == 0 else (prefix[0], (prefix[1] << width) + inside)
            open_.setdefault(nxt, (front, []))[1].append(k)

    first = {int(r.bin): int(r.bytes) for r in keys.groupBy(_bin(F.col("h"), 0, _FIRST).alias("bin")).agg(F.sum("size").alias("bytes")).collect()}
    if first and n > 1:
        settle((0, 0), 0, 0, 0, first, list(range(n - 1)), _FIRST)
    bits, level = _FIRST, 0
    while open_:
        if bits >= 64:
            bits, level = 0, 1
        width = min(_BITS, 64 - bits)
        now, open_ = open_, {}
        spark = keys.sparkSession
        signed = lambda x, b: (x << (64 - b)) - (1 << 63) if b else 0
        if level == 0:
            probes = spark.createDataFrame([(p[0],) for p in now], "p0 long")
            rows = keys.join(F.broadcast(probes), _top(F.col("h"), bits) == F.col("p0"))  # at most n - 1 rows
            binned = rows.groupBy("p0", F.lit(0).cast("long").alias("p1"), _bin(F.col("h"), bits, width).alias("bin"))
        else:
            probes = spark.createDataFrame([(signed(p[0], 64), p[0] >> 1, p[1]) for p in now], "ph long, p0 long, p1 long")
            same = (F.col("h") == F.col("ph")) & ((_top(F.col("id"), bits) == F.col("p1")) if bits else F.lit(True))
            rows = keys.join(F.broadcast(probes), same)
            binned = rows.groupBy(F.col("ph").alias("p0"), "p1", _bin(F.col("id"), bits, width).alias("bin"))
        counted: dict[tuple[int, int], dict[int, int]] = {}
        for r in binned.agg(F.sum("size").alias("bytes")).collect():
            head = (int(r.p0), 0) if level == 0 else (_unsigned(int(r.p0)), int(r.p1))
            counted.setdefault(head, {})[int(r.bin)] = int(r.bytes)
        for prefix, (front, own) in now.items():
            settle(prefix, bits, level, front, counted[prefix], own, width)
        bits += width
    return [s for s in found if s is not None]


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, h, id, size, text_crc32): size is the text's UTF-8 bytes plus 1; null texts are empty ones, null ids the smallest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*more, "doc_id", F.xxhash64(text).alias("h"), F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def _range_of(rows: DataFrame, splitters: list[Splitter]) -> DataFrame:
    """rows with `range`, the number of splitters at or below (h, id). Splitters are looked up by the first 14 bits of h, at most one row for each."""
    spark = rows.sparkSession
    by_bin: dict[int, list[tuple[int, int]]] = {}
    for s in splitters:
        if s.hash >> 64:  # at or above every key
            continue
        by_bin.setdefault(s.hash >> (64 - _FIRST), []).append((s.hash - (1 << 63), s.id - (1 << 63)))
    table, before = [], 0
    for b in range(1 << _FIRST):
        own = by_bin.get(b, [])
        if own or before:
            table.append((b, before, own))
        before += len(own)
    lookup = spark.createDataFrame(table, "bin long, before long, own array<struct<h:bigint,id:bigint>>")
    found = rows.withColumn("bin", _bin(F.col("h"), 0, _FIRST)).join(F.broadcast(lookup), "bin", "left")  # at most 2**14 rows
    key = F.struct("h", "id")
    return found.withColumn("range", (F.coalesce("before", F.lit(0)) + F.size(F.filter(F.coalesce("own", F.array().cast("array<struct<h:bigint,id:bigint>>")), lambda s: s <= key))).cast("int")).drop("bin", "before", "own")


def _placed(docs: DataFrame, n_shards: int, tolerance: float, *more: Column) -> DataFrame:
    """keyed(docs, *more) with shard and slot."""
    keys = written(keyed(docs), "shard-keys")
    finer = max(1, -(-parallelism(docs.sparkSession) // n_shards))
    splitters = find_splitters(keys, n_shards * finer, tolerance)
    counts = _range_of(keys, splitters).groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # one row a range
    shard_of = F.floor(F.col("range") / finer).cast("int")
    ahead = Window.partitionBy(shard_of).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select(F.col("range").alias("r"), shard_of.alias("shard"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start")), "starts")
    forget(None if not more else keys)
    ranged = _range_of(keyed(docs, *more) if more else keys, splitters)
    dealt = ranged.repartitionById(n_shards * finer, F.col("range")).sortWithinPartitions("h", "id")  # a range is a partition
    numbered = dealt.withColumn("k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))  # the number within the partition
    placed = numbered.join(F.broadcast(starts), F.col("range") == F.col("r"))  # n_shards * finer rows at most
    return placed.withColumn("slot", (F.col("start") + F.col("k")).cast("long"))


def shard(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.01) -> DataFrame:
    """(doc_id, h, size, text_crc32, shard, slot), one row for each row of docs(doc_id, text); other columns are ignored.

    Shards are consecutive ranges of (xxhash64(text), doc_id) with nearly equal bytes; slot numbers a shard's rows from 0 in
    that order. Equal texts share a shard unless their group is too large for the tolerance. Rows with equal doc_id and text stay
    together and are numbered in any order, as they are equal. A null text counts as an empty one, a null doc_id as the smallest. Fewer rows than
    shards leave shards empty; an empty table gives an empty result. A very long text is one row, and its shard is as much longer.
    """
    return _placed(docs, n_shards, tolerance).select("doc_id", "h", "size", "text_crc32", "shard", "slot")


def sharded(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.01) -> DataFrame:
    """The rows of docs, all columns, with the shard and slot that `shard` gives them; columns of docs with these two names are replaced.

    Only keys and sizes are written for the counting; the rows are read again and move once, in the exchange.
    """
    others = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    out = _placed(docs, n_shards, tolerance, F.struct("*").alias("row"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in others), "shard", "slot")
