"""MinHash near-dedup with min-max hashing.

Every random permutation of the shingle hashes gives two coordinates, the minimum and the maximum, so a signature of
2 * p values costs p hash evaluations a shingle. Each agrees between two sets with probability J, their Jaccard similarity.
Bands of the coordinates are bucket keys; a pair that shares a bucket is a candidate and is confirmed on the full sets.

Groups are not compared pair by pair:
1. documents with equal shingle sets are one class (a hash aggregate);
2. in a bucket of at most PAIRWISE classes all pairs are compared, at most PAIRWISE / 2 for each class. Of its larger buckets,
   a class takes two and is compared with the head of each, a randomly chosen class. Confirmed links are closed to components,
   and buckets whose classes are then one component are done;
3. large buckets that are still split are joined to clusters (components of the buckets' overlaps), and each class is described by its
   difference from its cluster's consensus P, the shingles of more than half of the classes. If c counts the shingles that x and
   P share and s those that the differences of x and y share, then x and y have c(x) + c(y) - |P| + s in common, so they link if and
   only if s >= E(x) + E(y), with E a number for each class. Where E(x) plus the least E of the cluster is not positive, the two link for
   certain. Classes whose difference is smaller than E(x) plus the least E of another component link with none.
   For the rest, E(x) plus that least E is the number of shingles of the difference that have to be shared, so prefix filtering on
   the differences, rarest shingles first, gives the pairs that are compared. That is exact, and a group of near copies of
   one text, with the outliers that it has, costs as many rows as its differences have, not as many as it has pairs.
So no link within a bucket is lost, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm import vectext as V
from pulseframe.llm.scratch import forget, in_small_batches, parallelism, salted_join, same, spread_join, written

#: With 40 bands of 5, a pair at similarity 0.8 shares no bucket with probability (1 - 0.8**5)**40 = 1.3e-7 (a test counts it).
BANDS, ROWS = 40, 5
#: Up to this size a bucket's pairs are compared directly; larger buckets go by heads. Both ways are exact.
PAIRWISE = 8


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all rows in one array, and each row's first index in it."""
    starts, ends, firsts = V.word_spans(data, offsets, V.SPACE)
    words = V.span_hashes(data, starts, ends)
    n_words = np.diff(firsts)
    n_shingles = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    base = np.zeros(len(n_words) + 1, np.int64)
    np.cumsum(n_shingles, out=base[1:])
    row = np.repeat(np.arange(len(n_words)), n_shingles)
    at = firsts[row] + np.arange(base[-1]) - base[row]
    length = np.minimum(n_words, width)[row]
    out = length.astype(np.uint64) + np.uint64(0x51ED270B)
    for k in range(width):
        inside = k < length
        word = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else out
        out = np.where(inside, V.mix(out * np.uint64(0x9FB21C651E98DF25) + word), out)
    kept, sizes = [], np.zeros(len(n_words) + 1, np.int64)
    for i in range(len(n_words)):
        own = out[base[i] : base[i + 1]]
        if len(own) > 1:
            own = np.sort(own)
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        kept.append(own)
        sizes[i + 1] = len(own)
    return np.concatenate(kept) if kept else out, np.cumsum(sizes)


def _digests(sets: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    return (
        V.by_row(V.mix(sets ^ np.uint64(0xA5A5A5A5)), firsts, np.add, 0).view(np.int64),
        V.by_row(V.mix(sets + np.uint64(0x1234567)), firsts, np.bitwise_xor, 0).view(np.int64),
    )


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _signed(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int, seed: int) -> Iterator[pa.RecordBatch]:
    mult, add = _coefficients((bands * rows + 1) // 2, seed)
    for batch in batches:
        for first, data, offsets in V.chunks(batch.column("text")):
            sets, firsts = _shingle_sets(V.LOWER[data], offsets, width)
            n = len(offsets) - 1
            d1, d2 = _digests(sets, firsts)
            sizes = np.diff(firsts)
            full = sizes > 0
            keys = np.zeros((n, bands), np.int64)
            if full.any():
                short = (sets >> np.uint64(32)).astype(np.uint32)
                heads = firsts[:-1][full]
                low = np.empty((len(mult), len(heads)), np.uint32)
                high = np.empty_like(low)
                x = np.empty_like(short)
                for i in range(len(mult)):
                    np.multiply(short, mult[i], out=x)
                    np.add(x, add[i], out=x)
                    low[i] = np.minimum.reduceat(x, heads)
                    high[i] = np.maximum.reduceat(x, heads)
                values = np.concatenate([low, high])[: bands * rows].astype(np.uint64)
                for b in range(bands):
                    key = np.full(len(heads), b + 1, np.uint64)
                    for r in range(rows):
                        key = V.mix(key * np.uint64(0x9FB21C651E98DF25) + values[b * rows + r])
                    keys[full, b] = key.view(np.int64)
            rows_in = batch.slice(first, n)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [rows_in.column("doc_id"), rows_in.column("t"), pa.array(sizes), pa.array(d1), pa.array(d2), flat], names=["doc_id", "t", "n_shingles", "d1", "d2", "bands"]
            )


def _with_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in V.chunks(batch.column("text")):
            sets, firsts = _shingle_sets(V.LOWER[data], offsets, width)
            d1, d2 = _digests(sets, firsts)
            rows = batch.slice(first, len(offsets) - 1)
            same = (np.asarray(rows.column("d1")) == d1) & (np.asarray(rows.column("d2")) == d2)  # else another text under the same doc_id
            blobs = [sets[firsts[i] : firsts[i + 1]].tobytes() if same[i] else None for i in range(len(same))]
            out = pa.RecordBatch.from_arrays([rows.column("vid"), pa.array(blobs, pa.binary())], names=["vid", "members"])
            yield out.filter(pa.array(same))


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs a, b whose sets link."""
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))
            linked.append(100 * common >= percent * (len(a) + len(b) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable from each id of the edges (a, b), by min-label steps with pointer jumping.

    Each round is joins and aggregates with map-side combining. The edges of hubs, ids with more than 1 / (4 * partitions) of all edges, stay
    where they are, as the labels of these few ids are broadcast.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    state = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count(F.lit(1)).alias("edges")), "labels")
    limit = (state.agg(F.sum("edges")).first()[0] or 0) / (4 * parallelism(edges.sparkSession))
    hubs = written(state.filter(F.col("edges") > limit).select(F.col("id").alias("hub")), "hubs")  # fewer than 4 * partitions
    if hubs.isEmpty():
        at_hubs, others = None, both
    else:
        at_hubs, others = both.join(F.broadcast(hubs), F.col("b") == F.col("hub"), "left_semi"), both.join(F.broadcast(hubs), F.col("b") == F.col("hub"), "left_anti")
    while True:
        labels = state.select("id", "label")
        met = others.join(labels.select(F.col("id").alias("b"), "label"), "b").select("a", "label")
        if at_hubs is not None:
            few = labels.join(F.broadcast(hubs), F.col("id") == F.col("hub"), "left_semi").select(F.col("id").alias("b"), "label")
            met = met.union(at_hubs.join(F.broadcast(few), "b").select("a", "label"))
        near = met.groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        step = written(step.join(jump, "next").select("id", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")), "step")
        forget(state)
        state = step
        if step.filter("moved").isEmpty():
            forget(both, hubs)
            return state.select("id", "label")


def _relabelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows(vid, ...) with comp, the component of the class so far."""
    if labels is None:
        return rows.withColumn("comp", F.col("vid"))
    return rows.join(labels, rows.vid == labels.id, "left").withColumn("comp", F.coalesce("label", "vid")).drop("id", "label")


def _split_buckets(member: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, vid, n, comp, size) of buckets(bucket, vid, n) with several components; buckets with equal members are one."""
    placed = written(_relabelled(member.select("bucket", "vid", "n"), labels), "placed")
    facts = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("vid")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(5), "vid")).alias("x2"))
    facts = written(facts.filter("lo < hi").select("bucket", "size", F.col("size").alias("rows"), F.xxhash64("size", "x1", "x2").alias("same")), "bucket-facts")
    found = spread_join(placed, facts, ["bucket"], "rows")
    out = written(found.groupBy(F.col("same").alias("bucket"), "vid", "n", "comp", "size").count().drop("count"), "split")
    forget(placed, facts)
    return out


def _pairs(member: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs to compare, all of buckets of up to PAIRWISE classes and some with the heads of larger ones."""
    can = F.least("x.n", "y.n") * 100 >= percent * F.greatest("x.n", "y.n")
    differ = (F.col("x.comp") != F.col("y.comp")) & can
    small, large = member.filter(F.col("size") <= PAIRWISE), member.filter(F.col("size") > PAIRWISE)
    each = small.alias("x").join(small.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & differ & (F.col("x.vid") < F.col("y.vid"))).select(F.col("x.vid").alias("a"), F.col("y.vid").alias("b"))
    place = F.struct(F.xxhash64("bucket"), "bucket", "n", "comp")
    tried = large.groupBy("vid").agg(F.array_distinct(F.array(F.min(place), F.max(place))).alias("two")).select("vid", F.explode("two").alias("t")).select("vid", "t.bucket", "t.n", "t.comp")
    tried = written(tried, "tried")
    heads = large.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("vid"), "vid", "n", "comp")).alias("h"), F.first("size").alias("rows"))
    heads = written(heads.select("bucket", F.struct("h.vid", "h.n", "h.comp").alias("y"), "rows"), "heads")
    stars = spread_join(tried, heads, ["bucket"], "rows").alias("x").filter((F.col("comp") != F.col("y.comp")) & (F.least("n", "y.n") * 100 >= percent * F.greatest("n", "y.n")))
    out = written(each.union(stars.select(F.least("vid", "y.vid"), F.greatest("vid", "y.vid"))).distinct(), "pairs")
    forget(tried, heads)
    return out


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their full sets."""
    weights = {x: written(pairs.groupBy(x).agg(F.count(F.lit(1)).alias("n")), "degrees") for x in "ba"}
    compared = pairs
    for x, weight in weights.items():  # a head's set goes to as many tasks as its pairs need
        side = sets.select(F.col("vid").alias(f"v{x}"), F.col("members").alias(f"s{x}"))
        compared = salted_join(compared, side, x, f"v{x}", weight, by=("a", "b")).drop(f"v{x}")
    out = written(compared.select("a", "b", "sa", "sb").mapInArrow(partial(_compared, percent=percent), "a long, b long"), "links")
    forget(*weights.values())
    return out


def _united(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The labels after the links (a, b) have been added."""
    if links.isEmpty():
        return labels
    return components(links if labels is None else labels.select(F.col("id").alias("a"), F.col("label").alias("b")).union(links))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vid, cluster, g): a row for each shingle of the members."""
    for batch in batches:
        for k in range(batch.num_rows):
            own = np.frombuffer(batch.column("members")[k].as_buffer(), np.int64)
            for at in range(0, len(own), 1 << 16):
                part = pa.array(own[at : at + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(c)[k], len(part)) for c in ("vid", "cluster")] + [part], names=["vid", "cluster", "g"])


def _differences(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(vid, cluster, e, m, delta): the difference from the consensus, its size, and the number e, times 2 * (100 + percent)."""
    for batch in batches:
        es, ms, deltas = [], [], []
        for x, y in zip(batch.column("members"), batch.column("common"), strict=True):
            own, common = np.frombuffer(x.as_buffer(), np.uint64), np.sort(np.asarray(y.values).view(np.uint64))
            extra, lost = np.setdiff1d(own, common, assume_unique=True), np.setdiff1d(common, own, assume_unique=True)
            delta = np.concatenate([V.mix(extra + np.uint64(1)), V.mix(lost ^ np.uint64(0xC0FFEE))])
            ms.append(len(delta))
            es.append(2 * percent * len(own) + (100 + percent) * (len(common) - 2 * (len(own) - len(extra))))
            deltas.append(delta.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vid"), batch.column("cluster"), pa.array(es, pa.int64()), pa.array(ms, pa.int64()), pa.array(deltas, pa.binary())], names=["vid", "cluster", "e", "m", "delta"])


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vid, cluster, g): a row for each shingle of the difference."""
    return _shingles(batch.rename_columns(["vid", "cluster", "members"]) for batch in batches)


def _least_elsewhere(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, second, top, rows) of rows(keys, vid, comp, e): the least e with its component and class, the least of another component (null without one), the component with most rows and the number of rows."""
    each = rows.groupBy(*keys, "comp").agg(F.min(F.struct("e", "vid")).alias("low"), F.count(F.lit(1)).alias("count"))
    each = written(each.select(*keys, "comp", "count", F.struct("low.e", "comp", "low.vid").alias("low")), "components")
    first = each.groupBy(*keys).agg(F.min("low").alias("first"), F.max(F.struct("count", "comp"))["comp"].alias("top"), F.sum("count").alias("rows"), F.count(F.lit(1)).alias("comps"))
    first = written(first.filter("comps > 1").drop("comps"), "first")
    second = spread_join(each, first.select(*keys, "first", F.lit(1).cast("long").alias("meets")), keys, "meets").filter("comp <> first.comp").groupBy(*keys).agg(F.min("low").alias("second"))
    out = written(first.join(second, keys), "least")
    forget(each, first)
    return out


def _elsewhere() -> Column:
    """The least e of another component than comp."""
    return F.when(F.col("first.comp") != F.col("comp"), F.col("first.e")).otherwise(F.col("second.e"))


def _clusters(rest: DataFrame) -> DataFrame:
    """(vid, comp, cluster) of the classes in rest: clusters are the components of buckets that share a component."""
    lead = rest.groupBy("bucket").agg(F.min("comp").alias("lo"), F.count(F.lit(1)).alias("rows"))
    edges = spread_join(rest.select("bucket", "comp").distinct(), lead, ["bucket"], "rows").select(F.col("comp").alias("a"), F.col("lo").alias("b"))
    labels = components(edges)
    out = written(rest.select("vid", "comp").distinct().join(labels, F.col("comp") == F.col("id")).select("vid", "comp", F.col("label").alias("cluster")), "clusters")
    forget(labels)
    return out


def _described(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(vid, cluster, e, m, delta) of the classes, by the consensus of their clusters."""
    own = written(sets.join(clusters.select("vid", "cluster"), "vid"), "members")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    counts = own.mapInArrow(_shingles, "vid long, cluster long, g long").groupBy("cluster", "g").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    frequent = counts.join(sizes, "cluster").filter("2 * df > size")  # at most twice as many as a member has on average
    common = frequent.groupBy("cluster").agg(F.collect_list("g").alias("common"))
    facts = written(sizes.join(common, "cluster", "left").select("cluster", F.coalesce("common", F.array().cast("array<bigint>")).alias("common"), F.col("size").alias("rows")), "consensus")
    out = written(spread_join(own, facts, ["cluster"], "rows").mapInArrow(partial(_differences, percent=percent), "vid long, cluster long, e long, m long, delta binary"), "differences")
    forget(own, facts)
    return out


def _certain(described: DataFrame) -> DataFrame:
    """(a, b): links that follow from e alone, one for each class that has some; with them all such links are closed."""
    least = _least_elsewhere(described.select("cluster", "vid", "comp", "e"), ["cluster"])
    rows = spread_join(described.select("cluster", "vid", "comp", "e"), least.select("cluster", "first", "rows"), ["cluster"], "rows")
    out = written(rows.filter("comp <> first.comp and e + first.e <= 0").select(F.col("vid").alias("a"), F.col("first.vid").alias("b")), "certain")
    forget(least)
    return out


def _possible(described: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of different components that prefix filtering on the differences leaves."""
    unit = 2 * (100 + percent)
    least = _least_elsewhere(described.select("cluster", "vid", "comp", "e"), ["cluster"])
    rows = spread_join(described, least.select("cluster", "first", "second", "rows"), ["cluster"], "rows")
    rows = written(rows.withColumn("need", F.ceil((F.col("e") + _elsewhere()) / F.lit(unit))).filter("m >= need").select("vid", "cluster", "comp", "e", "m", "need", "delta"), "open")
    spelt = written(rows.select("vid", "cluster", "delta").mapInArrow(_spelt, "vid long, cluster long, g long"), "spelt")
    counts = written(spelt.groupBy("cluster", "g").agg(F.count(F.lit(1)).alias("df"), F.count(F.lit(1)).alias("rows")), "frequencies")
    ordered = spread_join(spelt, counts, ["cluster", "g"], "rows").groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("own"))
    placed = ordered.join(rows.drop("delta"), "vid").select("vid", "cluster", "comp", "e", "m", F.posexplode(F.slice("own", F.lit(1), (F.col("m") - F.col("need") + 1).cast("int"))).alias("pos", "s"))
    placed = written(placed.filter("s.df > 1").select("cluster", F.col("s.g").alias("g"), "vid", "comp", "e", "m", "pos"), "prefixes")
    key = ["cluster", "g"]
    facts = _least_elsewhere(placed, key)
    fits = spread_join(placed, facts.select(*key, "first", "second", "rows"), key, "rows").filter(F.col("e") + _elsewhere() <= unit * (F.col("m") - F.col("pos")))
    fits = written(fits.select(*key, "vid", "comp", "e", "m", "pos"), "fits")
    again = _least_elsewhere(fits, key)
    kept = written(spread_join(fits, again.select(*key, "top", "rows"), key, "rows"), "probes")
    x, y = kept.filter("comp <> top").alias("x"), kept.alias("y")  # of each pair one class at least is not of the commonest component
    meets = (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.top")) | (F.col("x.vid") < F.col("y.vid")))
    enough = F.col("x.e") + F.col("y.e") <= unit * F.least(F.col("x.m") - F.col("x.pos"), F.col("y.m") - F.col("y.pos"))
    out = written(x.join(y, meets & enough).select(F.least("x.vid", "y.vid").alias("a"), F.greatest("x.vid", "y.vid").alias("b")).distinct(), "pairs")
    forget(least, rows, spelt, counts, placed, facts, fits, again, kept)
    return out


def _sets_of(docs: DataFrame, classes: DataFrame, member: DataFrame, width: int) -> DataFrame:
    """(vid, members): the full shingle sets of the classes in member, from the texts."""
    wanted = member.select("vid").distinct().join(classes.select("vid", "rep", "d1", "d2"), "vid")
    texts = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.rep)).select("vid", "d1", "d2", "text")
    return written(texts.mapInArrow(partial(_with_sets, width=width), "vid long, members binary").dropDuplicates(["vid"]), "sets")


def _closed(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, label): the component of each class that is linked with another."""
    none = classes.limit(0).select(F.col("vid").alias("id"), F.col("vid").alias("label"))
    buckets = _split_buckets(classes.select(F.explode("bands").alias("bucket"), "vid", "n"), None)
    if buckets.isEmpty():
        return none
    sets = _sets_of(docs, classes, buckets, width)
    labels = _united(None, _links(_pairs(buckets, percent), sets, percent))
    rest = _split_buckets(buckets.filter(F.col("size") > PAIRWISE), labels)
    if not rest.isEmpty():
        clusters = _clusters(rest)
        described = _described(clusters, sets, percent)
        labels = _united(labels, _certain(_relabelled(described, labels)))
        labels = _united(labels, _links(_possible(_relabelled(described, labels), percent), sets, percent))
        forget(clusters, described)
    forget(buckets, rest, sets)
    return none if labels is None else labels


def _marked(docs: DataFrame, width: int, percent: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(doc_id, t, n_shingles, component_id, kept), one row for each row of docs(doc_id, text); t is a hash of the text."""
    docs = in_small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("t"))
    sig = written(
        docs.mapInArrow(partial(_signed, width=width, bands=bands, rows=rows, seed=seed), "doc_id long, t long, n_shingles long, d1 long, d2 long, bands array<long>"), "signatures"
    )
    classes = written(
        sig.filter("n_shingles > 0")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
        .withColumn("vid", F.monotonically_increasing_id()),
        "classes",
    )
    labels = _closed(docs, classes, width, percent)
    named = classes.join(labels, classes.vid == labels.id, "left").select("d1", "d2", "rep", "rows", F.coalesce("label", "vid").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    names = written(named.join(smallest, "comp").select("d1", "d2", "component_id", "rows"), "names")
    out = spread_join(sig.drop("bands"), names, ["d1", "d2"], "rows", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.drop("d1", "d2").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs(doc_id, text); other columns are ignored.

    Rows link if 100 * intersection >= percent * union of their sets of `width`-word shingles. component_id is the smallest
    doc_id reachable; kept marks the document that stays of each component. Null, empty and blank texts have an empty set and
    link with nothing. Repeated rows are members of the same class. A null doc_id never is a component's id unless no member
    has another. An empty table gives an empty result. Very long texts are hashed whole, in spans; their set must fit a task.
    """
    return _marked(docs, width, percent, bands, rows, seed).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without later members of each component of near_duplicates: one row of each stays.

    That is a row with the component's doc_id; of several such rows (a repeated doc_id) the one whose text hashes lowest, and of
    equal texts any. Texts without words all stay. A component of null ids alone keeps one row. docs may have any further columns.
    """
    marks = written(_marked(docs, width, percent, BANDS, ROWS, 1), "marks")
    gone = marks.filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"))  # no name of docs can clash
    left = packed.join(gone, same(packed, gone, [("id", "gone_id"), ("t", "gone_t")]), "left_anti")
    again = marks.filter("kept and n_shingles > 0").groupBy(F.col("doc_id").alias("again")).agg(F.min("t").alias("t0"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = written(again, "repeated")
    if again.isEmpty():
        return left.select("row.*")
    alone = left.join(again, same(left, again, [("id", "again")]), "left_anti").select("row")
    twice = left.join(again, same(left, again, [("id", "again")])).withColumn("full", F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    one = twice.filter("full and t = t0").dropDuplicates(["id"]).select("row")
    return alone.unionByName(twice.filter("not full").select("row")).unionByName(one).select("row.*")
