"""Source divergence audit: how far the terms of each source are from those of the other sources of its language.

Every (lang, source) group gives each kept term of its language a smoothed share p, a whole number. The divergence of group g
from group h sums f(p, q) = floor((p - q)**2 / q) over all kept terms. Terms that neither group has all give the same baseline
value, so only occurrences are looked at: all terms at the baseline, a correction for each count that g has and h's baseline,
the same for h, and one for each term that both have.

Terms of a group are ranked by radix selection: histograms over 16 bits of the value at a time find the value of the kth row of
every group, then histograms over two bytes of the terms at a time find which rows tied at that value are in. No group is sorted or gathered.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.scratch import forget, spread_join, written

#: Terms in UTF-8: every byte beyond ASCII belongs to one, so bytes and code points give the same.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = 16
GROUP = ["lang", "source"]


def _share(count: str) -> Column:
    """p = 1 + floor(1000000000 * (count + 1) / (n + v)), exact; 64 bits would not hold the product for counts of ten thousand millions."""
    return F.expr(f"1 + (CAST({count} + 1 AS DECIMAL(20, 0)) * CAST(1000000000 AS DECIMAL(10, 0))) div CAST(n + v AS DECIMAL(20, 0))").cast("long")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _filled(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each batch."""
    for batch in batches:
        found: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
        for text, *group in zip(batch.column("text").cast(pa.binary()), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
            terms = TERM.findall(text.as_py().translate(_LOWER))
            n, docs = found.setdefault(tuple(group), (Counter(), Counter()))
            n.update(terms)
            docs.update(set(terms))
        for (lang, source), (n, docs) in found.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            counts = [pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(n)), pa.repeat(pa.scalar(source), len(n)), terms, *counts], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the number of the group's documents with it, combined in batches and in tasks before they move."""
    each = _filled(docs).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _cut(cells: DataFrame, key: list[str], digit: Column, need: str, falling: bool) -> DataFrame:
    """(key, digit, taken): the digit in which the row number `need` of each key falls, and how many rows lie in the digits in front of it."""
    counts = cells.groupBy(*key, need, digit.alias("digit")).agg(F.count(F.lit(1)).alias("rows"))
    order = F.col("digit").desc() if falling else F.col("digit").asc()
    so_far = Window.partitionBy(*key).orderBy(order)  # at most a row for each of 65,536 digits
    return counts.withColumn("upto", F.sum("rows").over(so_far)).filter(f"upto >= {need} AND upto - rows < {need}").select(*key, "digit", (F.col("upto") - F.col("rows")).alias("taken"))


def _first_difference(a: str, b: str) -> Column:
    """The 1-based position of the first byte in which two different binary strings differ."""
    shared = F.least(F.length(a), F.length(b))
    found = F.filter(F.sequence(F.lit(1), F.greatest(shared, F.lit(1))), lambda i: F.substring(F.col(a), i, F.lit(1)) != F.substring(F.col(b), i, F.lit(1)))
    return F.coalesce(F.get(found, F.lit(0)), shared + 1).cast("int")


def top_rows(rows: DataFrame, key: list[str], value: str, item: str, k: int) -> DataFrame:
    """The rows of each key that are among its first k by `value` (a long, 0 or more) falling, then by the bytes of `item` rising.

    item is unique within a key. Groups of up to k rows stay whole. Others are cut by histograms over all rows: first on the value's
    bits from the top, then, among rows that tie at the kth value, on two bytes at a time from the first byte in which they differ.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    open_ = written(sizes.filter(F.col("rows") > k).select(*key, "rows", F.lit(k).cast("long").alias("need"), F.lit(0).cast("long").alias("high")), "open")
    if open_.isEmpty():
        forget(open_)
        return rows
    for shift in range(64 - _BITS, -1, -_BITS):
        near = spread_join(rows.select(*key, value), open_, key, "rows")
        if shift < 64 - _BITS:
            near = near.filter(F.shiftright(value, shift + _BITS) == F.col("high"))
        digit = F.shiftright(value, shift).bitwiseAND((1 << _BITS) - 1)
        cut = _cut(near, key, digit, "need", falling=True)
        following = open_.join(cut, key).select(*key, "rows", (F.col("need") - F.col("taken")).alias("need"), F.shiftleft("high", _BITS).bitwiseOR(F.col("digit")).alias("high"))
        following = written(following, "open")
        forget(open_)
        open_ = following
    bounds = _tie_bounds(rows, key, value, item, open_)
    limits = written(open_.join(bounds, key).select(*key, "rows", F.col("high").alias("__least"), "__last"), "limits")
    out = spread_join(rows, limits, key, "rows", "left")
    forget(open_, bounds)
    chosen = F.col("__least").isNull() | (F.col(value) > F.col("__least")) | ((F.col(value) == F.col("__least")) & (F.col(item).cast("binary") <= F.col("__last")))
    return out.filter(chosen).select(*rows.columns)


def _tie_bounds(rows: DataFrame, key: list[str], value: str, item: str, open_: DataFrame) -> DataFrame:
    """(key, __last): the last item in byte order that is in, of the rows whose value is the key's `high`; `need` of them are in."""
    tied = spread_join(rows.select(*key, value, F.col(item).cast("binary").alias("item")), open_, key, "rows").filter(F.col(value) == F.col("high"))
    tied = written(tied.select(*key, "item", "need"), "tied")
    found = None
    while True:
        facts = tied.groupBy(*key, "need").agg(F.count(F.lit(1)).alias("ties"), F.min("item").alias("low"), F.max("item").alias("last"))
        facts = written(facts.withColumn("at", F.when(F.col("ties") > F.col("need"), _first_difference("low", "last"))), "ties")
        done = facts.filter("at IS NULL").select(*key, F.col("last").alias("__last"))
        done = written(done if found is None else found.union(done), "bounds")
        left = facts.filter("at IS NOT NULL")
        forget(found)
        found = done
        if left.isEmpty():
            forget(tied, facts)
            return found
        near = spread_join(tied, left.select(*key, "at", F.col("ties").alias("rows")), key, "rows").withColumn("digit", F.substring(F.col("item"), F.col("at"), F.lit(2)))
        cut = _cut(near, key, F.col("digit"), "need", falling=False).select(*key, F.col("digit").alias("chosen"), "taken", F.lit(1).cast("long").alias("rows"))
        following = spread_join(near, written(cut, "cut"), key, "rows").filter("digit = chosen").select(*key, "item", (F.col("need") - F.col("taken")).alias("need"))
        following = written(following, "tied")
        forget(tied, facts)
        tied = following


def _kept(docs: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, groups, langs): counts of the kept terms, and n (their sum) and v (the number of kept terms) of each group and of each lang."""
    term = Window.partitionBy("lang", "term")  # a row for each source of the lang
    counts = term_counts(docs).withColumns({"in_docs": F.sum("docs").over(term), "all_n": F.sum("n").over(term)})
    cells = written(counts.filter(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "all_n"), "cells")
    seen = _filled(docs).select(*GROUP).distinct()
    sums = cells.groupBy(*GROUP).agg(F.sum("n").alias("n"))
    sizes = cells.select("lang", "term", "all_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("all_n"))
    langs = written(seen.select("lang").distinct().join(sizes, "lang", "left").select("lang", F.coalesce("all_n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")), "langs")
    groups = seen.join(sums, GROUP, "left").join(langs.select("lang", "v"), "lang").select(*GROUP, F.coalesce("n", F.lit(0)).alias("n"), "v")
    return cells, written(groups.withColumn("p0", F.when(F.col("v") > 0, _share("0"))), "groups"), langs


def _placed(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, term, n, all_n, p): every count with its group's share."""
    terms = cells.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("rows"))
    facts = written(terms.join(groups.select(*GROUP, F.col("n").alias("total"), "v"), GROUP).select(*GROUP, "total", "v", "rows"), "facts")
    joined = spread_join(cells.withColumnRenamed("n", "count"), facts, GROUP, "rows").withColumnRenamed("total", "n")
    return written(joined.select(*GROUP, "term", "count", "all_n", _share("count").alias("p")), "placed")


def _pairs(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a lang."""
    g = groups.select("lang", "source", F.col("p0").alias("g0"), "v")
    h = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("h0"))
    both = g.join(h, "lang").filter("source <> item")
    base = both.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * _f("g0", "h0")).otherwise(F.lit(0)).alias("value"))
    shares = written(placed.groupBy(*GROUP, "p").agg(F.count(F.lit(1)).alias("terms")), "shares")  # far fewer than terms: a row for each count
    own = shares.join(both, GROUP).select("lang", "source", "item", (F.col("terms") * (_f("p", "h0") - _f("g0", "h0"))).alias("value"))
    theirs = shares.withColumnRenamed("source", "item").join(both, ["lang", "item"]).select("lang", "source", "item", (F.col("terms") * (_f("g0", "p") - _f("g0", "h0"))).alias("value"))
    x = placed.join(groups.select(*GROUP, "p0"), GROUP).select("lang", "term", "source", "p", "p0")
    y = x.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    shared = x.join(y, ["lang", "term"]).filter("source <> item").select("lang", "source", "item", (_f("p", "q") - _f("p", "q0") - _f("p0", "q") + _f("p0", "q0")).alias("value"))
    parts = [part.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for part in (base, own, theirs, shared)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _terms(placed: DataFrame, langs: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, item, value) of each group's first `ranks` terms that it has more of than its lang."""
    # a row for each lang with kept terms; sources and terms are not in it
    weights = placed.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).join(langs, "lang")
    joined = spread_join(placed.select(*GROUP, "term", "p", "all_n"), written(weights, "weights"), ["lang"], "rows")
    rows = joined.select(*GROUP, F.col("term").alias("item"), "p", _share("all_n").alias("q")).filter("p > q")
    rows = written(rows.select(*GROUP, "item", _f("p", "q").alias("value")), "above")
    return top_rows(rows, GROUP, "value", "item", ranks)


def audit(docs: DataFrame, least_docs: int = 3, ranks: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` holds each group's divergence from every other source of its lang, part `term`
    the first `ranks` terms that it has more of than its lang, with their share of the divergence from it.

    docs has text, lang and source; nulls are '', a value like any other, and other columns are ignored. Terms are runs of ASCII
    letters and characters beyond ASCII, only A-Z lower-cased; each lang keeps those in `least_docs` of its documents, where each
    row counts as one, also a repeated one. Groups without a term, from empty or null texts, take part in all pairs; a lang without
    kept terms has pairs of value 0. Equal values rank by the items' UTF-8 bytes. An empty table gives an empty result. Texts are split whole; one must fit a task.
    """
    cells, groups, langs = _kept(docs, least_docs)
    placed = _placed(cells, groups)
    forget(cells)
    parts = [(_pairs(placed, groups), "pair"), (_terms(placed, langs, ranks), "term")]
    rows = [part.select(*GROUP, F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value")) for part, name in parts]
    order = Window.partitionBy(*GROUP, "part").orderBy(F.desc("value"), F.col("item"))  # a row for each other source, or at most `ranks`
    return rows[0].unionByName(rows[1]).withColumn("rank", F.row_number().over(order))
