"""Line dedup: lines that many documents share, or later copies of a line, are found and returned as per-document bitmaps.

Column expressions only. A document's lines become rows (two 64-bit hashes of the line's key, document, position); equal
lines of one document are one row with a bitmap of positions. A range partition of (hash, document), sorted within by
document and position, streams each key's first occurrences: the document is part of the range key, so a key that holds a
third of all lines is spread over many partitions, yet equal (key, document) rows meet. Counts of those partial runs are
combined, and the result is a bitmap of dropped lines in 64-bit words; words without a dropped line are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.scratch import forget, parallelism, spread_join, written

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; all-ASCII texts take the faster lower()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_rows(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, t, words, least): one row for each key and document; words are (index, bits) of the positions that have the key."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(_lines(ascii_lower(F.col("text")))).alias("pos", "line"))
    key = F.btrim(F.col("line"), F.lit(_BLANK))
    return keyed.select("doc_id", "t", "pos", key.alias("key")).filter(F.length("key") > 0).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), "key").alias("h2"), "doc_id", "t", "pos")


def dropped_lines(docs: DataFrame, least_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(doc_id, t, dropped): bitmaps of the dropped lines of documents that lose any; t is xxhash64 of the text, dropped a map from pos div 64 to bits.

    A key is a line without white space at both ends and with A-Z lower-cased; empty keys are never dropped. Keys in at
    least `least_docs` different doc_ids lose all their lines, or with keep_first all but the first by (doc_id, position).
    """
    rows = written(_line_rows(docs), "lines")
    n = max(parallelism(docs.sparkSession), 2)
    dealt = rows.select("h1", "h2", "doc_id", "pos").repartitionByRange(n, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    stream = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")  # as the rows lie: no further exchange or sort
    firsts = dealt.withColumn("k", F.row_number().over(stream)).filter("k = 1")
    common = firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "pos")).alias("head")).filter(F.col("n_docs") >= least_docs)
    common = written(common.select("h1", "h2", "n_docs", "head"), "common-lines")
    lost = spread_join(rows, common, ["h1", "h2"], "n_docs")
    if keep_first:
        lost = lost.filter(~(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("pos") == F.col("head.pos"))))
    word = F.expr("pos div 64").cast("int")
    bits = lost.groupBy("doc_id", "t", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits"))
    return bits.groupBy("doc_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def dense(bitmap: Column) -> Column:
    """The bitmap's words from 0 to its last one as an array, in one pass; null stays null."""

    def filled(entries: Column) -> Column:
        gap = lambda e, i: e.key - F.coalesce(F.get(entries, i - 1).key, F.lit(-1)) - 1
        return F.flatten(F.transform(entries, lambda e, i: F.concat(F.array_repeat(F.lit(0).cast("long"), gap(e, i)), F.array(e.value))))

    return F.transform(F.array(F.sort_array(F.map_entries(bitmap))), filled)[0]


def is_dropped(words: Column, pos: Column) -> Column:
    """Whether a dense bitmap has the position."""
    return F.getbit(F.coalesce(F.get(words, F.floor(pos / 64).cast("int")), F.lit(0).cast("long")), F.pmod(pos, F.lit(64))) == 1


def dedup_lines(docs: DataFrame, least_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_lines, n_dropped, dropped, kept_text), one row for each row; other columns are ignored.

    Null and empty texts have one empty line, which stays. Rows that repeat a doc_id and text count as one document and all
    get its bitmap; rows of one doc_id with different texts count once for a key. A null doc_id counts as one document.
    An empty table gives an empty result. A very long text is split and joined whole in its row's task.
    """
    lost = dropped_lines(docs, least_docs, keep_first)
    left = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    joined = left.join(lost, left.doc_id.eqNullSafe(lost.doc_id) & (left.t == lost.t), "left").select(left.doc_id, "text", "dropped")
    lines = _lines(F.col("text"))
    # the dense bitmap is bound once a row: inside the filter's lambda it would be made anew for each line
    own = F.transform(F.array(F.struct(dense(F.col("dropped")).alias("words"), lines.alias("lines"))), lambda r: F.filter(r.lines, lambda _, i: ~is_dropped(r.words, i)))[0]
    kept = F.when(F.col("dropped").isNull(), lines).otherwise(own)
    counted = joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), "dropped", kept.alias("kept"))
    return counted.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), "dropped", F.array_join("kept", "\n").alias("kept_text"))
