"""Chat formatting: quotation linking.

Lines that start with '>' marks are quotes; consecutive lines of one depth are a passage. Passages and the messages' own
bodies, paragraphs and lines are normalised and hashed; an equi-join on (conversation, hash) links each passage to the
message it quotes, and with it the reply to its parent. What finds no such piece is looked for as a run of words: each
message offers its runs of as many words as an open passage of its conversation has. Conversations are then rebuilt in
reply order, without quotes. Column expressions, but for the hashes of the runs.

No conversation is ever gathered in one task. Orders within a key are made by a range partition on (key, order): the rows of
a key that share a partition are numbered there, and the partitions' counts, one row for each key and partition, give the
offsets. Reply order is a list ranking of the reply tree's Euler tour by pointer jumping, log2(branches) joins on unique ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.scratch import checkpointed, parallelism, written

_MARKS = r"^[ \t]*+((?:>[ \t]?+)++)"  # possessive: long runs of marks or blanks cost one pass
_WORD = r"[\p{L}\p{M}\p{N}_]+|[^\s\x{A0}]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def depth_of(line: Column) -> Column:
    """The number of '>' marks a line starts with; blanks may stand between them."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), r"[^>]", ""))


def _normal(text: Column) -> Column:
    """Lower case, runs of white space as one blank, no blanks at the ends."""
    return F.trim(F.lower(F.regexp_replace(text, r"[\s\x{A0}]+", " ")))


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def parse(text: Column) -> Column:
    """array<struct<depth, body>> of the runs of consecutive lines with equal depth, in order; null is an empty text."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1), lambda line: F.struct(depth_of(line).alias("depth"), F.regexp_replace(line, _MARKS, "").alias("body")))

    def runs(ls: Column) -> Column:
        opens = F.filter(F.transform(ls, lambda line, i: F.when((i == 0) | (line.depth != F.get(ls, i - 1).depth), i).otherwise(-1)), lambda i: i >= 0)
        body = lambda first, after: F.array_join(F.transform(F.slice(ls, first + 1, after - first), lambda line: line.body), "\n")
        return _let(opens, lambda at: F.transform(at, lambda first, k: F.struct(F.get(ls, first).depth.alias("depth"), body(first, F.coalesce(F.get(at, k + 1), F.size(ls))).alias("body"))))

    return _let(lines, runs)


def _same(a: str, b: str, *keys: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows in ranges of the columns `by`, with the number of the range as pid."""
    return written(rows.repartitionByRange(max(2, parallelism(rows.sparkSession)), *by).withColumn("pid", F.spark_partition_id()), "ranges")


def _numbered(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """rows with k, their number from 0 within the key in the order of `by` (unique in it), and before, the `by` in front."""
    dealt = _dealt(rows, *key, by)
    local = Window.partitionBy(*key, "pid").orderBy(F.col(by).asc_nulls_first())
    own = dealt.withColumn("k0", F.row_number().over(local) - 1).withColumn("before0", F.lag(by).over(local))
    ahead = Window.partitionBy(*key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = dealt.groupBy(*key, "pid").agg(F.count(F.lit(1)).alias("n"), F.max(by).alias("last"))
    parts = parts.select(*key, "pid", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"), F.max("last").over(ahead).alias("last"))
    joined = own.alias("x").join(parts.alias("y"), _same("x", "y", *key, "pid"))
    return joined.select(*(f"x.{c}" for c in rows.columns), (F.col("y.start") + F.col("x.k0")).alias("k"), F.coalesce("x.before0", F.when(F.col("x.k0") == 0, F.col("y.last"))).alias("before"))


def _latest(rows: DataFrame, key: list[str], by: str, value: str, found: str) -> DataFrame:
    """rows with `found`, the largest `value` of rows of the key at or before the row in the order of `by`."""
    dealt = _dealt(rows, *key, by)
    local = Window.partitionBy(*key, "pid").orderBy(F.col(by)).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = dealt.groupBy(*key, "pid").agg(F.max(value).alias("top")).withColumn("top", F.max("top").over(ahead))
    own = dealt.withColumn("own", F.max(value).over(local))
    joined = own.alias("x").join(parts.alias("y"), _same("x", "y", *key, "pid"))
    return joined.select(*(f"x.{c}" for c in rows.columns), F.greatest("x.own", "y.top").alias(found))


def link_quotes(messages: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row for each row of messages(conv_id, turn, role, text), without quotes and in reply order; other columns are ignored. Very long texts are parsed whole, in their row's task.

    Columns: conv_id, turn, role, body (the text without quoted lines, ends stripped), n_quotes (passages), n_linked (passages
    found), max_depth, parent_turn, depth (replies above it) and position (from 0 in the conversation: parents before replies,
    a reply with all of its own replies before its next sibling, siblings by turn).

    A passage links to the latest earlier message of its conversation that has it as its whole body, a paragraph, or a line,
    all normalised; where there is none, to the latest that has its words and signs in a row anywhere (some lines or
    paragraphs, a sentence, a part of a line). Passages of fewer than `min_chars` characters only link as whole bodies. parent_turn is the message that the
    first linked passage of depth 1 quotes, else the message before. Deeper passages are linked too and count, but do not
    choose the parent. Null, empty and blank texts have an empty body and no quotes, and blank passages are none. Repeated rows
    of a (conv_id, turn) stay rows of their own, are one message in the tree and share its place; the latest of their links
    is its parent. A null conv_id is a conversation of its own; a null turn comes first and is never linked to. An
    empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    quoted = F.when(text.contains(">"), parse(F.col("text"))).otherwise(F.array(F.struct(F.lit(0).alias("depth"), text.alias("body"))))
    rows = messages.select("conv_id", "turn", "role", quoted.alias("runs"))
    own = F.array_join(F.transform(F.filter("runs", lambda r: r.depth == 0), lambda r: _strip(r.body)), "\n")
    rows = written(
        rows.select("conv_id", "turn", "role", _strip(own).alias("body"), F.filter("runs", lambda r: (r.depth > 0) & (_normal(r.body) != "")).alias("quotes")).withColumn("who", F.xxhash64("role", "body", "quotes")),
        "messages",
    )
    per = _links(rows, min_chars)
    joined = rows.alias("m").join(per.alias("p"), _same("m", "p", "conv_id", "turn", "who"), "left")
    flat = joined.select(
        *(f"m.{c}" for c in ("conv_id", "turn", "role", "body")), F.coalesce("p.n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("p.n_linked", F.lit(0)).alias("n_linked"),
        F.coalesce("p.max_depth", F.lit(0)).cast("int").alias("max_depth"), F.col("p.first.found").alias("quoted"),
    )
    flat = written(flat, "linked")
    tree = _reply_order(flat.groupBy("conv_id", "turn").agg(F.max("quoted").alias("quoted")))
    return flat.drop("quoted").alias("m").join(tree.alias("o"), _same("m", "o", "conv_id", "turn")).select("m.*", "o.parent_turn", "o.depth", "o.position")


def _links(rows: DataFrame, min_chars: int) -> DataFrame:
    """(conv_id, turn, who, n_quotes, n_linked, max_depth, first) of the messages with quotes."""
    quotes = rows.filter(F.size("quotes") > 0).select("conv_id", "turn", "who", F.posexplode("quotes").alias("at", "q"))
    quotes = quotes.select("conv_id", "turn", "who", "at", "q.depth", _normal(F.col("q.body")).alias("said")).withColumn("hash", F.sha2("said", 256)).distinct()
    asked = quotes.select("conv_id", "hash", "turn").distinct()
    pieces = F.array_distinct(F.concat(F.array("body"), F.filter(F.concat(F.split("body", r"\n\s*\n", -1), F.split("body", r"\n", -1)), lambda p: F.length(_normal(p)) >= min_chars)))
    # only conversations with quotes offer passages, and only those that are asked for go on
    offering = rows.filter("turn is not null and body <> ''").alias("r").join(asked.select("conv_id").distinct().alias("a"), _same("r", "a", "conv_id"), "left_semi")
    offers = offering.select("conv_id", "turn", F.explode(pieces).alias("p")).select("conv_id", "turn", F.sha2(_normal(F.col("p")), 256).alias("hash"))
    answers = _answers(asked, offers, ["conv_id", "hash"])
    linked = quotes.alias("q").join(answers.alias("a"), _same("q", "a", "conv_id", "hash", "turn")).select("q.*", "a.found")
    linked = written(linked, "pieces")
    runs = linked.filter(F.col("found").isNull() & (F.length("said") >= min_chars)).select("conv_id", "hash", "turn", "said").distinct()
    if not runs.isEmpty():
        inside = _run_answers(runs, offering).withColumnRenamed("found", "inside")
        linked = linked.alias("q").join(inside.alias("a"), _same("q", "a", "conv_id", "hash", "turn"), "left").select("q.conv_id", "q.turn", "q.who", "q.at", "q.depth", F.coalesce("q.found", "a.inside").alias("found"))
    return linked.groupBy("conv_id", "turn", "who").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("found").alias("n_linked"), F.max("depth").alias("max_depth"),
        F.min(F.when((F.col("depth") == 1) & F.col("found").isNotNull(), F.struct("at", "found"))).alias("first"),
    )


def _answers(asked: DataFrame, offers: DataFrame, key: list[str]) -> DataFrame:
    """(key, turn, found) of asked(key, turn), unique: the latest earlier turn that offers the key, of offers(key, turn)."""
    wanted = asked.select(*key).distinct()
    offers = offers.alias("o").join(wanted.alias("w"), _same("o", "w", *key), "left_semi").distinct()
    # at one turn, questions come before offers: a message does not quote itself
    moment = lambda kind: F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("t"), F.lit(kind).alias("kind"))
    both = offers.select(*key, moment(1).alias("moment"), "turn", F.col("turn").alias("source")).unionByName(
        asked.select(*key, moment(0).alias("moment"), "turn", F.lit(None).cast(asked.schema["turn"].dataType).alias("source"))
    )
    return _latest(both, key, "moment", "source", "found").filter("moment.kind = 0").select(*key, "turn", "found")


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(k)
    return x ^ (x >> np.uint64(32))


def _run_hashes(words: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes) of all runs of n words, for each n of sizes: that of n words from the two runs of the largest power of 2 that begin and end it."""
    level, k = words, 1
    for n in sorted(sizes):
        if n > len(words):
            break
        while 2 * k <= n:
            level, k = _mixed(level[:-k], level[k:]), 2 * k
        count = len(words) - n + 1
        yield n, _mixed(level[:count], level[n - k : n - k + count])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other columns, once for each different run of words of one of the row's sizes, with the run's size and two hashes."""
    for batch in batches:
        kept = batch.select([c for c in batch.schema.names if c not in ("one", "two", "sizes")])
        found, held = [], 0

        def out(found: list[tuple[int, int, np.ndarray, np.ndarray]], kept: pa.RecordBatch = kept) -> pa.RecordBatch:
            at = np.concatenate([np.full(len(x), i, np.int64) for i, _, x, _ in found])
            n = np.concatenate([np.full(len(x), n, np.int32) for _, n, x, _ in found])
            one, two = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (2, 3))
            return pa.RecordBatch.from_arrays([*kept.take(pa.array(at)).columns, pa.array(n), pa.array(one), pa.array(two)], names=[*kept.schema.names, "n", "h1", "h2"])

        for i in range(batch.num_rows):
            one, two = (np.asarray(batch.column(c)[i].values).view(np.uint64) for c in ("one", "two"))
            sizes = batch.column("sizes")[i].as_py()
            for (n, x), (_, y) in zip(_run_hashes(one, sizes), _run_hashes(two, sizes), strict=True):
                x, first = np.unique(x, return_index=True)
                found.append((i, n, x, y[first]))
                held += len(x)
                if held >= 1 << 16:
                    yield out(found)
                    found, held = [], 0
        if found:
            yield out(found)


def _run_answers(asked: DataFrame, offering: DataFrame) -> DataFrame:
    """(conv_id, hash, turn, found) of asked(conv_id, hash, turn, said): the latest earlier turn of offering(conv_id, turn, body) with the words of `said` in a row."""

    def hashed(rows: DataFrame, *columns: str) -> DataFrame:
        kept = rows.select(*columns, F.transform("words", lambda w: F.xxhash64(w)).alias("one"), F.transform("words", lambda w: F.xxhash64(F.lit(1), w)).alias("two"), "sizes")
        types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
        return kept.mapInArrow(_runs, f"{types}, n int, h1 long, h2 long")

    words = lambda text: F.regexp_extract_all(_normal(F.col(text)), F.lit(_WORD), 0)
    asked = asked.withColumn("words", words("said")).withColumn("sizes", F.array(F.size("words")))
    sizes = asked.select("conv_id", F.size("words").alias("n")).distinct().groupBy("conv_id").agg(F.collect_list("n").alias("sizes"))
    questions = written(hashed(asked, "conv_id", "hash", "turn"), "open-passages")
    texts = offering.alias("r").join(sizes.alias("s"), _same("r", "s", "conv_id")).select("r.conv_id", "r.turn", "s.sizes", words("r.body").alias("words"))
    key = ["conv_id", "n", "h1", "h2"]
    answers = _answers(questions.select(*key, "turn").distinct(), hashed(texts, "conv_id", "turn"), key)
    return questions.alias("q").join(answers.alias("a"), _same("q", "a", *key, "turn")).select("q.conv_id", "q.hash", "q.turn", "a.found")


def _reply_order(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, depth, position) of turns(conv_id, turn, quoted), with quoted an earlier turn or null.

    A run is a message that quotes another than the one before, or a conversation's first, with those that follow it until the
    next such message. In preorder a run comes as a whole and then the runs that hang on it, those on its last messages first.
    """
    chain = _numbered(turns, ["conv_id"], "turn")
    parent = F.when(F.col("k") > 0, F.coalesce("quoted", "before"))
    chain = written(chain.select("conv_id", "turn", "k", parent.alias("parent_turn"), ((F.col("k") > 0) & F.col("quoted").isNotNull() & ~F.col("quoted").eqNullSafe(F.col("before"))).alias("bent")), "replies")
    odd = chain.filter("bent").select("conv_id").distinct()
    straight = chain.alias("x").join(odd.alias("o"), _same("x", "o", "conv_id"), "left_anti").select("conv_id", "turn", "parent_turn", F.col("k").alias("depth"), F.col("k").alias("position"))
    if odd.isEmpty():
        return straight
    nodes = chain.alias("x").join(odd.alias("o"), _same("x", "o", "conv_id"), "left_semi").withColumn("head", F.when(F.col("bent") | (F.col("k") == 0), F.col("k")))
    nodes = written(_latest(nodes, ["conv_id"], "k", "head", "run"), "runs")
    runs = nodes.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("size"))
    total = runs.groupBy("conv_id").agg(F.sum("size").alias("total"))
    hung = nodes.filter("bent").alias("x").join(nodes.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.parent_turn") == F.col("y.turn")))
    hung = hung.select("x.conv_id", F.col("x.run").alias("run"), F.col("y.run").alias("up"), (F.col("y.k") - F.col("y.run") + 1).alias("below"), F.struct((-F.col("y.k")).alias("a"), F.col("x.run").alias("b")).alias("turn"))
    hung = written(_numbered(hung, ["conv_id", "up"], "turn").select("conv_id", "run", "up", "below", F.col("before.b").alias("elder")), "branches")
    tree = runs.alias("r").join(hung.alias("h"), _same("r", "h", "conv_id", "run"), "left").select("r.conv_id", "r.run", "r.size", "h.up", F.coalesce("h.below", F.lit(0)).alias("below"))
    enter, leave = 2 * F.col("run"), 2 * F.col("run") + 1
    steps = tree.select("conv_id", enter.alias("e"), "size", "below", leave.alias("usual")).unionByName(tree.select("conv_id", leave.alias("e"), F.lit(0).cast("long").alias("size"), (-F.col("below")).alias("below"), (2 * F.col("up") + 1).alias("usual")))
    turnings = hung.select("conv_id", F.when(F.col("elder").isNull(), 2 * F.col("up")).otherwise(2 * F.col("elder") + 1).alias("e"), enter.alias("to"))
    state = checkpointed(steps.alias("s").join(turnings.alias("t"), _same("s", "t", "conv_id", "e"), "left").select("s.conv_id", "s.e", "s.size", "s.below", F.coalesce("t.to", "s.usual").alias("to")))
    while not state.filter("to is not null").isEmpty():
        far = state.select("conv_id", F.col("e").alias("to"), "size", "below", F.col("to").alias("next"))
        moved = state.alias("s").join(far.alias("f"), F.col("s.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("s.to") == F.col("f.to")), "left")
        state = checkpointed(moved.select("s.conv_id", "s.e", (F.col("s.size") + F.coalesce("f.size", F.lit(0))).alias("size"), (F.col("s.below") + F.coalesce("f.below", F.lit(0))).alias("below"), F.col("f.next").alias("to")))
    ranked = state.filter(F.col("e") % 2 == 0).select("conv_id", (F.col("e") / 2).cast("long").alias("run"), F.col("size").alias("rest"), F.col("below").alias("closing"))
    ranked = ranked.alias("a").join(tree.alias("t"), _same("a", "t", "conv_id", "run")).join(total.alias("n"), F.col("a.conv_id").eqNullSafe(F.col("n.conv_id")))
    ranked = ranked.select("a.conv_id", "a.run", (F.col("n.total") - F.col("a.rest")).alias("start"), (F.col("t.below") - F.col("a.closing")).alias("depth"))
    placed = nodes.alias("x").join(ranked.alias("r"), _same("x", "r", "conv_id", "run"))
    inner = F.col("x.k") - F.col("x.run")
    return straight.unionByName(placed.select("x.conv_id", "x.turn", "x.parent_turn", (F.col("r.depth") + inner).alias("depth"), (F.col("r.start") + inner).alias("position")))
