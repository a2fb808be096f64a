"""Mixing sources to target weights by entropy balancing.

Of all document rates w between 0 and `cap`, those nearest to 1 in relative entropy that meet each source's token target
sum(w * size) = target are exponentially tilted, w = min(cap, exp(lam * size / unit)). The multipliers lam solve a convex
dual, one equation a source: Newton steps, kept inside a bracket, whose sums Spark takes over a histogram of (source, size).
Rates become whole copies by sequential Poisson sampling: a document's fraction is taken if its hash, divided by the
fraction, is below the source's threshold, which is refined on exact token sums until it meets the target; the one document
at the threshold counts with the words that are left; the mix itself takes it whole or leaves it.

Column expressions only. What a source's rows need to know of it is one row a source: up to SMALL sources are broadcast, of more only
those with a large share of the rows, so no source is ever gathered in one task. Texts are not shuffled but for the few documents at a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.scratch import checkpointed, forget, in_front, same, spread_join, written

WEIGHTS = (5.0, 2.0, 1.0)
_BINS = 1024
_STEPS = 200  # a source that has not converged by then is an error
SMALL = 10_000


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+; null has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target, unit, rows) of sizes(source, size).

    Sources by code point, null last, have the weights in turn and share `share` of all words. A target stops at cap times
    its source's size; what is over goes to the other sources by weight, until none is above. The multiplier of that
    filling is the smallest t with sum(least(weight * t, cap * size)) = budget, found by prefix sums over the sources in the
    order in which they fill; one row a source.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("unit"), F.count(F.lit(1)).alias("rows"))
    cycle = F.array(*map(F.lit, weights))
    turned = in_front(own, [F.col("source").asc_nulls_last()], turn=F.lit(1))
    rows = checkpointed(turned.withColumn("weight", F.get(cycle, F.pmod("turn", F.lit(len(weights))).cast("int"))).drop("turn"))
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weights")).first()
    budget = min(share, cap) * total["words"]
    ahead = in_front(rows, [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()], full=cap * F.col("source_size"), gone=F.col("weight"))
    level = (F.lit(budget) - F.col("full")) / (F.lit(total["weights"]) - F.col("gone"))
    # every source in front of the first that its level doesn't fill is full
    least = ahead.filter(F.col("weight") * level <= cap * F.col("source_size")).agg(F.min_by(level, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source"))).first()[0]
    goal = F.least(F.col("weight") * F.lit(float("inf") if least is None else float(least)), cap * F.col("source_size"))
    return rows.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(goal).alias("target"), F.greatest("unit", F.lit(1)).cast("double").alias("unit"), "rows")


def rate(lam: Column, size: Column, unit: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(lam * size / unit, F.lit(50.0))))


def multipliers(sizes: DataFrame, goals: DataFrame, cap: float, tolerance: float = 1e-9) -> DataFrame:
    """goals with lam, null where the target is the cap itself (every rate is cap) or the source has no words."""
    hist = written(sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-histogram")
    open_ = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    state = goals.filter(open_).select("source", "target", "unit", "rows", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"))
    state = checkpointed(state.withColumn("done", F.lit(False)))
    for _ in range(_STEPS):
        if state.filter("not done").isEmpty():
            break
        todo = state.filter("not done").drop("done")
        w = rate(F.col("lam"), F.col("size"), F.col("unit"), cap)
        words = F.col("n") * F.col("size") * w
        slope = F.when(w < cap, words * F.col("size") / F.col("unit")).otherwise(0.0)
        met = spread_join(hist, todo.withColumn("meets", F.col("rows")), ["source"], "meets", small=SMALL)
        sums = met.groupBy("source", "target", "unit", "rows", "lam", "lo", "hi").agg(F.sum(words).alias("got"), F.sum(slope).alias("slope"))
        over = F.col("got") - F.col("target")
        lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.try_divide(over, F.col("slope"))
        middle = F.when(lo < -1e5, F.least(hi * 2, hi - 1)).when(hi > 1e5, F.greatest(lo * 2, lo + 1)).otherwise((lo + hi) / 2)
        moved = F.when((newton > lo) & (newton < hi), newton).otherwise(middle)
        done = F.abs(over) <= tolerance * F.col("target")
        fresh = sums.select("source", "target", "unit", "rows", F.when(done, F.col("lam")).otherwise(moved).alias("lam"), lo.alias("lo"), hi.alias("hi"), (done | (hi - lo < 1e-12)).alias("done"))
        state = checkpointed(state.filter("done").unionByName(fresh))
    else:
        if not state.filter("not done").isEmpty():
            raise ArithmeticError(f"the multipliers have not converged in {_STEPS} steps")
    forget(hist)
    found = state.select(F.col("source").alias("s"), "lam")
    return goals.join(found, goals.source.eqNullSafe(found.s), "left").drop("s")


def _cut(rows: DataFrame, need: DataFrame) -> DataFrame:
    """(source, need, lo, hi, before, rows): the bin of the order key y in [0, 1) in which the words taken in y's order reach the need, after two refinements."""
    edge = need.select("source", "rows", F.col("need"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(0.0).alias("before"))
    for _ in range(2):
        edge = checkpointed(edge)
        width = (F.col("hi") - F.col("lo")) / _BINS
        met = spread_join(rows.select("source", "y", "size"), edge.withColumn("meets", F.col("rows")), ["source"], "meets", small=SMALL)
        inside = met.filter((F.col("y") >= F.col("lo")) & (F.col("y") < F.col("hi")))
        slot = F.least(F.floor((F.col("y") - F.col("lo")) / width), F.lit(_BINS - 1))
        counted = inside.groupBy("source", "rows", "need", "lo", "hi", "before", slot.alias("bin")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bin")  # at most _BINS rows a source
        sums = counted.withColumn("upto", F.col("before") + F.sum("words").over(running))
        hit = sums.filter(F.col("upto") >= F.col("need")).groupBy("source").agg(F.min_by(F.struct("rows", "need", "bin", "lo", "hi", (F.col("upto") - F.col("words")).alias("before")), "bin").alias("b"))
        w = (F.col("b.hi") - F.col("b.lo")) / _BINS
        edge = hit.select("source", "b.rows", "b.need", (F.col("b.lo") + F.col("b.bin") * w).alias("lo"), (F.col("b.lo") + (F.col("b.bin") + 1) * w).alias("hi"), "b.before")
    return checkpointed(edge)


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """(more, doc_id, source, size, h) of docs(doc_id, text, source)."""
    return docs.select(*more, "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))


def _rated(rows: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """rows(source, size, h) with rate, whole and y, the place in its source's order of the fraction, null without one."""
    joined = spread_join(rows, plan.withColumn("meets", F.col("rows")), ["source"], "meets", small=SMALL)
    flat = F.when(F.col("lam").isNull(), F.when(F.col("target") > 0, F.lit(cap)).otherwise(0.0)).otherwise(rate(F.col("lam"), F.col("size"), F.col("unit"), cap))
    rated = joined.withColumn("rate", F.when(F.col("size") > 0, flat).otherwise(0.0)).withColumn("whole", F.floor("rate"))
    u = (F.shiftrightunsigned(F.col("h"), 11).cast("double") + 0.5) / float(1 << 53)
    xi = u / (F.col("rate") - F.col("whole"))
    return rated.withColumn("y", F.when((F.col("size") > 0) & (F.col("rate") > F.col("whole")), xi / (1 + xi)))


def _planned(docs: DataFrame, weights: Sequence[float], share: float, cap: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rated rows of docs, and one row a source with all that decides its copies: plan and threshold."""
    rows = written(_sized(docs, seed), "sizes")
    plan = checkpointed(multipliers(rows, checkpointed(targets(rows, weights, share, cap)), cap))
    rated = written(_rated(rows, plan, cap), "rates")
    forget(rows)
    need = rated.groupBy("source").agg((F.round(F.max("target")) - F.sum(F.col("whole") * F.col("size"))).alias("need"), F.count(F.lit(1)).alias("rows")).filter("need > 0")
    edge = _cut(rated.filter("y is not null"), need)
    edge = edge.select(F.col("source").alias("s"), "need", "lo", "hi", "before")
    return rated, checkpointed(plan.join(edge, same(plan, edge, [("source", "s")]), "left").drop("s"))


def _at_edge() -> Column:
    return F.coalesce((F.col("y") >= F.col("lo")) & (F.col("y") < F.col("hi")), F.lit(False))


def _edge_rows(placed: DataFrame) -> DataFrame:
    """The rows at their source's threshold with extra: in order, until the need is met."""
    order = Window.partitionBy("source").orderBy("y", "h", "doc_id", "size")  # about a millionth of a source's documents
    last = placed.filter(_at_edge()).withColumn("upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return last.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("size") - F.col("upto") + F.col("need"))).cast("long")).drop("upto")


def _last_rows(placed: DataFrame) -> DataFrame:
    """(doc_id, h, at_edge, meets): how many words the documents at their sources' thresholds give, and how many rows each is."""
    return _edge_rows(placed).groupBy("doc_id", "h").agg(F.max("extra").alias("at_edge"), F.count(F.lit(1)).alias("meets"))


def _extra() -> Column:
    """The words that a row gives beyond its whole copies: at the threshold what is still needed, in front of it all, behind it none."""
    return F.coalesce(F.col("at_edge"), F.when(F.col("y") < F.col("lo"), F.col("size")), F.lit(0)).cast("long")


def _copies() -> Column:
    """The one rule of how often a row is taken, of its columns whole, size and extra."""
    return F.col("whole") + F.when((F.col("size") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: int = 2, seed: int = 7) -> DataFrame:
    """(doc_id, source, h, size, source_size, target, rate, copies, part, taken), one row for each row of docs(doc_id, text, source); other columns are ignored.

    taken = copies * size, the words that `mixed` takes of the row. `part` is, for the one document a source at the threshold, what the
    source still lacks at it; the document is taken once more if that is at least half of it. So the taken words of a
    source are off its target by no more than half that document; no document exceeds cap times its size. Null and blank texts
    have size 0 and copies 0; a null source is a source of its own. Of repeated rows at the threshold all are taken if one is. The
    choice depends on doc_id, text and seed only, so reruns agree. An empty table gives an empty
    result. Very long texts are split whole, in their row's task.
    """
    rated, plan = _planned(docs, weights, share, float(cap), seed)
    edge = plan.select("source", "need", "lo", "hi", "before", F.col("rows").alias("meets"))
    placed = spread_join(rated, edge, ["source"], "meets", small=SMALL)
    last = written(_last_rows(placed), "thresholds")
    placed = spread_join(placed, last, ["doc_id", "h"], "meets", "left", small=SMALL).withColumn("extra", _extra())
    part = F.when(F.col("extra") == F.col("size"), 0).otherwise(F.col("extra")).cast("long")
    copies = _copies().cast("long")
    return placed.select("doc_id", "source", "h", "size", "source_size", "target", "rate", copies.alias("copies"), part.alias("part"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: int = 2, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of docs, all columns, as often as they are taken, always with their whole text.

    The one document a source that mix takes in part is taken whole if that comes at least as near to the target, else it is
    left. Rows are judged as by mix, repeated ones alike, null and blank texts are never taken. docs may have any further columns.
    """
    rated, plan = _planned(docs, weights, share, float(cap), seed)
    edge = plan.select("source", "need", "lo", "hi", "before", F.col("rows").alias("meets"))
    last = written(_last_rows(spread_join(rated, edge, ["source"], "meets", small=SMALL)), "thresholds")
    forget(rated)
    packed = _sized(docs, seed, F.struct("*").alias("row"))  # no name of docs can clash
    placed = spread_join(_rated(packed, plan.drop("need", "lo", "hi", "before"), float(cap)), edge, ["source"], "meets", small=SMALL)
    placed = spread_join(placed, last, ["doc_id", "h"], "meets", "left", small=SMALL).withColumn("extra", _extra())
    return placed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), _copies().cast("int")))).select("row.*")
