"""Quality rules: a learned decision list over text statistics.

Sequential covering: one rule at a time is grown as a conjunction of threshold tests, on two thirds of the labelled
documents, then pruned on the other third, and the documents it covers leave the table. All counts are Spark aggregates over
every labelled document; only counts for (statistic, bin) come to the driver, at most STATS * BINS rows a step. The result
is an ordered CASE WHEN over plain columns, without any Python in the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.scratch import in_front, written

BINS = 24
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]+"


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE, -1), lambda w: w != "")


def _repeat_words(words: Column, window: int = 5) -> Column:
    """Words inside windows of `window` words that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes. Only texts that have a repeated window sort them, in n log n steps.
    """
    at = lambda ws, i: [F.get(ws, i + k) for k in range(window)]
    hashes = F.when(F.size(words) >= window, _let(words, lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - window), lambda i: F.xxhash64(*at(ws, i))))).otherwise(F.array().cast("array<bigint>"))

    def twice(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s: F.filter(
            F.zip_with(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.struct(a.alias("x"), b.h.alias("after"))), F.concat(F.array(F.lit(None).cast("bigint")), F.transform(s, lambda a: a.h)), lambda p, before: F.struct(p.x.i.alias("i"), (F.coalesce(p.x.h == p.after, F.lit(False)) | F.coalesce(p.x.h == before, F.lit(False))).alias("dup"))),
            lambda p: p.dup & p.i.isNotNull(),
        )
        starts = _let(pairs, lambda s: F.sort_array(F.transform(same(s), lambda p: p.i)))
        gaps = lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
        return _let(starts, lambda p: F.aggregate(gaps(p), F.lit(0), lambda total, g: total + g))

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(twice(h)))


def text_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the counts the rules use) of docs(doc_id, text), one row a row.

    Null, empty and blank texts have 0 everywhere. Repeated rows are counted each. Very long texts are split whole, in their row's task.
    An empty table gives an empty result. Other columns, also of the names of the counts, are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    filled = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select("doc_id", text.alias("text"), _words(F.col("text")).alias("ws"), filled.alias("filled"))
    plain = F.length("text").cast("long")
    return base.select(
        "doc_id",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        (plain - F.length(F.regexp_replace("text", _SYMBOLS, ""))).alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("ws")).cast("long").alias("n_repeat_words"),
        plain.alias("n_chars"),
        F.size("filled").cast("long").alias("n_lines"),
        (plain - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).alias("n_capitals"),
        F.size(F.array_distinct("ws")).cast("long").alias("n_distinct_words"),
    )


def ratios() -> dict[str, Column]:
    """The statistics that rules test, as expressions over text_stats; a ratio with nothing below it is 0."""
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": over("word_chars", "n_words"),
        "symbols_per_word": over("n_symbols", "n_words"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_word_share": over("n_repeat_words", "n_words"),
        "capital_share": over("n_capitals", "n_chars"),
        "distinct_share": over("n_distinct_words", "n_words"),
        "words_per_line": over("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Test:
    stat: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = ratios()[self.stat]
        return x > self.threshold if self.above else x <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Documents that meet all tests are bad."""

    tests: tuple[Test, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for test in self.tests:
            out = out & test.column()
        return out


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional: the number of the first rule that fits, 0 for the default, good."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].column(), F.lit(k)).otherwise(out)
    return out


def _foil_gain(bad: float, good: float, bad0: float, good0: float) -> float:
    if bad <= 0 or bad0 <= 0:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def _bin(name: str, cuts: list[float]) -> Column:
    """How many of the cuts lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(name) > c)) if cuts else F.lit(0)


def quantiles(table: DataFrame, names: list[str]) -> dict[str, list[float]]:
    """The exact BINS - 1 quantiles of each statistic within each label, as sorted distinct cuts.

    A quantile is the least value that at least k / BINS of the label's rows do not exceed. Equal values are counted first;
    the counts in front of a value are prefix sums over sorted ranges, so no label or statistic is gathered in one task and
    the cuts are the same for every partitioning. At most (labels * statistics * BINS) rows come to the driver.
    """
    long = table.select("label", F.posexplode(F.array(*names)).alias("stat", "value"))
    hist = long.groupBy("label", "stat", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = {r.label: r.n for r in table.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()}
    if not rows:
        return {n: [] for n in names}
    ahead, before = [], 0
    for label, n in rows.items():
        ahead.append((label, n, before))
        before += n * len(names)
    own = F.broadcast(table.sparkSession.createDataFrame(ahead, "label int, label_rows long, before long"))  # a row for each label
    ranked = in_front(hist, [F.col("label"), F.col("stat"), F.col("value")], front=F.col("n")).join(own, "label")
    front = F.col("front") - F.col("before") - F.col("stat") * F.col("label_rows")
    reached = lambda at: F.least(F.lit(float(BINS - 1)), F.floor(at * BINS / F.col("label_rows")).cast("double"))
    cuts = ranked.filter(reached(front) < reached(front + F.col("n"))).select("stat", "value").distinct().collect()
    return {n: sorted(float(r.value) for r in cuts if names[r.stat] == n) for n in names}


def learn(labelled: DataFrame, least_bad: int = 5, least_precision: float = 0.9) -> list[Rule]:
    """Rules for label 0 from rows of text_stats plus (label, prune boolean).

    Thresholds are the exact BINS - 1 quantiles of each statistic among the rows of either label. A rule grows while a test gains
    information, and is pruned to the tests that the pruning part bears out. It stays if it covers at
    least `least_bad` bad documents of the growing and pruning parts together with a precision of `least_precision` in
    each part that it covers; learning ends at the first that doesn't. As every rule takes bad rows away, it ends. No labelled rows give no rules.
    """
    stats = ratios()
    names = list(stats)
    table = labelled.select("label", "prune", *(c.alias(n) for n, c in stats.items()))
    cuts = quantiles(table, names)
    bins = [_bin(n, cuts[n]).alias(n) for n in names]
    left = written(table.select("label", "prune", *bins), "rule-bins")

    def binned(test: Test) -> Column:
        k = cuts[test.stat].index(test.threshold)
        return F.col(test.stat) > k if test.above else F.col(test.stat) <= k

    def counted(rows: DataFrame) -> dict[tuple[str, int, bool], tuple[int, int]]:
        """(bad, good) by statistic, bin and part."""
        long = rows.select("label", "prune", F.explode(F.array(*(F.struct(F.lit(n).alias("stat"), F.col(n).alias("bin")) for n in names))).alias("x"))
        found = long.groupBy("x.stat", "x.bin", "prune").agg(F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") != 0).alias("good"))
        return {(r.stat, r.bin, r.prune): (r.bad, r.good) for r in found.collect()}

    def totals(counts: dict, prune: bool) -> tuple[int, int]:
        own = [v for (stat, _, part), v in counts.items() if stat == names[0] and part == prune]
        return sum(b for b, _ in own), sum(g for _, g in own)

    def part(counts: dict, test: Test, prune: bool) -> tuple[int, int]:
        k = cuts[test.stat].index(test.threshold)
        own = [v for (stat, b, p), v in counts.items() if stat == test.stat and p == prune and (b > k) == test.above]
        return sum(b for b, _ in own), sum(g for _, g in own)

    rules: list[Rule] = []
    while True:
        rows, tests, steps = left, [], []
        counts = counted(rows)
        while True:
            bad0, good0 = totals(counts, False)
            if not bad0 or not good0:
                break
            options = [Test(n, above, c) for n in names for c in cuts[n] for above in (True, False)]
            best = max(options, key=lambda t: _foil_gain(*part(counts, t, False), bad0, good0), default=None)
            if best is None or _foil_gain(*part(counts, best, False), bad0, good0) <= 1e-9:
                break
            tests.append(best)
            rows = rows.filter(binned(best))
            counts = counted(rows)
            steps.append((totals(counts, False), totals(counts, True)))
        # prune: the shortest prefix whose worth on the pruning part is the best
        worth = [(b - g) / (b + g) if b + g else 0.0 for _, (b, g) in steps]
        if not steps:
            break
        keep = max(range(len(steps)), key=lambda k: (worth[k], -k)) + 1
        (bad, good), (bad_p, good_p) = steps[keep - 1]
        if bad + bad_p < least_bad or bad < least_precision * (bad + good) or bad_p < least_precision * (bad_p + good_p):
            break
        rules.append(Rule(tuple(tests[:keep])))
        covered = F.lit(True)
        for test in tests[:keep]:
            covered = covered & binned(test)
        left = left.filter(~covered)
    return rules


def labelled_stats(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """text_stats rows with labels(doc_id, label 0/1) and the pruning third, chosen by hash of doc_id. Null ids and labels are left out."""
    own = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    return stats.join(own, "doc_id").withColumn("prune", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(3)) == 0)


def base_failed() -> Column:
    """Fewer than 10 words, or more than 20 % of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """text_stats of docs with base_failed, rule (0: none, else its number) and kept, and the rules learned from labels(doc_id, label).

    One row for each row of docs, repeated ones too. Null, empty and blank texts fail the base rules. Null ids are judged, but have no label.
    Without usable labels no rule is learned and the base rules decide. An empty table gives an empty result. Other columns are ignored.
    """
    stats = written(text_stats(docs), "text-stats")
    rules = learn(labelled_stats(stats, labels).filter(~base_failed()))
    return stats.withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
