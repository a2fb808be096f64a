"""The pipeline, stage by stage and as a whole, against plain restatements on the smallest tables; and what SQL cannot express of op7, op9 and op10."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from pulseframe.llm import decision_list, line_crf, queries
from pulseframe.llm.mixing import mix
from pulseframe.llm.sharding import shard

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_score(text, model):
    """Forward-backward by enumeration of the two states, line after line."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    x, length, _ = line_crf.line_features(data, np.array([0, len(data)]))
    e = x @ model.unary
    ahead, behind = np.zeros((len(e), 2)), np.zeros((len(e), 2))
    ahead[0] = [0, e[0]]
    for t in range(1, len(e)):
        ahead[t] = [np.logaddexp(ahead[t - 1][0] + model.pair[0, j], ahead[t - 1][1] + model.pair[1, j]) + j * e[t] for j in (0, 1)]
    for t in range(len(e) - 2, -1, -1):
        behind[t] = [np.logaddexp(model.pair[i, 0] + behind[t + 1][0], model.pair[i, 1] + e[t + 1] + behind[t + 1][1]) for i in (0, 1)]
    log = ahead + behind
    good = np.exp(log[:, 1] - np.logaddexp(log[:, 0], log[:, 1]))
    weight = np.maximum(length, 1)
    p = float((weight * good).sum() / weight.sum())
    p = min(max(p, 1e-9), 1 - 1e-9)
    return 1 / (1 + math.exp(-(model.scale[0] * (math.log(p) - math.log1p(-p)) + model.scale[1])))


def plain_near_dedup(rows):
    def shingles(text):
        w = words((text or "").translate(LOW))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, label = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i for i in ids if find(i) == i}


def plain_clean(rows, items):
    def alnum(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))

    windows = defaultdict(set)
    for text in items:
        w = alnum(text)
        m = min(10, len(w))
        windows[m] |= {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
    hit = lambda w: any(tuple(w[k : k + m]) in own for m, own in windows.items() if m for k in range(len(w) - m + 1))
    return {i for i, t in rows.items() if not hit(alnum(t))}


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    """Excess over the caps is shared again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    out, left, rest = {}, share * sum(sizes.values()), set(order)
    while rest:
        level = left / sum(weight[s] for s in rest)
        full = {s for s in rest if weight[s] * level > cap * sizes[s]}
        for s in full or rest:
            out[s] = cap * sizes[s] if full else weight[s] * level
            left -= out[s]
        rest -= full or rest
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        out.append(docs.collect())
    return out


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_quality_stage(spark, stages):
    model = queries.quality_model(spark, SF)
    kept = {r.doc_id for r in stages[0] if plain_score(r.text, model) >= 0.3}
    assert {r.doc_id for r in stages[1]} == kept and 0 < len(kept) < len(stages[0])


def test_near_dedup_stage(stages):
    assert {r.doc_id for r in stages[2]} == plain_near_dedup(texts(stages[1])) and len(stages[2]) < len(stages[1])


def test_decontamination_stage(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in stages[3]} == plain_clean(texts(stages[2]), items)


def test_mixing_stage(stages):
    size, taken, longest = Counter(), Counter(), Counter()
    for r in stages[3]:
        size[r.source] += len(words(r.text))
        longest[r.source] = max(longest[r.source], len(words(r.text)))
    before = texts(stages[3])
    for r in stages[4]:
        taken[r.source] += len(words(r.text))
        assert before[r.doc_id] == r.text
    target = plain_targets(size)
    assert max(Counter(r.doc_id for r in stages[4]).values()) <= 2
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in target)


def test_sharding_stage(stages):
    size, slots = Counter(), defaultdict(list)
    for r in stages[5]:
        size[r.shard] += len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
    assert Counter((r.doc_id, r.text) for r in stages[5]) == Counter((r.doc_id, r.text) for r in stages[4])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    largest = max(len((r.text or "").encode()) + 1 for r in stages[5])
    assert max(size.values()) <= 1.02 * sum(size.values()) / 16 + 2 * largest


def test_whole_pipeline(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*spark.read.parquet(f"{SF}/documents.parquet").columns, "shard", "slot"]
    assert Counter((r.doc_id, r.shard) for r in out.collect()) == Counter((r.doc_id, r.shard) for r in stages[5])


def test_mixing_query(spark):
    """Targets by refilling, the tilt's form, and taken words, over the whole table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, size, taken = mix(docs).collect(), Counter(), Counter()
    for r in rows:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
    target = plain_targets(size)
    edge = {s: max((r["size"] for r in rows if r.source == s and r.part), default=0) for s in target}
    assert {(r.doc_id, r["size"]) for r in rows} == {(r.doc_id, len(words(r.text))) for r in docs.collect()}
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r["size"] and abs(taken[r.source] - target[r.source]) <= edge[r.source] / 2 + 1
        assert r.taken == r.copies * r["size"]
    for s in target:
        own = [(r["size"], r.rate) for r in rows if r.source == s and r["size"]]
        free = [math.log(w) / n for n, w in own if 0 < w < 2 and abs(math.log(w)) < 40]
        assert sum(n * w for n, w in own) == pytest.approx(target[s], rel=1e-6) and (not free or max(free) - min(free) < 1e-9)


def test_sharding_query_bytes(spark):
    rows = shard(spark.read.parquet(f"{SF}/documents.parquet"), 16).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r["size"]
    assert max(size.values()) <= 1.02 * sum(size.values()) / 16 + 2 * max(r["size"] for r in rows)


def test_rule_statistics(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged, _ = decision_list.judge(docs, spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality AS label"))
    found = {r.doc_id: r for r in judged.collect()}
    for d in docs.collect():
        w, seen, dup, at = words(d.text), set(), 0, defaultdict(list)
        for line in (d.text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        again = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(5)}
        r = found[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", d.text or "")), dup, len(again))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and (not r.kept if r.base_failed else r.kept == (r.rule == 0))


def test_rule_learner_by_brute_force(spark):
    """The first test of the first rule is the one with the largest FOIL gain among all thresholds."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        bad = i % 3 == 0
        text = " ".join(f"w{rng.integers(0, 40)}" for _ in range(int(rng.integers(12, 40)))) + (" ###" * int(rng.integers(2, 9)) if bad else " #" * int(rng.integers(0, 3)))
        rows.append((i, text, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    own = decision_list.labelled_stats(decision_list.text_stats(docs), docs.select("doc_id", "label"))
    rules = decision_list.learn(own)
    table = own.select("label", "prune", *(c.alias(n) for n, c in decision_list.ratios().items())).toPandas()
    grow = table[~table.prune]

    def gain(test):
        hit = grow[test.stat] > test.threshold if test.above else grow[test.stat] <= test.threshold
        return decision_list._foil_gain(float((hit & (grow.label == 0)).sum()), float((hit & (grow.label == 1)).sum()), float((grow.label == 0).sum()), float((grow.label == 1).sum()))

    cuts = {n: set() for n in decision_list.ratios()}
    for _, part in table.groupby("label"):
        for n in cuts:
            cuts[n] |= {float(np.sort(part[n])[max(math.ceil(len(part) * k / decision_list.BINS) - 1, 0)]) for k in range(1, decision_list.BINS)}
    best = max(gain(decision_list.Test(n, above, c)) for n in cuts for c in cuts[n] for above in (True, False))
    assert rules and gain(rules[0].tests[0]) == pytest.approx(best)
