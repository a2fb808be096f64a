"""The training-data operators against plain restatements on small fixtures with nulls, blanks, ties, repeats and empty tables."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pulseframe.llm import decision_list, line_crf
from pulseframe.llm.decontam import drop_contaminated, find_contamination
from pulseframe.llm.line_dedup import dedup_lines
from pulseframe.llm.mixing import mix, mixed
from pulseframe.llm.near_dup import drop_near_duplicates, near_duplicates
from pulseframe.llm.sharding import shard, sharded
from pulseframe.llm.token_shards import permute, read_record, training_order, write_shards
from pulseframe.llm.url_filter import filter_urls, rules_frame

SPACE = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 90))) for _ in range(n)]
    for base in texts[:6]:  # groups of near copies
        for _ in range(rng.randint(2, 14)):
            words = base.split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words).upper())
    texts += ["", None, " \n\t", "one", "ONE", "Zwei drei", "zwei  drei", "é" * 30, "x " * 5000]
    return [(i, t, "en", rng.choice(["a", "b", "c", None]), 0) for i, t in enumerate(texts)] + [(7, texts[7], "en", "a", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, width):
    words = re.split(SPACE, lower(text).strip(" \t\n\x0b\x0c\r")) if lower(text).strip(" \t\n\x0b\x0c\r") else []
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, empty, width):
    sets = {i: shingles(t, width) for i, t, *_ in corpus()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    found = near_duplicates(docs, width).collect()
    assert len(found) == len(corpus())
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found} == {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert near_duplicates(empty).count() == 0
    assert {r.doc_id for r in drop_near_duplicates(docs, width).collect()} == {i for i in sets if find(i) == i}


def test_contamination(spark, docs, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = {i: t for i, t, *_ in corpus()}
    items = [(1, " ".join(texts[3].split()[5:20])), (2, "ONE"), (3, None), (4, ""), (5, texts[9]), (10, "x x x"), (None, "w1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for i, t, *_ in corpus():
        words, hit, found = word.findall(lower(t)), set(), set()
        for item, s in items:
            own = word.findall(lower(s))
            m = min(10, len(own))
            windows = {tuple(own[k : k + m]) for k in range(len(own) - m + 1)} if item is not None and m else set()
            for k in range(len(words) - m + 1):
                if tuple(words[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found.add(item)
        expected.add((i, len(words), len(hit), tuple(sorted(found))))
    for block in (1 << 20, 40):
        out = find_contamination(docs, bench, 10, block_bytes=block).collect()
        assert len(out) == len(corpus()) and {(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in out} == expected
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _, h, _ in expected if not h}
    assert find_contamination(empty, bench).count() == 0 and find_contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_line_dedup(spark, empty):
    rows = [(i, f"Shared line \nown {i}\n\n shared LINE", "en", "a", 0) for i in range(5)] + [(9, None, "en", "a", 0), (10, "", "en", "a", 0), (11, "\n".join(f"l{k}" for k in range(200)) + "\nshared line", "en", "a", 0)]
    out = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, SCHEMA), least_docs=3).collect()}
    assert out[0].kept_text == "own 0\n" and (out[0].n_lines, out[0].n_dropped) == (4, 2)
    assert (out[9].n_lines, out[9].n_dropped, out[9].kept_text) == (1, 0, "") and out[10].kept_text == ""
    assert out[11].n_dropped == 1 and out[11].kept_text.endswith("l199")
    first = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, SCHEMA), least_docs=3, keep_first=True).collect()}
    assert first[0].kept_text == "Shared line \nown 0\n" and first[1].n_dropped == 2
    assert dedup_lines(empty).count() == 0


def test_text_statistics(docs):
    expected = set()
    for i, t, *_ in corpus():
        words = [w for w in re.split(SPACE, t or "") if w]
        windows = defaultdict(list)
        for k in range(len(words) - 4):
            windows[tuple(words[k : k + 5])].append(k)
        repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
        expected.add((i, len(words), sum(map(len, words)), len(repeated)))
    assert {(r.doc_id, r.n_words, r.word_chars, r.n_repeat_words) for r in decision_list.text_stats(docs).collect()} == expected


def test_decision_list_learns_a_threshold(spark, empty):
    rows = [(i, ("AAA " if i % 2 else "aaa ") * 3 + " ".join(f"w{i}x{k}" for k in range(20)), "en", "a", 0) for i in range(200)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, label int")
    out, rules = decision_list.judge(spark.createDataFrame(rows, SCHEMA), labels)
    assert rules and {(r.doc_id % 2, r.kept) for r in out.collect()} == {(0, True), (1, False)}
    none, rules = decision_list.judge(empty, labels.limit(0))
    assert none.count() == 0 and not rules


def test_classifier(spark, docs, empty):
    rows = [(i, ("good plain words here\nand more of them" if i % 2 else "### $$$ %%% ||| <<<\n&&& *** 111") + f" {i}", "en", "a", 0) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, label int")
    own = spark.createDataFrame(rows, SCHEMA)
    model = line_crf.train(own, labels)
    scores = {r.doc_id: r.score for r in line_crf.score(own, model).collect()}
    assert min(s for i, s in scores.items() if i % 2) > 0.6 > 0.4 > max(s for i, s in scores.items() if not i % 2)
    every = line_crf.score(docs, model).collect()
    assert len(every) == len(corpus()) and all(0 <= r.score <= 1 for r in every)
    assert line_crf.score(empty, line_crf.train(empty, labels.limit(0))).count() == 0 and line_crf.keep_good(own, model).columns == own.columns


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    evidence, pair = rng.normal(size=5), rng.normal(size=(2, 2))
    ahead, behind = line_crf.messages(evidence, np.array([0, 5]), pair)
    weight = {}
    for k in range(32):
        s = [(k >> i) & 1 for i in range(5)]
        weight[tuple(s)] = np.exp(sum(e for e, x in zip(evidence, s, strict=True) if x) + sum(pair[a, b] for a, b in zip(s, s[1:], strict=False)))
    total = sum(weight.values())
    for i in range(5):
        assert 1 / (1 + np.exp(-(ahead + behind)[i])) == pytest.approx(sum(w for s, w in weight.items() if s[i]) / total)


def test_urls(spark):
    urls = ["https://www.Example.com/en/a?x", "http://example.com/en/", "http://example.com/de", "ftp://a.net/es/b#c", "a.net/es/", None, "://", "https://net/fr/", "http://xnet/fr/", "http://a.com"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", None, "/")]
    out = {r.page_id: (r.rule, r.verdict) for r in filter_urls(pages, rules_frame(spark, rules)).collect()}
    assert out == {0: ("www.example.com/en/", "allow"), 1: ("example.com/en/", "block"), 2: ("com/", "allow"), 3: ("net/es/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("net/fr/", "block"), 8: (None, "allow"), 9: (None, "allow")}


def test_mixing(docs, empty):
    out = mix(docs).collect()
    assert len(out) == len(corpus())
    taken, target = defaultdict(int), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    edge = {s: max((r.size for r in out if r.source == s and r.part), default=0) for s in target}
    assert all(abs(taken[s] - target[s]) <= edge[s] / 2 + 1 for s in target)  # whole documents only
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in out))
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in mix(docs).collect())
    spread = mixed(docs)
    assert spread.columns == docs.columns and spread.count() == sum(r.copies for r in out)
    assert mix(empty).count() == 0


def test_sharding(docs, empty):
    out = shard(docs, 4).collect()
    assert len(out) == len(corpus())
    slots, texts = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        texts[r.h].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    carried = sharded(docs, 4)
    assert {r.doc_id: r.text for r in carried.collect()} == {i: t for i, t, *_ in corpus()}
    assert shard(empty).count() == 0


def test_hot_group_is_cut_only_when_too_large(spark):
    rows = [(i, "same text " * 20 if i % 3 == 0 else f"text {i} " * 20, "en", "a", 0) for i in range(900)]
    out = shard(spark.createDataFrame(rows, SCHEMA), 4).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in out]
    assert len(sizes) == 4 and max(sizes) < 1.1 * sum(sizes) / 4


def test_permutation_and_shards(spark, docs, tmp_path):
    for n in (1, 2, 5, 1000):
        assert sorted(permute(np.arange(n), n, 3).tolist()) == list(range(n))
    ordered = training_order(docs, length=64, per_shard=32)
    rows = {r.slot: r for r in ordered.collect()}
    assert sorted(rows) == list(range(len(rows)))
    manifest = write_shards(ordered, f"file://{tmp_path}/out", 64, 32).collect()
    assert sum(r.records for r in manifest) == len(rows)
    for slot in (0, 1, len(rows) // 2, len(rows) - 1):
        assert read_record(f"file://{tmp_path}/out", slot, 64, 32)[: rows[slot].n_tokens].tobytes() == rows[slot].tokens
    assert training_order(docs.limit(0)).count() == 0


def test_order_does_not_depend_on_splits(spark):
    rows = [(i // 2 if i % 5 else None, None if i == 3 else f"text {i % 70} " * (i % 40)) for i in range(200)] + [(7, "again " * 30)] * 90
    found = []
    for n, own in ((1, rows), (3, rows[::-1]), (11, rows[100:] + rows[:100])):
        docs = spark.createDataFrame(own, "doc_id long, text string").repartition(n)
        found.append(sorted((r.slot, r.doc_id is None, r.doc_id, r.chunk, bytes(r.tokens)) for r in training_order(docs, length=16, per_shard=32).collect()))
    assert found[0] == found[1] == found[2]


def test_quantiles(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 3 == 0), float(rng.integers(0, 30)), float(rng.normal()), 1.0) for i in range(500)]
    wanted = {}
    for k, name in enumerate("abc", 1):
        cuts = set()
        for label in (0, 1):
            own = sorted(r[k] for r in rows if r[0] == label)
            cuts |= {own[-(-q * len(own) // decision_list.BINS) - 1] for q in range(1, decision_list.BINS)}
        wanted[name] = sorted(cuts)
    for n in (1, 7):
        table = spark.createDataFrame(rows, "label int, a double, b double, c double").repartition(n)
        assert decision_list.quantiles(table, ["a", "b", "c"]) == wanted
    assert decision_list.quantiles(table.limit(0), ["a"]) == {"a": []}
