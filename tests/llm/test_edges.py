"""Very long texts, clashing column names, repeated rows and ties, for every operator that a plain fixture does not stretch."""

from __future__ import annotations

import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pulseframe.llm import line_crf, near_dup
from pulseframe.llm import vectext as V
from pulseframe.llm.decontam import find_contamination
from pulseframe.llm.line_dedup import dedup_lines
from pulseframe.llm.mixing import mix, mixed
from pulseframe.llm.near_dup import drop_near_duplicates, near_duplicates
from pulseframe.llm.quotes import link_quotes
from pulseframe.llm.scratch import in_front, spread_join
from pulseframe.llm.sharding import shard, sharded
from pulseframe.llm.url_filter import filter_urls, rules_frame
from pyspark.sql import functions as F

LONG = "\n".join(f"line {i} of {i % 977} words" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Names that the operators use inside, a very long text twice, repeated rows and ids."""
    rows = [(1, LONG, "a"), (2, LONG + "\nend", "a"), (3, "short text of a few words", "b"), (3, "short text of a few words", "b"), (4, None, None), (5, "", "b"), (3, "another text under the same id here", "c")]
    full = [(i, t, s, 1, 2, 3, 4, 5, "x", "y") for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, size int, slot int, h int, part int, copies int, id string, `row` string")


def test_sharded_keeps_clashing_columns(odd):
    out = sharded(odd, 2).collect()
    assert sorted(Counter(r.doc_id for r in out).items()) == [(1, 1), (2, 1), (3, 3), (4, 1), (5, 1)]
    assert {(r["size"], r.h, r.part, r.id, r.row) for r in out} == {(1, 3, 4, "x", "y")}
    by = {k: sorted(r.slot for r in out if r.shard == k) for k in {r.shard for r in out}}
    assert all(v == list(range(len(v))) for v in by.values()) and shard(odd, 2).count() == len(out)


def test_mixed_keeps_clashing_columns(odd):
    planned, out = mix(odd).collect(), mixed(odd).collect()
    assert mixed(odd).columns == odd.columns and {(r["size"], r.h, r.part, r.id, r.row) for r in out} == {(1, 3, 4, "x", "y")}
    assert len(planned) == odd.count() and all(r.taken <= 2 * r["size"] for r in planned)
    assert {r.doc_id for r in out} <= {1, 2, 3}


def test_near_duplicates_of_long_and_repeated_rows(odd):
    found = {(r.doc_id, r.component_id) for r in near_duplicates(odd).collect()}
    assert found == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}
    out = drop_near_duplicates(odd)
    assert out.columns == odd.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5]


def test_one_row_of_each_repeated_document_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (None, "q r s t u v"), (1, ""), (1, "")]
    out = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == [("1", ""), ("1", ""), ("1", "a b c d e f"), ("None", "q r s t u v")]


def test_pairs_at_the_limit_share_a_bucket():
    """Recall at similarity 0.8, the worst case: of 4,000 pairs (8 of 10 shingles in common up to 80 of 100) all share a bucket."""
    rng = np.random.default_rng(3)
    missed = 0
    for scale in (1, 2, 10):
        texts = []
        for k in range(2 * 670):
            words = [f"w{x}" for x in rng.integers(0, 1 << 30, 10 * scale)]
            texts += [" ".join(words), " ".join(words[: 8 * scale])]  # 1-word shingles: 8 of 10
        batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "t": pa.array([0] * len(texts)), "text": pa.array(texts)})
        keys = np.array([k for out in near_dup._signed(iter([batch]), 1, near_dup.BANDS, near_dup.ROWS, 1) for k in out.column("bands").to_pylist()])
        missed += int((~(keys[0::2] == keys[1::2]).any(axis=1)).sum())
    assert missed == 0


def test_outliers_of_a_large_group(spark):
    """Copies with many edits around one base: links by brute force, also of those that no bucket head settles."""
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(240):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(0, 6)), replace=False):
            words[at] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[k : k + 4]) for k in range(57)} for w in (t.split() for _, t in rows)]
    label = list(range(240))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(240):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: find(i) for i in range(240)} and len({find(i) for i in range(240)}) > 20


def test_span_hashes_of_any_length():
    """A span's hash does not depend on where it stands or on how many bytes the text has."""
    rng = np.random.default_rng(1)
    word = rng.integers(97, 123, 2 * V.CHUNK_BYTES + 77).astype(np.uint8)
    data = np.concatenate([word, [32], np.frombuffer(b"ab cd", np.uint8), [32], word, [32], np.frombuffer(b"cd", np.uint8)]).astype(np.uint8)
    starts, ends, _ = V.word_spans(data, np.array([0, len(data)]), V.SPACE)
    h = V.span_hashes(data, starts, ends)
    assert len(h) == 5 and h[0] == h[3] and h[2] == h[4] and len(set(h.tolist())) == 3


def test_long_texts_in_the_classifier(spark):
    rng = np.random.default_rng(2)
    evidence, pair, firsts = rng.normal(size=3000), rng.normal(size=(2, 2)), np.array([0, 3, 1700, 1701, 3000])
    one = line_crf.messages(evidence, firsts, pair)
    line_crf._BLOCK, block = 7, line_crf._BLOCK
    two = line_crf.messages(evidence, firsts, pair)
    line_crf._BLOCK = block
    assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1])
    data = np.frombuffer(LONG.encode(), np.uint8)
    unary = rng.normal(size=3 * line_crf.OWN + 3)
    whole = line_crf.line_features(data, np.array([0, len(data)]))[0] @ unary
    line_crf._PIECE, piece = 999, line_crf._PIECE
    assert np.allclose(line_crf.evidence_of(data, np.array([0, len(data)]), unary)[0], whole)
    line_crf._PIECE = piece


def test_gradient_of_the_classifier():
    """Of log P(all good) and log(1 - P(all good)), by finite differences with P by enumeration."""
    rng = np.random.default_rng(5)
    width = 3 * line_crf.OWN + 3
    x, theta = rng.normal(size=(7, width)).astype(np.float32) / 5, rng.normal(size=width + 4) / 5
    firsts, good, row, at = np.array([0, 3, 7]), np.array([True, False]), np.array([0] * 3 + [1] * 4), np.array([0, 1, 3, 4, 5])

    def value(theta):
        pair, out = theta[-4:].reshape(2, 2), 0.0
        for d, (a, b) in enumerate(zip(firsts, firsts[1:], strict=False)):
            e, n = x[a:b].astype(float) @ theta[:-4], b - a
            states = [[(k >> i) & 1 for i in range(n)] for k in range(1 << n)]
            logs = np.array([sum(e[i] for i in range(n) if s[i]) + sum(pair[p, q] for p, q in zip(s, s[1:], strict=False)) for s in states])
            p = np.exp(logs[-1] - np.logaddexp.reduce(logs))
            out += np.log(p) if good[d] else np.log(1 - p)
        return out

    weight, gap, joint = line_crf._pull(x, firsts, good, at, row, theta, np.ones(2))
    grad = np.concatenate([x.T @ (weight[row] * gap), np.array([0, 0, 0, weight[row[at]].sum()]) - joint @ weight[row[at]]])
    for k in [0, 5, width - 1, width, width + 1, width + 3]:
        step = np.zeros_like(theta)
        step[k] = 1e-4
        assert grad[k] == pytest.approx((value(theta + step) - value(theta - step)) / 2e-4, abs=1e-3)


def test_urls_with_many_labels(spark):
    urls = ["http://" + "a." * 20_000 + "net/es/x", "http://" + "." * 20_000, "http://net/fr/", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string")
    began = time.monotonic()
    out = filter_urls(pages, rules_frame(spark, [("block", "net", "/es/"), ("block", "net", "/fr/"), ("allow", "com", "/")])).collect()
    assert sorted((r.page_id, r.rule) for r in out if r.rule) == [(0, "net/es/"), (0, "net/es/"), (2, "net/fr/"), (2, "net/fr/")] and len(out) == 8
    assert time.monotonic() - began < 60


def test_quotes_with_long_runs(spark):
    rows = [(1, 0, "u", "hello" + " " * 80_000 + "world"), (1, 1, "v", ">" * 20_000 + " hello world\nyes"), (1, 2, "u", "\n" * 50_000 + "x")]
    out = {r.turn: r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[1].max_depth == 20_000 and out[1].n_linked == 1 and out[2].body == "x"


def test_lines_of_long_texts(spark):
    rows = [(i, LONG if i < 3 else f"own {i}\nline 5 of 5 words", 1, 2) for i in range(5)] + [(2, LONG, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos int, h1 int")
    out = dedup_lines(docs, least_docs=3).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, len(r.kept_text)) for r in out) == Counter([(0, 60_000, 60_000, 0), (1, 60_000, 60_000, 0), (2, 60_000, 60_000, 0), (2, 60_000, 60_000, 0), (3, 2, 1, 5), (4, 2, 1, 5)])
    every_other = "\n".join(f"line {i} of {i % 977} words" if i % 2 else f"mine {i}" for i in range(20_000))
    out = {r.doc_id: r for r in dedup_lines(spark.createDataFrame([(0, LONG), (1, every_other)], "doc_id long, text string"), least_docs=2).collect()}
    assert out[1].kept_text == "\n".join(f"mine {i}" for i in range(0, 20_000, 2)) and out[0].n_dropped == 10_000


def test_contamination_of_long_texts(odd, spark):
    bench = spark.createDataFrame([(1, " ".join(LONG.split()[200_000:200_020]), "x")], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.n_hit) for r in find_contamination(odd, bench).collect()}
    assert found == {(1, 20), (2, 20), (3, 0), (4, 0), (5, 0)}


def test_joins_and_sums_of_hot_keys(spark):
    rows = spark.range(2000).select((F.when(F.col("id") < 900, 1).when(F.col("id") < 1000, None).otherwise(F.col("id"))).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).filter("k is null or k < 1500")
    for small in (0, 10_000):
        inner = spread_join(rows, facts, ["k"], "n", small=small)
        assert inner.columns == ["k", "id", "top"] and inner.count() == 1500 and inner.filter("k is null").count() == 100
        assert spread_join(rows, facts, ["k"], "n", "left", small=small).filter("top is null").count() == 500
    sums = in_front(spark.range(500).withColumn("v", F.lit(2)), [F.col("id").desc()], before=F.col("v"))
    assert {(r.id, r.before) for r in sums.collect()} == {(i, 2 * (499 - i)) for i in range(500)}
