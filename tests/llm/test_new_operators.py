"""Whitening, byte-level BPE and the divergence audit against plain restatements, with their edge cases."""

from __future__ import annotations

import base64
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pulseframe.llm import byte_bpe, divergence, queries, whitening
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoding():
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# op11


def plain_whitening(vectors, components=16):
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v] for v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit - sums / n).astype(float)
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return x, n, sums, values[order], vectors_[:, order], np.trace(centred.T @ centred / n)


def check_whitening(spark, rows, keep):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, n string").repartition(3)
    found = defaultdict(dict)
    for r in whitening.whiten(df).collect():
        assert r.component not in found[r.vec_id]
        found[r.vec_id][r.component] = r
    used = [(i, v) for i, v, *_ in rows if i in keep]
    x, n, sums, values, vectors, trace = plain_whitening([v for _, v in used])
    assert set(found) == {i for i, _ in used}
    for (i, _), own in zip(used, x, strict=True):
        away = [n * a - int(s) for a, s in zip(own, sums, strict=True)]
        wanted = np.array([a / n for a in away]) @ vectors / np.sqrt(values)
        for k, row in found[i].items():
            assert row.n == n and row.deviation == sum(a * a for a in away)
            assert abs(abs(row.whitened) - abs(wanted[k - 1])) < 1e-8
            assert abs(row.explained - values[k - 1] / trace) < 1e-10
            assert row.identity_error < 1e-8
    return found


def test_whitening_equals_a_plain_one(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (60, 5)) @ rng.normal(0, 1, (5, 5))
    rows = [(i, [float(c) for c in v], 1, "a") for i, v in enumerate(base)] + [(100 + i, [float(c) for c in base[0]], 1, None) for i in range(40)]  # copies count once
    rows += [(200, None, 1, "b"), (201, [1.0, None, 2.0, 3.0, 4.0], 1, "b"), (202, [float("nan")] * 5, 1, "b"), (203, [float("-inf")] * 5, 1, "b")]
    found = check_whitening(spark, rows, set(range(60)) | set(range(100, 140)))
    assert {len(v) for v in found.values()} == {5}
    w = {k: np.array([found[i][k].whitened for i in range(60)]) for k in range(1, 6)}
    assert all(np.isclose(w[k] @ w[k] / 60, 1) for k in w) and abs(w[1] @ w[2]) < 1e-6
    products = [found[0][k].whitened * found[100][k].whitened for k in w]
    assert min(products) >= 0  # one sign for all rows


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id string, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([("a", []), ("b", None)], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], schema)).collect() == []
    line = whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 2.0]), (None, [4.0, 2.0]), ("b", [2.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id or "", r.component, r.n) for r in line) == [("", 1, 3), ("a", 1, 3), ("b", 1, 3), ("b", 1, 3)]  # a constant dimension has no component
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], schema))
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([("a", [1e300]), ("b", [2.0])], schema)).collect()


def test_whitening_centres_before_it_multiplies(spark):
    rows = [(f"{i}", [1e9 + i % 7, 1e9 + (i * i) % 11]) for i in range(50)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()
    assert len(found) == 100 and max(r.identity_error for r in found) < 1e-6
    x = np.array(sorted({(64 * int(a), 64 * int(b)) for _, (a, b) in rows}), dtype=object)
    exact = np.cov((x - x[0]).astype(float).T, bias=True)
    assert np.isclose(sum({r.component: r.explained for r in found}.values()), 1)
    assert np.isclose({r.component: r.explained for r in found}[1], np.linalg.eigvalsh(exact)[-1] / np.trace(exact), rtol=1e-9)


def test_op11_on_the_smallest_tables(spark):
    found = queries.op11_embedding_whitening(spark, SF).collect()
    vectors = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert len(found) == 16 * len(vectors) and max(r.identity_error for r in found) < 1e-4
    _, n, _, values, _, trace = plain_whitening(vectors)
    assert {r.n for r in found} == {n}
    for r in found:
        assert abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-4


# op12


def encoded(spark, texts, **how):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, word string, ids int").repartition(3)
    out = byte_bpe.encode(df, VOCABULARY, **how).withColumn("bytes", byte_bpe.decode(F.col("ids"), VOCABULARY))
    assert out.columns[:4] == ["doc_id", "text", "word", "ids"]  # an earlier ids is replaced
    return {r.doc_id: (r.ids, bytes(r.bytes), bytes(r.packed)) for r in out.collect()}


EDGES = [
    None, "", " ", "\n", "a", "   two  blanks and\ttabs \r\n end ", "I'll don't we've it's 'S '", "naïve café Ünïcode ßtraße", "中文字符测试 テスト 한국어", "🙂🙂👩‍👩‍👧 é", "\x00\x01\x7f", "x y z　 w\u0085v",
    "abc" * 500, "a" * 3000, " " * 5000, "=" * 4000, "<|endoftext|> ordinary", "Ⅷ ½ ² ٣٤٥ 12345678901234567890", "ࡰࡱ \U00031350\U00031351x \U00010d40\U00010d41", "Ll1_-\"quoted\"(x);\n\n\n  }", "the the the the",
]


@pytest.mark.parametrize("most", [0, 1 << 15])
def test_bpe_equals_the_library(spark, encoding, most):
    rng = random.Random(3)
    letters = "abcdeéß中 \n'.19ABĲ🙂"
    texts = EDGES + ["".join(rng.choices(letters, k=rng.randrange(1, 80))) for _ in range(60)] + ["".join(rng.choices("qwertyuiopäö", k=3000))]
    found = encoded(spark, texts, most=most)
    for i, text in enumerate(texts):
        ids, decoded, le = found[i]
        assert ids == encoding.encode_ordinary(text or ""), text
        assert decoded == (text or "").encode()
        assert le == np.array(ids, "<u4").tobytes()


def test_bpe_pattern_knows_every_character(spark, encoding):
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(first, min(first + 512, 0x110000)) if not 0xD800 <= c < 0xE000) for first in [*range(0, 0x3400, 512), *range(0xA000, 0xAC00, 512), *range(0xF000, 0x1F000, 512), *range(0x2A400, 0x2F000, 512), *range(0x31000, 0x32600, 512)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    words = {r.doc_id: r.words for r in byte_bpe.split(df).select("doc_id", "words").collect()}
    singles = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    assert singles  # the classes were read off the library; spans show through merges of whole words only
    for i, text in enumerate(texts):
        assert "".join(words[i]) == text
        flat = [t for w in words[i] for t in encoding.encode_ordinary(w)]
        assert flat == encoding.encode_ordinary(text)


def test_bpe_of_an_empty_table_and_repeated_rows(spark, encoding):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(empty, VOCABULARY).collect() == []
    twice = spark.createDataFrame([(1, "Same text")] * 3, "doc_id long, text string")
    assert [r.ids for r in byte_bpe.encode(twice, VOCABULARY).collect()] == [encoding.encode_ordinary("Same text")] * 3


def test_bpe_heap_and_fold_agree(encoding):
    rng = random.Random(8)
    ranks = byte_bpe.ranks(VOCABULARY)
    for _ in range(300):
        word = bytes(rng.choices(b"aaabcdehilnorst", k=rng.randrange(1, 60)))
        assert byte_bpe._heap_merged(word, ranks) == encoding.encode_ordinary(word.decode())


def test_op12_on_the_smallest_tables(spark, encoding):
    import hashlib

    found = {r.doc_id: r for r in queries.op12_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids, row = encoding.encode_ordinary(d.text or ""), found[d.doc_id]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


# op13


def plain_audit(rows, least_docs=3, ranks=200):
    """All terms of all pairs of groups, without sparseness or selection."""
    docs = [tuple("" if c is None else c for c in r) for r in rows]
    split = [(la, so, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))) for t, la, so in docs]
    out = []
    for lang in {la for la, _, _ in split}:
        own = [(so, ts) for la, so, ts in split if la == lang]
        in_docs = Counter(t for _, ts in own for t in set(ts))
        kept = [t for t, n in in_docs.items() if n >= least_docs]
        counts = {so: Counter(t for s, ts in own if s == so for t in ts) for so in {s for s, _ in own}}
        every = Counter(t for _, ts in own for t in ts)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {so: shares(c) for so, c in counts.items()}, shares(every)
        f = lambda a, b: (a - b) ** 2 // b
        for so in counts:
            pairs = [(sum(f(p[so][t], p[other][t]) for t in kept), other) for other in counts if other != so]
            terms = [(f(p[so][t], q[t]), t) for t in kept if counts[so][t] and p[so][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                ordered = sorted(found, key=lambda r: (-r[0], r[1].encode()))[:most]
                out += [(lang, so, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)]
    return sorted(out)


def check_audit(spark, rows, **how):
    df = spark.createDataFrame([(*r, i, "z") for i, r in enumerate(rows)], "text string, lang string, source string, n long, term string").repartition(3)
    assert sorted(map(tuple, divergence.audit(df, **how).collect())) == plain_audit(rows, **how)


def test_audit_equals_a_plain_one(spark):
    rng = random.Random(4)
    terms = ["Alpha", "beta", "gamma", "delta", "Ähre", "ähre", "ärger", "中", "中文", "🙂", "z" * 40, "z" * 39 + "y", "word", "words", "w", "wo"]
    rows = [(" ".join(rng.choices(terms, k=rng.randrange(0, 30))), rng.choice(["de", "en", None, ""]), rng.choice(["a", "b", "c", None, "é"])) for _ in range(60)]
    rows += [(None, "de", "empty"), ("", "fr", "x"), ("1 2 3 [ ] ~", "fr", "y"), ("once", "fr", "x"), (None, None, None)] + [("same same row", "en", "a")] * 5
    check_audit(spark, rows)
    check_audit(spark, rows, least_docs=1, ranks=2)


def test_audit_ties_refine_by_bytes(spark):
    names = [a + b for a in ("", "p", "prefix", "prefixprefix", "é", "🙂") for b in ("a", "aa", "ab", "b", "ba", "é", "中", "zz")]
    rows = [(" ".join(names), "en", "all")] * 3 + [("other words here", "en", "rest")] * 3
    for ranks in (1, 20):
        check_audit(spark, rows, ranks=ranks)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_audit_shares_are_exact_beyond_64_bits(spark):
    got = spark.range(1).selectExpr("20000000000 AS c", "70000000001 AS n", "12345 AS v").select(divergence._share("c")).first()[0]
    assert got == 1 + 1000000000 * 20000000001 // 70000012346


def test_op13_on_the_smallest_tables(spark):
    docs = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_source_divergence(spark, SF).collect())) == plain_audit(docs)
