"""The training order against a plain encoder, a plain numbering and the permutation in whole numbers."""

from __future__ import annotations

import base64
import random

import numpy as np
import tiktoken
from pulseframe.llm import token_shards as T
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def plain_permuted(i, n, key):
    """The slot of sequence i, step by step: a balanced Feistel network of six rounds, walked until the number is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = [int(k) for k in np.random.default_rng(key).integers(0, 1 << 63, 6, dtype=np.uint64)]
    while True:
        left, right = i >> half, i & ((1 << half) - 1)
        for k in keys:
            f = (right + k) * 0x9E3779B97F4A7C15 & MASK
            f ^= f >> 29
            f = f * 0xBF58476D1CE4E5B9 & MASK
            left, right = right, left ^ ((f >> 32) & ((1 << half) - 1))
        i = left << half | right
        if i < n:
            return i


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        slots = T.permute(np.arange(n), n, 99).tolist()
        assert slots == [plain_permuted(i, n, 99) for i in range(n)] and sorted(slots) == list(range(n))


def test_order_equals_a_plain_one(spark):
    rng = random.Random(2)
    with open(T.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("plain", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(rng.choice([None, *range(9)]), rng.choice([None, "", "one two three", "Ünï 🙂" * rng.randrange(1, 9), " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(1, 60)))])) for _ in range(40)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    listed = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    sequences = []
    for r in listed:
        tokens = [*encoding.encode_ordinary(r.text or ""), T.END]
        sequences += [(r.doc_id, c, tokens[at : at + 16]) for c, at in enumerate(range(0, len(tokens), 16))]
    n = len(sequences)
    wanted = {plain_permuted(i, n, 5): own for i, own in enumerate(sequences)}
    found = {r.slot: r for r in T.training_order(docs, length=16, per_shard=8, key=5).collect()}
    assert sorted(found) == list(range(n))
    for slot, (doc_id, chunk, tokens) in wanted.items():
        r = found[slot]
        assert (r.shard, r.offset, r.doc_id, r.chunk, r.n_tokens) == (slot // 8, slot % 8 * 32, doc_id, chunk, len(tokens))
        assert np.frombuffer(r.tokens, "<u2").tolist() == tokens
