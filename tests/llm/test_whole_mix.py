"""The mix holds whole texts only, and its words are as near to the targets as the document at the threshold lets them."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pulseframe.llm.mixing import mix, mixed


def test_no_text_is_cut(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(f"w{rng.randrange(99)}  x" for _ in range(rng.randint(40, 90))), "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.doc_id: r for r in mix(docs).collect()}
    assert any(r.part > 0 for r in plan.values())
    out = mixed(docs).collect()
    texts = {i: t for i, t, _ in rows}
    assert all(r.text == texts[r.doc_id] for r in out)
    times, words, edge = Counter(r.doc_id for r in out), defaultdict(int), defaultdict(int)
    for i, r in plan.items():
        assert times[i] == r.copies <= 2 and r.taken == times[i] * r.size
        words[rows[i][2]] += times[i] * r.size
        edge[rows[i][2]] = max(edge[rows[i][2]], r.size * (r.part > 0))
    assert all(abs(words[r.source] - r.target) <= edge[r.source] / 2 + 1 for r in plan.values())
