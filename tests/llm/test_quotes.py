"""Quotation linking against a plain restatement."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pulseframe.llm.quotes import link_quotes, parse
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def normal(text):
    return re.sub(r"[\s\xa0]+", " ", text).lower().strip(" ")


def runs_of(text):
    out = []
    for line in re.split(r"\r?\n", text or ""):
        found = re.match(r"^[ \t]*((?:>[ \t]?)+)", line)
        depth = found.group(1).count(">") if found else 0
        body = line[found.end() :] if found else line
        if out and out[-1][0] == depth:
            out[-1][1].append(body)
        else:
            out.append((depth, [body]))
    return [(d, "\n".join(ls)) for d, ls in out]


def expected(messages, least=8):
    by_conv = defaultdict(list)
    for m in messages:
        by_conv[m[0]].append(m)
    out = []
    for conv, own in by_conv.items():
        parsed = {}
        pieces = defaultdict(set)
        for _, turn, role, text in own:
            runs = runs_of(text)
            body = "\n".join(b.strip() for d, b in runs if d == 0).strip()
            quotes = [(d, normal(b)) for d, b in runs if d > 0 and normal(b)]
            parsed[(turn, role, text)] = body, quotes
            if turn is not None and body:
                pieces[turn] |= {normal(body)}
                pieces[turn] |= {normal(p) for p in [*re.split(r"\n\s*\n", body), *body.split("\n")] if len(normal(p)) >= least}
        turns = sorted({m[1] for m in own}, key=lambda t: (t is not None, t or 0))
        quoted = {}
        facts = {}
        for _, turn, role, text in own:
            body, quotes = parsed[(turn, role, text)]
            links = []
            for d, q in quotes:
                earlier = [t for t in turns if t is not None and turn is not None and t < turn and q in pieces[t]]
                links.append((d, max(earlier) if earlier else None))
            first = next((t for d, t in links if d == 1 and t is not None), None)
            if first is not None:
                quoted[turn] = max(first, quoted.get(turn, first))
            facts[(turn, role, text)] = (len(links), sum(t is not None for _, t in links), max((d for d, _ in links), default=0))
        parent = {t: (quoted.get(t, turns[i - 1]) if i else None) for i, t in enumerate(turns)}
        children = defaultdict(list)
        for i, t in enumerate(turns):
            if i:
                children[parent[t]].append(t)
        order, depth, stack = [], {}, [(turns[0], 0)]
        while stack:
            t, d = stack.pop()
            order.append(t)
            depth[t] = d
            stack += [(c, d + 1) for c in reversed(children[t])]
        for _, turn, role, text in own:
            out.append((conv, turn, role, parsed[(turn, role, text)][0], *facts[(turn, role, text)], parent[turn], depth[turn], order.index(turn)))
    return out


def made(n_conv, n_turns, seed):
    """Conversations in which messages quote earlier bodies, lines, paragraphs, unknown text and quotes of quotes."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    rows = []
    for c in range(n_conv):
        said = []
        for t in range(n_turns if c else 6 * n_turns):
            parts = []
            if said and rng.random() < 0.5:
                for _ in range(rng.randint(1, 2)):
                    source = rng.choice(said[-6:])
                    kind = rng.random()
                    piece = source if kind < 0.5 else rng.choice(source.split("\n")) if kind < 0.8 else "nobody said this"
                    mark = rng.choice(["> ", ">", ">> ", "> > "])
                    parts.append("\n".join(mark + line.upper() for line in piece.split("\n")))
            body = "\n".join(" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))
            parts.append(rng.choice(["", "\n"]) + body)
            rows.append((c, t, rng.choice(["user", "assistant"]), "\n".join(parts)))
            said.append(body)
    return rows


def answer(spark, rows, **kw):
    return sorted((tuple(r) for r in link_quotes(spark.createDataFrame(rows, SCHEMA), **kw).collect()), key=repr)


def test_equals_restatement(spark):
    rows = made(6, 14, 3)
    assert answer(spark, rows, min_chars=8) == sorted(expected(rows), key=repr)


def test_nulls_repeats_and_blanks(spark):
    rows = [
        (None, 0, "user", "a first message"), (None, 1, "user", "> a first message\nyes"), (None, 1, "user", "> a first message\nyes"),
        (1, None, "user", "hello there all"), (1, 0, None, None), (1, 1, "user", "> hello there all\n>\n>> x\nno"), (1, 2, "user", "> > \n"), (2, 5, "user", ""),
    ]
    assert answer(spark, rows, min_chars=8) == sorted(expected(rows), key=repr)
    assert answer(spark, []) == []


def test_parse_depths(spark):
    text = "a\n> b\n> c\n>> d\n\n> e"
    found = spark.range(1).select(parse(F.lit(text)).alias("p")).first().p
    assert [(r.depth, r.body) for r in found] == [(0, "a"), (1, "b\nc"), (2, "d"), (0, ""), (1, "e")]
    long = "\n".join("> x" if i % 2 else "y" for i in range(4000))
    assert spark.range(1).select(F.size(parse(F.lit(long))).alias("n")).first().n == 4000
