"""Quotes of parts of messages: some lines, some paragraphs, a part of a line, a short line."""

from __future__ import annotations

import random
import re

from pulseframe.llm import queries
from pulseframe.llm.quotes import link_quotes

SCHEMA = "conv_id long, turn long, role string, text string"
FIRST = "The first line of it.\nThe second line, which is longer.\nWhy?\n\nAnother paragraph of text.\n\nThe last one."
QUOTES = ["> the second line, which is longer.\n> Why?", "> The first line of it.\n> The second line, which is longer.", "> Another paragraph of text.\n>\n> The last one.", "> second line", "> Why?", "> The second line, which\n> is longer.", "> never said by anyone"]


def rows():
    out = [(1, 0, "user", FIRST), (1, 1, "assistant", "An answer.")]
    return out + [(1, 2 + i, "user", q + f"\nreply number {i}") for i, q in enumerate(QUOTES)]


def test_parts_of_a_message(spark):
    found = {r.turn: (r.n_quotes, r.n_linked, r.parent_turn) for r in link_quotes(spark.createDataFrame(rows(), SCHEMA), min_chars=1).collect()}
    assert found == {0: (0, 0, None), 1: (0, 0, 0), **{t: (1, 1, 0) for t in range(2, 8)}, 8: (1, 0, 7)}


def test_the_query_has_no_shortest_length(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.QUERIES["op1_quotation_linking"](spark, str(tmp_path)).collect()
    assert {r.turn: r.parent_turn for r in out if r.n_quotes} == {**{t: 0 for t in range(2, 8)}, 8: 7}


def test_random_word_runs(spark):
    rng, made, wanted = random.Random(4), [], {}
    words = lambda text: re.findall(r"\w+|[^\w\s]", text.lower())
    for conv in range(4):
        said = []
        for t in range(25):
            body = "\n".join(" ".join(rng.choices(["a", "b", "c", "d,", "e."], k=rng.randint(3, 9))) for _ in range(rng.randint(1, 4)))
            text = body
            if said and rng.random() < 0.7:
                own = re.split(r"\s+", rng.choice(said))
                at = rng.randrange(len(own))
                part = " ".join(own[at : at + rng.randint(1, 12)])
                whole = lambda b: part in [" ".join(b.split()), *b.split("\n")]  # noqa: B023, E731
                inside = lambda b: any(words(b)[i : i + len(words(part))] == words(part) for i in range(len(words(b))))  # noqa: B023, E731
                hits = [i for i, b in enumerate(said) if whole(b)] or [i for i, b in enumerate(said) if inside(b)]
                wanted[conv, t] = max(hits)
                text = "> " + part + "\n" + body
            made.append((conv, t, "user", text))
            said.append(body)
    out = link_quotes(spark.createDataFrame(made, SCHEMA), min_chars=1).collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in out if r.n_quotes} == wanted
