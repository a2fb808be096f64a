"""Empty tables, very long texts, clashing names and repeated rows, where the other edge tests leave gaps."""

from __future__ import annotations

import pytest
from pulseframe.llm import decision_list, line_crf
from pulseframe.llm.decontam import drop_contaminated, find_contamination
from pulseframe.llm.mixing import mixed
from pulseframe.llm.near_dup import drop_near_duplicates
from pulseframe.llm.quotes import link_quotes
from pulseframe.llm.sharding import sharded
from pulseframe.llm.token_shards import training_order
from pulseframe.llm.url_filter import filter_urls, rules_frame

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark, none):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for out in (mixed(none), sharded(none, 4), drop_near_duplicates(none), drop_contaminated(none, benchmark)):
        assert out.collect() == [] and set(none.columns) <= set(out.columns)
    assert find_contamination(none, benchmark).collect() == []
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), rules_frame(spark, [("block", "net", "/")])).collect() == []
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert line_crf.score(none, line_crf.train(none, labels)).collect() == []
    judged, rules = decision_list.judge(none, labels)
    assert judged.collect() == [] and rules == []


def test_very_long_texts(spark):
    long = "\n".join(f"line {i} of {i % 311} words, and some more" for i in range(50_000))
    docs = spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")
    order = training_order(docs, length=1024, per_shard=64).collect()
    assert sum(r.n_tokens for r in order) > 300_000 and {r.doc_id for r in order} == {1, 2}
    judged, _ = decision_list.judge(docs, spark.createDataFrame([(1, 1)], "doc_id long, label int"))
    found = {r.doc_id: r for r in judged.collect()}
    assert found[1].n_words == 8 * 50_000 and found[2].base_failed
    model = line_crf.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int"))
    assert all(0 <= r.score <= 1 for r in line_crf.score(docs, model).collect())


def test_clashing_names_and_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, 7, 8, "x")] * 3 + [(2, "short", 7, 8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, score int, label string")
    judged, _ = decision_list.judge(docs, spark.createDataFrame([(1, 1, 5)], "doc_id long, label int, n_words int"))
    assert sorted((r.doc_id, r.n_words, r.base_failed) for r in judged.collect()) == [(1, 12, False)] * 3 + [(2, 1, True)]
    scored = line_crf.score(docs, line_crf.train(docs, spark.createDataFrame([(1, 1, 5)], "doc_id long, label int, score int"))).collect()
    assert len(scored) == 4 and len({r.score for r in scored if r.doc_id == 1}) == 1
    again = spark.createDataFrame([(*r[:2], 3, 4, "y") for r in rows], "doc_id long, text string, slot int, shard int, tokens string")
    assert sorted(r.slot for r in training_order(again, length=8, per_shard=4).collect()) == list(range(training_order(again, length=8, per_shard=4).count()))
    messages = spark.createDataFrame([(1, 0, "user", "a b", 5, "z"), (1, 1, "user", "> a b\nc", 5, "z")], "conv_id long, turn long, role string, text string, depth int, body string")
    assert [(r.turn, r.body, r.n_linked) for r in link_quotes(messages).orderBy("turn").collect()] == [(0, "a b", 0), (1, "c", 1)]
    urls = spark.createDataFrame([(1, "http://a.net/es/x", "h", "p", "r", "v")] * 2, "page_id long, url string, host string, path string, rule string, verdict string")
    assert [(r.host, r.rule, r.verdict) for r in filter_urls(urls, rules_frame(spark, [("block", "net", "/es/")])).collect()] == [("a.net", "net/es/", "block")] * 2
