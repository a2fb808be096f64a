"""Words outside the table of common ones are merged in the Arrow batches, not by a fold in the plan."""

from __future__ import annotations

import public_tokenizers
import tiktoken
from pulseframe.llm import byte_bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_rare_words_need_no_fold(spark):
    encoding = tiktoken.Encoding("50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(VOCABULARY), special_tokens={})
    texts = [f"word{k}x unheard{k * 7919} of " + "ab" * k + " zürich" * (k % 3) for k in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (0, 50):
        coded = byte_bpe.encode(df, VOCABULARY, most)
        plan = coded._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in plan
        assert {r.doc_id: r.ids for r in coded.collect()} == {k: encoding.encode_ordinary(t) for k, t in enumerate(texts)}
