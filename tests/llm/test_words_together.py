"""Words outside the table are merged together, those of the same length in a matrix."""

from __future__ import annotations

import random

import public_tokenizers
from pulseframe.llm import byte_bpe

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_words_together_equal_the_heap():
    rng, table = random.Random(5), byte_bpe.ranks(VOCABULARY)
    letters = "etaoinsrhdlucmf  aaaab0123'-.\n\tßéü漢😀\x00"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(3000)] + ["a", " ", "ab" * 31, "ab" * 32, "x" * 64, "x" * 65, "漢" * 21, "漢" * 40, " the"]
    assert byte_bpe._merged_words(words, VOCABULARY) == [byte_bpe._heap_merged(w.encode(), table) for w in words]
    assert byte_bpe._merged_words([], VOCABULARY) == []


def test_a_vocabulary_without_every_byte(tmp_path):
    import base64

    own = tmp_path / "few.tiktoken"
    own.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate([b"a", b"b", b"ab", b"abab"])))
    assert byte_bpe._merged_words(["abab", "ababa", "bb"], str(own)) == [[3], [3, 0], [1, 1]]
