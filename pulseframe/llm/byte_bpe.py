"""Byte-level BPE: encoding and decoding by Spark's higher-order functions.

A text is split by the vocabulary's pattern. A word is an array of its bytes, each written as the character of that number, and
a fold over it merges, step by step, the pair of neighbours whose bytes together have the lowest rank, the leftmost of several.
The ranks are a literal of the plan: an array of small maps, addressed by the CRC of the bytes, since one large map would be
searched from its start.

The commonest distinct words of all texts are folded once, into a table of bounded size. Arrow batches put the words' tokens in the
texts' order and merge the other distinct words: those of the same number of bytes together, one merge of each at a time, and long ones by
a heap. So no word and no text moves, and the table changes only the work.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from pulseframe.llm.scratch import forget, parallelism, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Letters and numbers of Unicode 14 to 16, which the tokenizer's pattern knows and the regular expressions of Java 17 do not.
_NEW_LETTERS = (
    "870-887 889-88e 8b5-8b5 8c8-8c9 c5d-c5d cdd-cdd 170d-170d 171f-171f 1b4c-1b4c 1c89-1c8a 2c2f-2c2f 2c5f-2c5f 9ffd-9fff a7c0-a7c1 a7cb-a7cd a7d0-a7d1 a7d3-a7d3 a7d5-a7dc "
    "a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 105c0-105f3 10780-10785 10787-107b0 107b2-107ba 10d4a-10d65 "
    "10d6f-10d85 10ec2-10ec4 10f70-10f81 11071-11072 11075-11075 1123f-11240 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11740-11746 "
    "11ab0-11abf 11bc0-11be0 11f02-11f02 11f04-11f10 11f12-11f33 12f90-12ff0 1342f-1342f 13441-13446 13460-143fa 16100-1611d 16a70-16abe 16d40-16d6c 18cff-18cff 1aff0-1aff3 "
    "1aff5-1affb 1affd-1affe 1b11f-1b122 1b132-1b132 1b155-1b155 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e5d0-1e5ed 1e5f0-1e5f0 1e7e0-1e7e6 1e7e8-1e7eb "
    "1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 2ebf0-2ee5d 31350-323af"
)
_NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 11f50-11f59 16130-16139 16ac0-16ac9 16d70-16d79 1ccf0-1ccf9 1d2c0-1d2d3 1e4f0-1e4f9 1e5f1-1e5fa"


def _newer(listed: str) -> str:
    """A character class of the listed ranges, behind one range that turns older characters away at once."""
    return r"[\x{870}-\x{323af}&&[" + "".join(r"\x{%s}-\x{%s}" % tuple(r.split("-")) for r in listed.split()) + "]]"


_L, _N, _S = r"\p{L}" + _newer(_NEW_LETTERS), r"\p{N}" + _newer(_NEW_NUMBERS), r"\p{IsWhite_Space}"
#: The vocabulary's pattern with its classes spelt out, as Java reads \s and \p otherwise. Classes are tried from the commonest on, and never given back.
PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?[a-zA-Z{_L}]++| ?[0-9{_N}]++| ?[^{_S}{_L}{_N}]++|{_S}+(?![^{_S}])|{_S}++"

_NO_RANK = (1 << 31) - 1
#: At most so many words are in the table of the plan, each of at most so many characters.
TABLE_WORDS, TABLE_CHARS = 1 << 16, 32
#: A task remembers the tokens of up to so many other words, each of at most TABLE_CHARS characters.
_REMEMBERED = 1 << 16
_RANK_BUCKETS = 1 << 14


@lru_cache(maxsize=2)
def ranks(vocabulary: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base64 and its rank in each line."""
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _bucketed(entries: dict[str, object], buckets: int, kind: str) -> Column:
    """A literal array of maps; a key is in the map that its CRC modulo the number of buckets names."""
    maps: list[dict[str, object]] = [{} for _ in range(buckets)]
    for key, value in entries.items():
        maps[zlib.crc32(key.encode()) % buckets][key] = value
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), f"array<map<string,{kind}>>")


def _found(table: Column, key: Column, buckets: int) -> Column:
    return F.try_element_at(F.get(table, (F.crc32(key.cast("binary")) % buckets).cast("int")), key)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bytes_of(word: Column) -> Column:
    """The bytes of a string as characters 0 to 255."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def _rank(table: Column, part: Column) -> Column:
    return _found(table, part, _RANK_BUCKETS)


def _state(parts: Column, following: Column) -> Column:
    return _let(following, lambda f: F.struct(parts.alias("parts"), f.alias("next"), F.array_min(f).alias("low")))


def _merged(state: Column, p: Column, table: Column) -> Column:
    """The state after its parts p and p + 1 have become one: next[i] is the rank of part i with the part after it, low the least of them."""
    parts, following, n = state["parts"], state["next"], F.size(state["parts"])
    either = lambda s: F.array(F.coalesce(_rank(table, s), F.lit(_NO_RANK)))

    def with_joined(joined: Column) -> Column:
        last = either(F.concat(joined, F.get(parts, p + 1)))
        around = F.when(p > 1, F.concat(F.slice(following, F.lit(1), p - 2), either(F.concat(F.get(parts, p - 2), joined)), last)).otherwise(last)
        return _state(F.concat(F.slice(parts, F.lit(1), p - 1), F.array(joined), F.slice(parts, p + 2, n)), F.concat(around, F.slice(following, p + 2, n)))

    return _let(F.concat(F.get(parts, p - 1), F.get(parts, p)), with_joined)


def _folded(word: Column, table: Column) -> Column:
    """The ranks of the parts that the ranked merges leave of a word of bytes."""

    def step(state: Column, _: Column) -> Column:
        return F.when(state["low"] == _NO_RANK, state).otherwise(_let(F.array_position(state["next"], state["low"]).cast("int"), lambda p: _merged(state, p, table)))

    def merges(parts: Column) -> Column:
        pairs = F.transform(parts, lambda c, i: F.coalesce(_rank(table, F.concat(c, F.get(parts, i + 1))), F.lit(_NO_RANK)))
        return F.aggregate(F.sequence(F.lit(2), F.size(parts)), _state(parts, pairs), step, lambda state: F.transform(state["parts"], lambda s: _rank(table, s)))

    whole = _rank(table, word)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(_let(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)), merges))


def _heap_merged(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs and links between parts: the work grows with n log n."""
    if word in table:
        return [table[word]]
    ends = list(range(1, len(word) + 1))
    after, before, gone = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), bytearray(len(word))

    def pair(i: int) -> tuple[int, int, int] | None:
        j = after[i]
        rank = table.get(word[i : ends[j]]) if j < len(word) else None
        return None if rank is None else (rank, i, ends[j])

    heap = [p for p in map(pair, range(len(word))) if p]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = after[i] if not gone[i] else len(word)
        if j == len(word) or ends[j] != end:
            continue  # one of the two has been merged otherwise
        gone[j], ends[i], after[i] = 1, end, after[j]
        if after[i] < len(word):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heappush(heap, p)
    out, i = [], 0
    while i < len(word):
        out.append(table[word[i : ends[i]]])
        i = after[i]
    return out


#: Words of up to so many bytes are merged together, in matrices of up to so many parts; longer ones go by the heap.
TOGETHER_BYTES, _MATRIX = 64, 1 << 19


@lru_cache(maxsize=2)
def _pair_ranks(vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(rank of each byte, rank of each pair of bytes, sorted keys of pairs of tokens, their ranks): a key is first << 32 | second. None if a byte is no token.

    As every byte is a token, the parts of a word always are, and a pair of parts has a rank if and only if it is listed here.
    """
    table = ranks(vocabulary)
    single = [table.get(bytes([b])) for b in range(256)]
    if None in single:
        return None
    found = [(x << 32 | y, rank) for token, rank in table.items() for k in range(1, len(token)) if (x := table.get(token[:k])) is not None and (y := table.get(token[k:])) is not None]
    keys, values = np.array(sorted(found), np.int64).reshape(-1, 2).T
    first = np.array([[table.get(bytes([a, b]), _NO_RANK) for b in range(256)] for a in range(256)], np.int32)
    return np.array(single, np.int32), first, np.append(keys, -1), np.append(values, _NO_RANK).astype(np.int32)


def _merged_together(words: list[bytes], vocabulary: str) -> list[list[int]]:
    """The same merges of words of the same length: in each step every word that still has a pair with a rank loses one part, so the rows of the matrix stay equally long."""
    byte, first, keys, values = _pair_ranks(vocabulary)
    out: list[list[int]] = [[] for _ in words]
    data = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
    parts, at = byte[data], np.arange(len(words))
    pairs = first[data[:, :-1], data[:, 1:]]
    while len(at):
        low = pairs.argmin(axis=1) if pairs.shape[1] else np.zeros(len(at), np.int64)
        rank = pairs[np.arange(len(at)), low] if pairs.shape[1] else np.full(len(at), _NO_RANK)
        done = rank == _NO_RANK
        if done.any():
            for i, ids in zip(at[done].tolist(), parts[done].tolist(), strict=True):
                out[i] = ids
            at, parts, pairs, low, rank = (x[~done] for x in (at, parts, pairs, low, rank))
        n, width = parts.shape
        if not n:
            break
        row = np.arange(n)
        parts[row, low] = rank
        keep = np.ones((n, width), bool)
        keep[row, low + 1] = False
        parts = parts[keep].reshape(n, width - 1)
        keep = np.ones((n, width - 1), bool)
        keep[row, low] = False
        pairs = pairs[keep].reshape(n, width - 2)
        for left in (low - 1, low):
            own = row[(left >= 0) & (left < width - 2)]
            p = left[own]
            key = parts[own, p].astype(np.int64) << 32 | parts[own, p + 1]
            where = np.searchsorted(keys[:-1], key)
            pairs[own, p] = np.where(keys[where] == key, values[where], _NO_RANK)
    return out


def _merged_words(words: list[str], vocabulary: str) -> list[list[int]]:
    """The tokens of each word."""
    table = ranks(vocabulary)
    coded = [w.encode() for w in words]
    out: list[list[int]] = [[] for _ in words]
    alike: dict[int, list[int]] = {}
    for i, word in enumerate(coded):
        if (whole := table.get(word)) is not None:
            out[i] = [whole]
        elif len(word) > TOGETHER_BYTES or _pair_ranks(vocabulary) is None:
            out[i] = _heap_merged(word, table)
        else:
            alike.setdefault(len(word), []).append(i)
    for size, own in alike.items():
        most = max(1, _MATRIX // size)
        for k in range(0, len(own), most):
            some = own[k : k + most]
            for i, ids in zip(some, _merged_together([coded[i] for i in some], vocabulary), strict=True):
                out[i] = ids
    return out


#: Words that are put together at a time; a text with more is a part of its own.
_WORDS = 1 << 18


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about _WORDS words."""
    ends = np.asarray(batch.column("words").offsets, np.int64)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + _WORDS, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _assembled(batches: Iterator[pa.RecordBatch], known: Broadcast, vocabulary: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns, ids and packed: each text's words, in order, replaced by their tokens. Every distinct word of a run of rows is looked up once."""
    common = known.value
    recent: dict[str, list[int]] = {}
    for part in (p for batch in batches for p in _parts(batch)):
        coded = part.column("words").flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        tokens = [common.get(w) or recent.get(w) for w in words]
        other = [i for i, t in enumerate(tokens) if t is None]
        for i, ids in zip(other, _merged_words([words[i] for i in other], vocabulary), strict=True):
            tokens[i] = ids
            if len(words[i]) <= TABLE_CHARS:
                if len(recent) >= _REMEMBERED:
                    recent.clear()
                recent[words[i]] = ids
        sizes = np.array([len(t) for t in tokens], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.array([i for t in tokens for i in t], np.int32)
        code = np.asarray(coded.indices)
        upto = np.concatenate([[0], np.cumsum(sizes[code])]) if len(code) else np.zeros(1, np.int64)
        ids = flat[np.arange(upto[-1]) + np.repeat(starts[code] - upto[:-1], sizes[code])]
        offsets = np.asarray(part.column("words").offsets, np.int64)
        ends = upto[offsets - offsets[0]]
        packed = pa.array([ids[x:y].astype("<u4").tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), lists, packed], names=[*columns, "ids", "packed"])


def split(docs: DataFrame) -> DataFrame:
    """docs with `words`, the matches of the pattern in text in order; null texts have none."""
    return docs.withColumn("words", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PATTERN), F.lit(0)))


def _common_words(texts: DataFrame, most: int) -> DataFrame:
    """(word) of the words in most texts, at most `most`: those from a number of texts on, in steps of an eighth of a power of two."""
    counts = split(texts).select(F.explode(F.array_distinct("words")).alias("word")).filter(F.length("word") <= TABLE_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "words")
    least, total = None, 0
    for step, n in sorted(((r.step, r["count"]) for r in counts.groupBy("step").count().collect()), reverse=True):  # under 512 rows
        total += n
        if total > most:
            break
        least = step
    out = written(counts.filter(F.lit(False) if least is None else F.col("step") >= least).select("word").repartition(parallelism(texts.sparkSession), "word"), "common")
    forget(counts)
    return out


def word_table(texts: DataFrame, vocabulary: str = VOCABULARY, most: int = TABLE_WORDS) -> dict[str, list[int]]:
    """The tokens of the commonest words of texts(text), at most `most` words of up to TABLE_CHARS characters: bounded by parameters, whatever the input."""
    table = _rank_literal(vocabulary)
    common = _common_words(texts, most)
    found = common.select("word", F.element_at(F.transform(F.array(table), lambda t: _folded(_bytes_of(F.col("word")), t)), 1).alias("ids")).collect()
    forget(common)
    return {r.word: r.ids for r in found}


def _rank_literal(vocabulary: str) -> Column:
    return _bucketed({token.decode("latin-1"): rank for token, rank in ranks(vocabulary).items()}, _RANK_BUCKETS, "int")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, most: int = TABLE_WORDS, keep: Sequence[str] | None = None) -> DataFrame:
    """docs, or its columns `keep`, with `ids`, the token ids of text as an array, and `packed`, the same as little-endian unsigned 32-bit integers: every match
    of the pattern encoded by itself, without special tokens.

    Null and empty texts have no ids. Repeated rows are encoded each. A column `words` must not be in docs; `ids` and `packed` are replaced
    by the last columns. Texts are encoded whole, one in a task. An empty table gives an empty result.
    """
    common = word_table(docs.select("text"), vocabulary, most)
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "packed")]
    schema = StructType([*(docs.schema[c] for c in columns), StructField("ids", ArrayType(IntegerType())), StructField("packed", BinaryType())])
    return split(docs).select(*columns, "words").mapInArrow(partial(_assembled, known=docs.sparkSession.sparkContext.broadcast(common), vocabulary=vocabulary, columns=columns), schema)


def decode(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The bytes of an array of token ids: the tokens' bytes in hexadecimal, joined, and read as binary. Null for null, empty for none; an unknown id raises."""
    table = ranks(vocabulary)
    pieces: list[str | None] = [None] * (max(table.values()) + 1)
    for token, rank in table.items():
        pieces[rank] = token.hex()
    literal = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(literal, i), F.raise_error(F.lit("unknown token id")).cast("string"))), ""))
