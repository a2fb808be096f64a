"""The thin queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import byte_bpe, decision_list, divergence, line_crf, oracles
from pulseframe.llm.decontam import find_contamination
from pulseframe.llm.line_dedup import dedup_lines
from pulseframe.llm.mixing import mix
from pulseframe.llm.near_dup import near_duplicates
from pulseframe.llm.quotes import link_quotes
from pulseframe.llm.scratch import new_path
from pulseframe.llm.sharding import shard
from pulseframe.llm.token_shards import stored_order
from pulseframe.llm.url_filter import filter_urls, rules_frame
from pulseframe.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = oracles.SQL


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, linked to what it quotes, in reply order."""
    return link_quotes(table(spark, sf_dir, "conversations"), min_chars=1)


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, 80 % similarity."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def quality_model(spark: SparkSession, sf_dir: str) -> line_crf.Model:
    """Fitted on labels.quality of the rows whose crc32(doc_id) mod 5 is not 0."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return line_crf.train(table(spark, sf_dir, "documents"), labels, where=~held_out())


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@query
def op2_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-CRF quality score of every document."""
    scored = line_crf.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie inside a 10-word window of a benchmark item."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    named = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share are dropped from every document."""
    out = dedup_lines(table(spark, sf_dir, "documents"), least_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token sequence of the documents with its global slot, its place in the shard files and a digest of its tokens as the shard files hold them."""
    out = stored_order(table(spark, sf_dir, "documents"), new_path(spark, "shards"))
    return out.select("slot", "shard", "offset", "doc_id", "chunk", "n_tokens", F.sha2("tokens", 256).alias("tokens_sha256"))


@query
def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics of every document, the base rules and the learned decision list."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    out, _ = decision_list.judge(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


#: The rules of the URL query: action, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the URL rules on every page."""
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark, URL_RULES))


@query
def op9_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document: sources weigh 5, 2, 1, repeating, and share 150 % of all words."""
    out = mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, cap=2)
    return out.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies", "part")


@query
def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    out = shard(table(spark, sf_dir, "documents"), n_shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every usable embedding."""
    return whiten(table(spark, sf_dir, "embeddings"), components=16)


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes that they decode to, as digests."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, keep=["doc_id"])
    decoded = byte_bpe.decode(F.col("ids"), vocabulary)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every source is from the others of its language, and the terms that set it apart."""
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=3, ranks=200)
