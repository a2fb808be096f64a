"""URL filters: host-suffix and path-prefix rules found by equi-joins on short hash prefixes.

Column expressions only. Each distinct URL is expanded into (host suffix, path prefix) expressions; the first 32 bits of an
expression's SHA-256 are the join key, then the full digest confirms, and the longest rule wins. Only numbers of labels and lengths
of paths that rules really have are expanded, so a rule's path need not end at a slash and a host of many labels costs no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm.line_dedup import ascii_lower
from pulseframe.llm.scratch import spread_join, written

RULES = "action string, host string, path string"
#: Up to so many hash prefixes of rules are broadcast.
SMALL = 10_000


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(action allow or block, host, path) rows."""
    return spark.createDataFrame(rules, RULES)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(host: Column) -> Column:
    """The number of parts between dots."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _suffixes(host: Column, labels: list[int]) -> Column:
    """The last n parts of the host, for each of the numbers that it has."""
    return F.filter(F.array(*(F.when(labels_of(host) >= n, F.substring_index(host, ".", -n)) for n in labels)).cast("array<string>"), lambda x: x.isNotNull())


def _expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of pages(page_id, url); other columns are ignored.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path. The rule with the longest
    host + path wins; ties go to the longer host, then to block. Without a fitting rule, rule is null and the verdict is
    `default`. A null or malformed URL has empty host and path, which only a rule with an empty host can fit. Rules with a
    null host or path fit nothing; repeated rules count once. Rules are only broadcast if they have at most SMALL hash prefixes. An empty table gives an
    empty result. Very long URLs are hashed once for each expression.
    """
    own = (
        rules.filter("host is not null and path is not null and action is not null")
        .select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("action").alias("action"))
        .withColumn("digest", _expression(F.col("rule_host"), F.col("rule_path")))
        .withColumn("prefix", F.substring("digest", 1, 8))
    )
    found = own.agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"), F.sort_array(F.collect_set(labels_of(F.col("rule_host")))).alias("labels")).first()  # distinct numbers
    named = pages.select("page_id", F.coalesce(F.col(url), F.lit("")).alias("url"))
    urls = named.groupBy("url").agg(F.count(F.lit(1)).alias("rows")).select("url", "rows", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, found["lengths"])).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    spread = urls.select("url", "rows", F.explode(_suffixes(F.col("host"), found["labels"])).alias("suffix"), prefixes.alias("prefixes")).select("url", "rows", "suffix", F.explode("prefixes").alias("start"))
    spread = spread.withColumn("full", _expression(F.col("suffix"), F.col("start"))).select("url", "rows", "full", F.substring("full", 1, 8).alias("prefix"))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("nh"), "action", F.concat("rule_host", "rule_path").alias("rule"), "digest")
    keyed = own.groupBy("prefix").agg(F.collect_list(rank).alias("rules"))  # more than one only where 32 bits collide
    if keyed.count() <= SMALL:
        joined = spread.join(F.broadcast(keyed), "prefix")
    else:
        spread = written(spread, "expressions")
        joined = spread_join(spread, keyed.join(spread.groupBy("prefix").agg(F.count(F.lit(1)).alias("meets")), "prefix"), ["prefix"], "meets")
    fits = joined.select("url", "rows", F.explode(F.filter("rules", lambda r: r.digest == F.col("full"))).alias("r"))
    best = written(fits.groupBy("url").agg(F.first("rows").alias("rows"), F.max("r").alias("best")), "verdicts")
    out = spread_join(named, best, ["url"], "rows", "left")
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
