"""A head that most pairs share: its set is dealt to many tasks, and hubs of edges stay in place."""

from __future__ import annotations

import random

from pulseframe.llm import near_dup
from pulseframe.llm.scratch import salted_join
from pyspark.sql import functions as F


def test_a_hot_key_is_dealt_to_many_parts(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(7).alias("a"), F.col("id").alias("b"))
    facts = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    weight = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    joined = salted_join(rows, facts, "a", "k", weight, by=("a", "b"))
    assert joined.columns == ["a", "b", "k", "twice"]
    found = joined.collect()
    assert sorted((r.a, r.b, r.twice) for r in found) == sorted((a, b, 2 * a) for a, b in ((i if i % 4 == 0 else 7, i) for i in range(4000)))


def test_hot_heads_hold_few_rows_a_task(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = 6000
    rows = spark.range(total).select(F.lit(1).cast("long").alias("a"), F.col("id").alias("b"))
    weight = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    facts = spark.createDataFrame([(1, "x")], "k long, v string")
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        joined = salted_join(rows, facts, "a", "k", weight, by=("a", "b")).withColumn("task", F.spark_partition_id())
        tasks = [r["count"] for r in joined.groupBy("task").count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(tasks) == total and len(tasks) == n and max(tasks) < 0.6 * total


def test_components_around_hubs(spark):
    rng = random.Random(9)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(30)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(399, 5000), (5000, 5001)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.id: r.label for r in near_dup.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert found == {x: find(x) for x in parent}


def test_near_copies_of_one_text(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        own = list(words)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), width=4).collect()
    assert {r.component_id for r in out} == {0} and sum(r.kept for r in out) == 1
