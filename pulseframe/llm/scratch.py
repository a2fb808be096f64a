"""Intermediate tables in the folder that the cluster shares, and joins whose hot keys are spread."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a new folder under /tmp in local mode (tests); on a cluster, which would lose it, an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return jsc.getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/scratch-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: its lineage ends there, and lost executors recompute nothing above it.

    The files stay until `forget` or until the folder is cleared: a lazy result may still need them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes the files of written tables that no later step reads."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 2 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, after the session has been told to send rows to Python workers in Arrow batches of about BATCH_BYTES; a longer row is a batch of its own.

    Spark's default is 64 MB or 10,000 rows, which each running task holds once in the JVM, outside its heap, and once or twice in Python.
    The setting stays, as it is read when the lazy result runs; it changes no rows.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint for small iteration state; Spark removes its files with the plan that uses it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(x: DataFrame | str, y: DataFrame | str, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality of the column pairs of two frames or aliases."""
    side = lambda t, c: F.col(f"{t}.{c}") if isinstance(t, str) else t[c]
    return reduce(lambda a, b: a & b, (side(x, a).eqNullSafe(side(y, b)) for a, b in pairs))


def spread_join(rows: DataFrame, facts: DataFrame, keys: Sequence[str], weight: str, how: str = "inner", small: int = 0) -> DataFrame:
    """rows joined with facts (inner or left, null-safe), facts being unique on the keys and `weight` the number of rows each key meets.

    A key with more than 1 / (4 * partitions) of all rows would fill a task by itself. There are fewer than 4 * partitions of
    such keys, so their facts are broadcast and their rows stay where they are; only the other rows are shuffled. Of up to
    `small` facts all are broadcast. The columns are those of rows, then the facts' others without the weight.
    """
    hidden = [f"__{k}" for k in keys]
    own = facts.select(*(F.col(k).alias(h) for k, h in zip(keys, hidden, strict=True)), *(c for c in facts.columns if c not in keys))
    total, n = own.agg(F.sum(weight), F.count(F.lit(1))).first()
    on = lambda x, y: same(x, y, list(zip(keys, hidden, strict=True)))
    if n <= small:
        return rows.join(F.broadcast(own), on(rows, own), how).drop(*hidden, weight)
    limit = (total or 0) / (4 * parallelism(rows.sparkSession))
    hot, cold = own.filter(F.col(weight) > limit), own.filter(F.col(weight) <= limit)
    near = rows.join(F.broadcast(hot), on(rows, hot))
    names = hot.select(*hidden)
    far = rows.join(F.broadcast(names), on(rows, names), "left_anti")
    far = far.join(cold, on(far, cold), how)
    return near.unionByName(far).drop(*hidden, weight)


def salted_join(rows: DataFrame, facts: DataFrame, key: str, fact_key: str, weight: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows joined (inner) with facts, unique on fact_key, of any size each; weight(key, n) holds the number of rows of each key.

    A key with more than 1 / (4 * partitions) of all rows is dealt to as many parts as it has such shares, by a hash of
    the columns `by`, and its fact is repeated once a part. There are fewer than 4 * partitions of such keys, and of parts in all, so only their numbers are broadcast.
    """
    total = weight.agg(F.sum("n")).first()[0] or 0
    limit = max(1, total // (4 * parallelism(rows.sparkSession)))
    hot = weight.filter(F.col("n") > limit).select(F.col(key).alias("__key"), (F.floor(F.col("n") / F.lit(limit)) + 1).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left").withColumn("__part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("__key", "__parts")
    copies = facts.join(F.broadcast(hot), F.col(fact_key) == F.col("__key"), "left").withColumn("__copy", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__key", "__parts")
    return dealt.join(copies, (F.col(key) == F.col(fact_key)) & (F.col("__part") == F.col("__copy"))).drop("__part", "__copy")


def in_front(rows: DataFrame, order: Sequence[Column], **sums: Column) -> DataFrame:
    """rows with the sum of each expression over the rows in front of it in the order, which is total; 0 for the first.

    Ranges of the order are summed in their tasks; one row for each range gives the offsets.
    """
    dealt = written(rows.repartitionByRange(max(2, parallelism(rows.sparkSession)), *order).withColumn("range", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("range").agg(*(F.sum(c).alias(f"{n}_0") for n, c in sums.items()))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("range").alias("r"), *(F.coalesce(F.sum(f"{n}_0").over(ahead), F.lit(0)).alias(f"{n}_0") for n in sums))
    local = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({n: F.coalesce(F.sum(c).over(local), F.lit(0)) for n, c in sums.items()})
    joined = own.join(F.broadcast(parts), F.col("range") == F.col("r"))  # a row for each range
    return joined.select(*rows.columns, *((F.col(n) + F.col(f"{n}_0")).alias(n) for n in sums))
