"""Sessions, signals and segments derived from the standard tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with idx, a long that orders its rows as they lie in its files, and these by name."""
    rows = table(spark, sf_dir, name)
    placed = rows.select(*rows.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.select(F.col("_metadata.file_path").alias("_file")).distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_file")))  # a row a file
    return placed.join(F.broadcast(files), "_file").select(*rows.columns, (F.col("_rank") * F.lit(1 << 40) + F.col("_row")).alias("idx"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir, which a cluster's nodes share; where it is unset, in local mode, under /tmp."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, idx, value, event_type): the events of a user in time order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), "value", "event_type")


SAMPLES_SQL = """s AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value, event_type
  FROM events)"""


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, idx, acc_x, acc_y, acc_z, gyr_x, gyr_y, gyr_z) from the line items of a supplier."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"),
        F.col("l_quantity").alias("acc_x"), (F.col("l_extendedprice") / 1000).alias("acc_y"), (F.col("l_tax") * 100).alias("acc_z"),
        (F.col("l_quantity") / 10).alias("gyr_x"), (F.col("l_discount") * 10).alias("gyr_y"), (F.col("l_tax") * 10).alias("gyr_z"),
    )


IMU_SQL = """m AS (SELECT l_suppkey AS session_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS idx,
  l_quantity AS acc_x, l_extendedprice / 1000 AS acc_y, l_tax * 100 AS acc_z, l_quantity / 10 AS gyr_x, l_discount * 10 AS gyr_y, l_tax * 10 AS gyr_z
  FROM lineitem)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, start, stop, speaker): turns of a conversation, a character lasting 1/100 s."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), ((F.sum(n).over(order) - n) / 100).alias("start"), (F.sum(n).over(order) / 100).alias("stop"), F.col("role").alias("speaker"))


SEGMENTS_SQL = """seg AS (SELECT conv_id AS session_id, CAST(sum(length(text)) OVER w - length(text) AS DOUBLE) / 100 AS start,
  CAST(sum(length(text)) OVER w AS DOUBLE) / 100 AS stop, role AS speaker
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""
