"""Sessions in blocks of positions, so that windows with a bounded reach run on blocks and a long session spreads over tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_halo(df: DataFrame, size: int, before: int, after: int, idx: str = "idx") -> DataFrame:
    """df with `block` and `own`: every row goes to the block of its position and, as not its own, to those that reach it.

    A block has `size` positions and sees `before` positions in front of it and `after` behind it; positions start at 0.
    """
    first = F.greatest(F.lit(0), F.floor((F.col(idx) - after) / F.lit(size)))
    dealt = df.withColumn("block", F.explode(F.sequence(first.cast("long"), F.floor((F.col(idx) + before) / F.lit(size)).cast("long"))))
    return dealt.withColumn("own", F.floor(F.col(idx) / F.lit(size)) == F.col("block"))


def own_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter("own").select(*columns)
