"""Operators on a session that holds most rows: no row may hold the whole session."""

from __future__ import annotations

import pytest
from pulseframe.operators import signals as S
from pyspark.sql import functions as F


@pytest.mark.parametrize(("steps", "stride"), [(20, 5), (4, 7), (1, 1)])
def test_windows_equal_restatement(spark, steps, stride):
    lengths = {0: 1, 1: steps, 2: steps + 1, 3: steps + 2, 4: 97}
    rows = [(s, i, None if i == 3 else float(i * i % 17)) for s, n in lengths.items() for i in range(n)]
    out = S.windows_of(spark.createDataFrame(rows, "session_id long, idx long, value double"), steps, stride).collect()
    wanted = {(s, a): [v for t, i, v in rows if t == s and a <= i < a + steps] for s, n in lengths.items() for a in range(0, n - steps, stride)}
    assert {(r.session_id, r.start): r["values"] for r in out} == wanted


def test_windows_pack_no_session(spark):
    df = spark.range(100000).select(F.lit(1).alias("session_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("value"))
    out = S.windows_of(df, 20, 5)
    assert out.count() == -(-(100000 - 20) // 5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    groups = [line.split("Aggregate", 1)[1].split("]", 1)[0] for line in plan.splitlines() if "Aggregate" in line]
    assert groups and all("start" in g for g in groups)
