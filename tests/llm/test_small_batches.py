"""Python workers get rows by bytes, not by thousands of rows of any length."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pulseframe.llm import line_crf, near_dup
from pulseframe.llm.decontam import drop_contaminated
from pulseframe.llm.scratch import BATCH_BYTES

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("stage", ["quality", "dedup", "decontamination"])
def test_stages_bound_their_batches(spark, stage):
    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "n"])

    before = spark.conf.get(SETTING)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat(concat('word', id, ' and more '), 250) as text")
    try:
        if stage == "quality":
            line_crf.keep_good(docs, line_crf.fit([], []))
        elif stage == "dedup":
            near_dup.near_duplicates(docs.limit(3))
        else:
            drop_contaminated(docs, spark.createDataFrame([(1, "some text")], "item_id long, text string"), width=10)
        sizes = docs.mapInArrow(measured, "size long, n long").collect()
    finally:
        spark.conf.set(SETTING, before)
    assert max(r.size for r in sizes) < 1.1 * BATCH_BYTES
    assert sum(r.n for r in sizes) == 3000
