"""op6 writes its shard files, and its rows are what those files hold."""

from __future__ import annotations

import hashlib
from pathlib import Path

import numpy as np
import pytest
from pulseframe.llm import queries
from pulseframe.llm.scratch import shared_dir
from pulseframe.llm.token_shards import END, LENGTH, PER_SHARD, read_record, stored_order, training_order

SF = "/root/testdata/sf0.001"


def test_rows_come_from_the_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, None if i == 3 else f"text {i} " * (i % 40)) for i in range(300)], "doc_id long, text string")
    out = f"file://{tmp_path}/out"
    wanted = {(r.slot, r.shard, r.offset, r.doc_id, r.chunk, r.n_tokens, bytes(r.tokens)) for r in training_order(docs, length=16, per_shard=32).collect()}
    assert {(r.slot, r.shard, r.offset, r.doc_id, r.chunk, r.n_tokens, bytes(r.tokens)) for r in stored_order(docs, out, length=16, per_shard=32).collect()} == wanted
    assert sorted(p.name for p in Path(f"{tmp_path}/out").iterdir()) == [f"shard-{s:06d}.bin" for s in range(-(-len(wanted) // 32))]
    assert sum(p.stat().st_size for p in Path(f"{tmp_path}/out").iterdir()) == 32 * len(wanted)
    assert stored_order(docs.limit(0), f"file://{tmp_path}/none", length=16, per_shard=32).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
def test_query_writes_every_shard(spark):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("scratch-shards-*"))
    rows = queries.QUERIES["op6_training_order"](spark, SF).collect()
    (new,) = set(folder.glob("scratch-shards-*")) - before
    assert sum(p.stat().st_size for p in new.iterdir()) == 2 * LENGTH * len(rows)
    assert {r.shard for r in rows} == {int(p.stem.split("-")[1]) for p in new.iterdir()} == {r.slot // PER_SHARD for r in rows}
    for r in rows[:50]:
        record = read_record(f"file://{new}", r.slot)
        assert r.offset == r.slot % PER_SHARD * 2 * LENGTH and np.all(record[r.n_tokens :] == END)
        assert hashlib.sha256(record[: r.n_tokens].tobytes()).hexdigest() == r.tokens_sha256
