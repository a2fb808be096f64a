"""Segments with the same frames are measured once, and each has its row."""

from __future__ import annotations

import pulseframe.operators.extraction as extraction
from pulseframe.operators.tremor import Settings


def test_equal_segments_are_measured_once(spark, monkeypatch):
    frames = spark.createDataFrame([(s, i, i % 5 < 3, 100.0 + (i * 7 + s) % 11, float(i % 4)) for s in (1, 2) for i in range(90)], "session_id long, idx long, speech boolean, pitch double, amplitude double")
    spans = [(s, a, a + n) for s in (1, 2) for a in (0, 7) for n in (0, 1, 20, 60)]
    once = [(k, *span) for k, span in enumerate(spans)]
    schema = "segment_id long, session_id long, start long, stop long"
    sizes = []
    cut = extraction.sliced

    def counted(frames, segments, *columns):
        sizes.append(segments.count())
        return cut(frames, segments, *columns)

    monkeypatch.setattr(extraction, "sliced", counted)
    one = extraction.segmented(frames, spark.createDataFrame(once, schema), 0.05, Settings(step=0.05))
    many = extraction.segmented(frames, spark.createDataFrame([(100 * c + k, *span) for c in (3, 1, 2) for k, *span in once], schema).repartition(5), 0.05, Settings(step=0.05))
    assert sizes == [len(spans)] * 2
    for name, table in many.items():
        assert table.columns == one[name].columns
        rows = {r.segment_id: tuple(r)[1:] for r in one[name].collect()}
        assert len(rows) == len(spans)
        assert sorted(map(repr, map(tuple, table.collect()))) == sorted(repr((100 * c + k, *v)) for c in (1, 2, 3) for k, v in rows.items())
