"""A task that scans texts holds a slice of them, however many rows and Arrow batches it gets."""

import tracemalloc

import pyarrow as pa
import pytest

from spanloom.operators import views


def scanner(spark, monkeypatch, made):
    """The function that ``made`` hands to mapInArrow."""
    got = []
    frame = type(spark.range(0))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **k: got.append(f) or plain(self, f, *a, **k))
    made(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    return got[0]


def peak(run, rows: int, batches: int) -> tuple[int, int]:
    """Bytes that numpy and Python held at most beside a batch's texts, and how many rows came out."""
    texts = pa.array(["Word and another word " * 150] * rows)
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), texts], names=["doc_id", "text"])
    tracemalloc.start()
    n = sum(out.num_rows for out in run(batch for _ in range(batches)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, n


@pytest.mark.parametrize("made", [views.tokens, views.spans, views.span_texts, views.marked])
def test_memory_of_a_scan_does_not_grow_with_its_rows(spark, monkeypatch, made):
    run = scanner(spark, monkeypatch, made)
    small, few = peak(run, 1_000, 1)  # 3 MB of texts, three slices
    large, many = peak(run, 8_000, 2)  # two batches of 26 MB
    assert many == 16 * few > 0
    assert large < 1.3 * small < 100 << 20
