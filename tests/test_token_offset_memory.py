"""Token offsets leave a task by slices of texts, not as one array of Python objects of all texts of an Arrow batch."""

import re

from spanloom.operators import views

from test_scan_memory import peak, scanner


def test_memory_does_not_grow_with_rows(spark, monkeypatch):
    run = scanner(spark, monkeypatch, views.token_offsets)
    small, few = peak(run, 500, 1)
    large, many = peak(run, 2_000, 1)
    assert many == 4 * few > 0
    assert large < 1.3 * small < 100 << 20


def test_odd_texts(spark):
    texts = ["", " \t\n", None, "a_b, ç!\U0001f600x  1.5", "word"]
    got = views.token_offsets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = [(d, i, *m.span()) for d, t in enumerate(texts) for i, m in enumerate(re.finditer(r"\w+|[^\w\s]", t or ""))]
    assert sorted(map(tuple, got)) == want
