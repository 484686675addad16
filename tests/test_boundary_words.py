"""Words beside a span come from the whole text."""

import time
from collections import Counter

from spanloom.operators import statistics as stat


def test_words_behind_long_gaps_and_long_words(spark):
    texts = ["one Two" + " " * 200 + "SPAN" + "." * 150 + "Three four", "b " + "a" * 120 + "SPAN" + "c" * 130 + " d", "SPAN", "x SPAN y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = spark.createDataFrame([(i, str(i), t.index("SPAN"), t.index("SPAN") + 4) for i, t in enumerate(texts)], "doc_id long, label string, start long, end long")
    got = {(r["label"], r["kind"]): r["value"] for r in stat.boundary_context(spans, docs).collect() if r["kind"].startswith("word")}
    assert got == {
        ("0", "word_before"): "two", ("0", "words_before"): "one two", ("0", "word_after"): "three", ("0", "words_after"): "three four",
        ("1", "word_before"): "a" * 120, ("1", "words_before"): "b " + "a" * 120, ("1", "word_after"): "c" * 130, ("1", "words_after"): "c" * 130 + " d",
        ("3", "word_before"): "x", ("3", "word_after"): "y",
    }


def test_words_within_reach_only(spark):
    texts = ["one Two" + " " * 200 + "SPAN" + "." * 150 + "Three four", "b " + "a" * 120 + "SPAN" + "c" * 130 + " d", "ab cd SPANef gh"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = spark.createDataFrame([(i, str(i), t.index("SPAN"), t.index("SPAN") + 4) for i, t in enumerate(texts)], "doc_id long, label string, start long, end long")
    got = {(r["label"], r["kind"]): r["value"] for r in stat.boundary_context(spans, docs, reach=80).collect() if r["kind"].startswith("word")}
    assert got == {("1", "word_before"): "a" * 80, ("1", "word_after"): "c" * 80, ("2", "word_before"): "cd", ("2", "words_before"): "ab cd", ("2", "word_after"): "ef", ("2", "words_after"): "ef gh"}


def test_many_spans_of_a_long_text(spark):
    words = [f"w{i % 89}" for i in range(60_000)]
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    docs = spark.createDataFrame([(1, " ".join(words) + "." * 300)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, "x", starts[i], starts[i] + len(words[i])) for i in range(1, 60_000, 3)], "doc_id long, label string, start long, end long")
    before = Counter(words[i - 1] for i in range(1, 60_000, 3))
    began = time.time()
    got = {r["value"]: r["n"] for r in stat.boundary_context(spans, docs, k=100).where("kind = 'word_before'").collect()}
    assert got == before and time.time() - began < 60
