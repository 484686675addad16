"""Places of long texts are read from pieces as from the whole text."""

from spanloom.operators import spans as sp


def test_cuts(spark):
    texts = ["", "ab\ncd", "".join(chr(97 + i % 26) if i % 50 else "\U0001d11e" for i in range(3000)), None, "x" * sp.PIECE]
    places = [(0, 0), (0, 3), (2, 9), (-1, 4), (-2000, 4), (5, 2), (510, 515), (511, 512), (512, 513), (1020, 1030), (500, 1530), (0, 3000), (2999, 3005), (5000, 5001), (None, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = spark.createDataFrame([(k, s, e) for k in range(len(texts)) for s, e in places], "doc_id long, start long, end long")
    rows = sp.with_pieces(spans, docs, {"there": lambda t, s: t.cut(s["start"], s["end"] - s["start"]), "n": lambda t, s: t.length}).collect()
    assert len(rows) == len(texts) * len(places)
    for r in rows:
        text, s, e = texts[r["doc_id"]], r["start"], r["end"]
        want = None if text is None or s is None else "" if s < 0 else text[s:e]
        assert (r["there"], r["n"]) == (want, None if text is None else len(text)), r


def test_plan_cuts_texts_before_they_meet_spans(spark):
    docs, spans = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, 0, 1)], "doc_id long, start long, end long")
    plan = sp.with_pieces(spans, docs, {"n": lambda t, s: t.length})._jdf.queryExecution().optimizedPlan().toString()
    made = plan[: plan.index("Join")]
    assert "regexp_extract_all" not in made and "length(text" not in made
