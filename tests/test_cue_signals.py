"""Cues in capitals with accents count, other letters do not."""

from spanloom.operators import selection as se


def test_case_of_all_letters(spark):
    texts = ["REONÈ!! OUÈRE!!", "ouèr", "oué", "SHAN", "\u017fhan", "na\u0131ve TION", "t\u0131on T\u0130ON"]
    rows = se.cue_signals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "(?i)tion", "(?i)shan|ouèr").orderBy("doc_id").collect()
    assert [(r["cues"], r["debunk"]) for r in rows] == [(0, True), (0, True), (0, False), (0, True), (0, True), (1, False), (0, False)]
