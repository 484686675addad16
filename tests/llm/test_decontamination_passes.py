"""A benchmark read in several passes gives what one pass gives."""

import random

from spanloom.llm import decontam


def test_passes_do_not_change_results(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choices(words, k=30) for _ in range(4)]
    items = [rng.choices(words, k=rng.randint(20, 40)) + rng.choice(shared) for _ in range(60)]
    docs = []
    for k, i in enumerate(items * 3):
        text = list(i)
        for at in rng.sample(range(len(text)), 1 + k % 3):
            text[at] = "other"
        docs.append((k, " ".join(rng.choices(words, k=20) + text + rng.choices(words, k=20))))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(90, ""), (91, None)], "item_id long, text string")
    rows = lambda: sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9), r["start"], r["words"]) for r in decontam.contaminated(docs, bench, similarity=0.7).collect())
    one = rows()
    monkeypatch.setattr(decontam, "PASS_BYTES", 4000)
    assert len(one) > 50 and rows() == one
