"""locate_fuzzy over whole texts, against plain dynamic programming."""

import random

from spanloom.operators import location as lc
from spanloom.plans import catalog


def sellers(text, quote, share):
    most = int(len(quote) * share)
    row, begin = list(range(len(quote) + 1)), [0] * (len(quote) + 1)
    best = (most + 1, 0, 0)
    for j, c in enumerate(text, 1):
        new, start = [0], [j]
        for i, q in enumerate(quote, 1):
            cost, at = min((row[i - 1] + (q != c), begin[i - 1]), (row[i] + 1, begin[i]), (new[i - 1] + 1, start[i - 1]), key=lambda x: x[0])
            new.append(cost)
            start.append(at)
        row, begin = new, start
        if row[-1] < best[0]:
            best = (row[-1], begin[-1], j)
    return None if best[0] > most else best[1:]


def test_near_is_sellers():
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choices("ab c", k=rng.randint(1, 90)))
        quote = "".join(rng.choices("ab c", k=rng.randint(4, 30)))
        if rng.random() < 0.5:
            at = rng.randrange(len(text))
            quote = (text[at : at + 25] + "abca")[: rng.randint(4, 29)]
        share = rng.choice((0.15, 0.3))
        assert lc._near(text, quote, share) == sellers(text, quote, share), (text, quote, share)


def test_query_reads_whole_texts(spark, sf, tmp_path, monkeypatch):
    plain = catalog.QUERIES["locate_fuzzy"](spark, sf).where("start >= 0 and end - start > 8").orderBy("doc_id").limit(5).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = []
    seen = []
    real = lc.locate_spans
    monkeypatch.setattr(lc, "locate_spans", lambda q, *a, **b: (seen.append({r["doc_id"]: r["quote"] for r in q.select("doc_id", "quote").collect()}), real(q, *a, **b))[1])
    catalog.QUERIES["locate_fuzzy"](spark, sf)
    later = {r["doc_id"]: texts[r["doc_id"]] + " filler" * 300 + " " + seen[0][r["doc_id"]] for r in plain}
    for r in docs.where(docs["doc_id"].isin(list(later))).collect():
        rows.append({**r.asDict(), "text": later[r["doc_id"]], "n_chars": len(later[r["doc_id"]])})
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["start"], r["end"], r["how"]) for r in catalog.QUERIES["locate_fuzzy"](spark, str(tmp_path)).collect()}
    assert len(plain) == len(got) == 5
    for k, text in later.items():
        assert got[k] == lc.locate(text, seen[-1][k]), k
    assert any(how == "exact" and start > 2000 for start, _, how in got.values())
