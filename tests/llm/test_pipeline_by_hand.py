"""Stages of the pipeline against plain computations over whole texts."""

import re
from collections import Counter

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = [x for x in re.split(r"[ \t\n\r\f\v]+", text or "") if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def test_one_of_each_class_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = {r.doc_id: r.text for r in docs.collect()}
    sets, root = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if rows[a] == rows[b] or both and both * 10 >= 8 * (len(sets[a]) + len(sets[b]) - both):
                root[find(b)] = find(a)
    kept = Counter(find(r.doc_id) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, SF).select("doc_id").collect())
    assert set(kept) == {find(i) for i in ids} and set(kept.values()) == {1} and len(kept) < len(ids)


def test_mix_repeats_as_the_operator_says(spark):
    from spanloom.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    want = {r.doc_id: r.copies for r in mixing.mix_sources(docs).select("doc_id", "copies").collect() if r.copies}
    extra = docs.withColumn("nth", docs.doc_id * 0)  # a column that the stage might use itself
    out = corpus_pipeline.mix(spark, extra, SF)
    assert out.columns == extra.columns
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == want and max(want.values()) <= 2


def test_nothing_similar_to_the_benchmark_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    exact = {i for i, t in rows.items() if any(x and len(x.split()) >= 5 and x in t for x in items)}
    kept = {r.doc_id for r in corpus_pipeline.drop_benchmark_passages(spark, docs, SF).select("doc_id").collect()}
    assert exact and not exact & kept
    far = {i for i, t in rows.items() if not any(shingles(t) & shingles(x) for x in items)}
    assert far <= kept
