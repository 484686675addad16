"""Operators that SQL cannot express, and edge cases, against brute force on small inputs."""

import itertools
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import hashing, text as tx
from spanloom.functions.lexicons import DOC_LABELS
from spanloom.operators import documents as dc
from spanloom.operators import duplicates as dup
from spanloom.operators import evaluation as ev
from spanloom.operators import location as lc
from spanloom.operators import retrieval as rt
from spanloom.operators import sampling as sm
from spanloom.operators import spans as sp
from spanloom.operators import statistics as stat
from spanloom.operators import votes as vt
from spanloom.sources import readers, writers
from spanloom.streaming import streams

SPAN = "doc_id long, label string, start long, end long"


def iou(a, b):
    common = min(a[1], b[1]) - max(a[0], b[0])
    return common / (max(a[1], b[1]) - min(a[0], b[0])) if common > 0 else 0


@pytest.fixture(scope="module")
def random_spans():
    rng = random.Random(3)
    out = []
    for d in range(12):
        for _ in range(rng.randrange(0, 30)):
            s = rng.randrange(0, 300)
            out.append((d, rng.choice(["Actor", "Action", "Effect", "Victim"]), s, s + rng.choice([0, 1, 5, 20, 90]), rng.randrange(100) / 100))
    return sorted(set(out))


def test_overlap_join(spark, random_spans):
    df = spark.createDataFrame([r[:4] for r in random_spans], SPAN)
    got = sorted((r["doc_id"], r["start_a"], r["end_a"], r["start_b"], r["end_b"], r["label_a"], r["label_b"]) for r in sp.overlap_join(df, df, ["doc_id"]).collect())
    want = sorted((a[0], a[2], a[3], b[2], b[3], a[1], b[1]) for a, b in itertools.product(random_spans, random_spans) if a[0] == b[0] and a[2] < a[3] and b[2] < b[3] and max(a[2], b[2]) < min(a[3], b[3]))
    assert got == want


def test_nms(spark, random_spans):
    df = spark.createDataFrame(random_spans, SPAN + ", score double")
    got = sorted(tuple(r) for r in sp.nms(df, {"Actor": 0.6}).collect())
    want = []
    for (d, label), g in itertools.groupby(sorted(random_spans, key=lambda r: (r[0], r[1], -r[4], r[2], r[3])), key=lambda r: r[:2]):
        kept = []
        for r in g:
            if all(iou(r[2:4], k[2:4]) < (0.6 if label == "Actor" else 0.5) for k in kept):
                kept.append(r)
        want += kept
    assert got == sorted(want)


def test_consensus_and_match(spark, random_spans):
    df = spark.createDataFrame([r[:4] for r in random_spans], SPAN)
    got = sorted(tuple(r) for r in sp.consensus_clusters(df, 3).collect())
    want = []
    for (d, label), g in itertools.groupby(sorted(random_spans, key=lambda r: r[:4]), key=lambda r: r[:2]):
        clusters = []
        for r in g:
            home = next((c for c in clusters if max(c[0][2], r[2]) < min(c[0][3], r[3])), None)
            clusters.append([r]) if home is None else home.append(r)
        want += [(d, label, *min(c, key=lambda x: (x[2] - x[3], x[2]))[2:4], len(c)) for c in clusters if len(c) >= 2]
    assert got == sorted(want)
    pred = df.withColumn("end", F.col("end") + 3)
    counts = {(r["doc_id"], r["label"]): (r["tp"], r["fp"], r["fn"]) for r in sp.greedy_match(df, pred).collect()}
    for (d, label), g in itertools.groupby(sorted(random_spans, key=lambda r: r[:4]), key=lambda r: r[:2]):
        gold = [r[2:4] for r in g]
        guess = [(s, e + 3) for s, e in gold]
        used = set()
        for s in gold:
            best = max(((iou(s, p), -i) for i, p in enumerate(guess) if i not in used), default=(0, 0))
            if best[0] >= 0.5:
                used.add(-best[1])
        assert counts[d, label] == (len(used), len(guess) - len(used), len(gold) - len(used))


def test_subset_and_gaps(spark):
    df = spark.createDataFrame([(1, "A", 0, 10), (1, "A", 2, 5), (1, "A", 0, 10), (1, "A", 11, 12), (1, "A", 20, 20), (2, "A", 0, 1)], SPAN)
    assert sorted(tuple(r)[2:] for r in sp.subset_dedup(df, ["doc_id", "label"]).where("doc_id = 1").collect()) == [(0, 10), (11, 12), (20, 20)]
    merged = sp.merge_gaps(df, ["doc_id", "label"], 1).where("doc_id = 1").collect()
    assert sorted((r["start"], r["end"], r["n"]) for r in merged) == [(0, 12, 4), (20, 20, 1)]


def test_offsets_are_code_points(spark):
    df = spark.createDataFrame([("😀 ab ", 1, 5), ("x", 0, 1), (None, 0, 1)], "text string, start int, end int").withColumn("doc_id", F.lit(1))
    got = [(r["new_start"], r["new_end"]) for r in sp.trim_boundaries(df).orderBy("new_start").collect()]
    assert got == [(0, 1), (2, 4)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    nodes = spark.range(60).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r["dup_comp"] for r in dup.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in range(60)}


def test_simhash_of_nothing(spark):
    got = {r["doc_id"]: r["simhash"] for r in hashing.simhash64(spark.createDataFrame([(1, ""), (2, "!!"), (3, None), (4, "a")], "doc_id long, text string")).collect()}
    assert got[1] == got[2] == got[3] == -1 and got[4] != -1
    assert [hashing.nearest_band_count(n) for n in (1, 3, 8, 12, 100)] == [1, 2, 8, 8, 64]


def test_text_functions(spark):
    row = spark.createDataFrame([("Submission Statement: see http://a.b/c?d now.\nrest “q” ", '```json\n{"a": [1, 2,],}\n```')], "t string, j string").select(
        tx.replace_urls(F.col("t")).alias("u"), tx.strip_statement(F.col("t")).alias("s"), tx.fold_quotes(F.col("t")).alias("q"), tx.json_block(F.col("j")).alias("j"),
        tx.clip_to_sentence(F.lit("One. Two three"), 8).alias("c"), tx.template("{{a}}-{{b}}", a=F.lit(1), b=F.lit(None)).alias("m"), tx.evidence_kinds(F.lit("see www.x 12")).alias("e"), tx.time_anchor(F.lit("in 1999")).alias("y"), tx.lexicon_count(F.lit("No doubt, no DOUBT; nodoubt"), ["no doubt"]).alias("n")).first()
    assert row["u"].startswith("Submission Statement: see <URL>") and row["u"].endswith("rest “q” ")
    assert row["s"].startswith("see http") and '"q"' in row["q"] and json.loads(row["j"]) == {"a": [1, 2]}
    assert (row["c"], row["m"], sorted(row["e"]), row["y"], row["n"]) == ("One.", "1-", ["numeric", "url"], True, 2)


def test_harmonise_and_markers(spark):
    df = spark.createDataFrame([("7", None, " ", "b", " YES "), (None, "8", "t", None, "what")], "_id string, id string, text string, body string, conspiracy string")
    got = sorted(map(tuple, dc.harmonise(df).collect()))
    assert got == [("7", None, "b", "conspiracy"), ("8", None, "t", None)]
    m = spark.sql("select array(named_struct('startIndex', '0', 'endIndex', '3', 'type', 'actors', 'text', 'abc'), named_struct('startIndex', 'x', 'endIndex', '3', 'type', 'Action', 'text', ''), named_struct('startIndex', '1', 'endIndex', '2', 'type', 'other', 'text', '')) as markers, 1 as doc_id")
    assert [tuple(r) for r in m.select(dc.markers(F.col("markers")).alias("m")).first()["m"]] == [("Actor", 0, 3, "abc")]
    assert len(m.select(dc.markers(F.col("markers"), drop_bad=False).alias("m")).first()["m"]) == 2
    assert set(DOC_LABELS.values()) == {"conspiracy", "non", "cant_tell"}


def test_location_cascade(spark):
    text = "The  quick “brown” fox jumps; the quick brown fox sleeps."
    assert lc.locate(text, "fox", 2)[:2] == (text.rindex("fox"), text.rindex("fox") + 3)
    assert lc.locate(text, "THE QUICK BROWN FOX")[2] == "folded"
    assert lc.locate(text, 'the quick "brown" fox jumps')[:2] == (0, text.index(";"))
    assert lc.locate(text, "quick brwn fox sleeps")[2] == "near"
    assert lc.locate(text, "zebra crossing")[0] == -1 and lc.locate(None, "a")[0] == -1 and lc.locate(text, " ")[0] == -1
    assert lc.all_positions("aaaa", "aa") == [0, 1, 2]
    assert lc.locate_context(text, "the", "quick  brown", "fox sleeps") == (34, 45)
    assert lc.similarity("Big Pharma", "big pharma") == 1 and lc.similarity("elites and media", "media") == 0.9 and 0 < lc.similarity("a bad man", "bad men") < 1
    got = lc.locate_spans(spark.createDataFrame([(text, "sleeps"), (text, None)], "text string, quote string")).collect()
    assert [r["how"] for r in got] == ["exact", "miss"]


@settings(max_examples=40, deadline=None)
@given(st.text("ab ", max_size=12), st.text("ab ", min_size=1, max_size=4))
def test_exact_location_is_find(text, quote):
    if quote.strip() and quote in text:
        assert lc.locate(text, quote)[0] == text.index(quote)


def test_bh_and_auc(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.5,)], "p double")
    assert [r["p_bh"] for r in stat.benjamini_hochberg(df).orderBy("p").collect()] == [0.03, 0.03, 0.5]
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, score double")
    assert ev.auc(one).first()["auc"] is None
    two = spark.createDataFrame([(1, 0.2), (0, 0.2), (1, 0.9), (0, 0.1)], "y int, score double")
    assert ev.auc(two).first()["auc"] == 0.875


def test_votes_edge_cases(spark):
    v = spark.createDataFrame([(1, "yes", 0.9), (1, "no", 0.1), (2, "yes", 0.4)], "doc_id long, verdict string, confidence double")
    got = {r["doc_id"]: r["consensus"] for r in vt.council(v).collect()}
    assert got == {1: "split", 2: "unanimous"}
    p = spark.createDataFrame([(1, 0.6, None), (1, None, 0.9), (2, None, None)], "doc_id long, p_yes double, p_no double")
    assert {r["doc_id"]: r["p_yes"] for r in vt.average_probability(p).collect()} == {1: 0.35, 2: 0.5}


def test_knn_blocks(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.where("vec_id < 7")
    a = sorted(map(tuple, rt.knn(v, q, 5).collect()))
    b = sorted(map(tuple, rt.knn(v.repartition(5), q, 5, block=2).collect()))
    assert a == b and len(a) == 35
    assert rt.knn(v, q.where("false"), 5).count() == 0


def test_embed_falls_back(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "doc_id long, text string")

    def embedder(texts):
        if "bad" in texts:
            raise ValueError("bad")
        return [[float(len(t)), 1.0] for t in texts]

    got = {r["doc_id"]: list(r["embedding"]) for r in rt.embed(docs.coalesce(1), embedder, 2).collect()}
    assert got == {1: [1.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 1.0]}


def test_sampling_is_stable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_label", F.when(F.col("doc_id") % 3 == 0, "a"))
    a = sorted((r["doc_id"], r["fold"]) for r in sm.folds(docs, 4).collect())
    b = sorted((r["doc_id"], r["fold"]) for r in sm.folds(docs.repartition(7), 4).collect())
    assert a == b


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"_id": "1", "text": "x", "markers": [{"startIndex": 0, "endIndex": 1, "type": "Actor", "text": "x"}]}\n\nnot json\nnoise {"_id": "2"} noise\n')
    assert sorted(r["_id"] for r in readers.read_jsonl(spark, str(p)).collect()) == ["1"]
    assert sorted(r["_id"] for r in readers.read_jsonl_repaired(spark, str(p)).collect()) == ["1", "2"]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(p), strict=True).collect()
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    out = str(tmp_path / "out")
    assert writers.append_missing(rows.limit(1), out, "id") == 1 and writers.append_missing(rows, out, "id") == 1 and writers.append_missing(rows, out, "id") == 0
    assert writers.package(rows, str(tmp_path / "s.zip"), "s.jsonl") == 2
    up = writers.upsert(rows, spark.createDataFrame([("2", None)], "id string, v string"), "id", ["v"])
    assert sorted(map(tuple, up.collect()), key=str) == [("1", "a"), ("2", None)]
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "_id string")
    got = spark.createDataFrame([("1", "text"), ("2", "[deleted]"), ("3", " ")], "_id string, body string")
    ok, bad = readers.rehydrate(ids, got)
    assert ok.count() == 1 and {r["_id"]: r["reason"] for r in bad.collect()} == {"2": "deleted", "3": "empty_body", "4": "not_found"}
    pointer = tmp_path / "latest.txt"
    pointer.write_text(str(p) + "\n")
    assert readers.latest(spark, str(pointer)) == str(p)
    assert readers.read_json(spark, str(tmp_path / "none"), None) is None
    assert readers.fingerprints(spark, str(p)).first()["bytes"] == p.stat().st_size
    assert readers.has_labels(rows, F.col("v")) and not readers.has_labels(rows.withColumn("v", F.lit(None)), F.col("v"))


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as k union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 05:00:00', 'b'").write.parquet(src)
    stream = streams.read_stream(spark, src, "ts timestamp, k string")
    q = streams.windowed_counts(stream, "ts", "k").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["k"], r["n"]) for r in spark.table("w").collect()) == [("a", 2), ("b", 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SPAN + ", role string, score double")
    for df in (sp.nms(none, {}), sp.merge_gaps(none, ["doc_id"], 1), sp.resolve_conflicts(none), stat.overlap_pairs(none), sp.exact_vote(none)):
        assert df.count() == 0
    assert ev.prf(sp.greedy_match(none, none)).count() == 5
