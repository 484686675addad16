"""Selection, repair and profiles that SQL does not show: against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import profiles, repair, retrieval, sampling, selection

SPANS = "doc_id long, label string, start long, end long"


def test_overlap_policy_equals_plain_loop(spark):
    rng = random.Random(3)
    rows = [(d, rng.choice(["Actor", "Action", "Effect", "Victim", "Evidence"]), s, s + rng.randrange(1, 40)) for d in range(40) for s in [rng.randrange(120) for _ in range(14)]]
    rows = sorted(set(rows))

    def allowed(a, b):
        kinds = {a[1], b[1]}
        if kinds == {"Actor", "Victim"}:
            return False
        if kinds == {"Victim", "Action"}:
            v, act = (a, b) if a[1] == "Victim" else (b, a)
            return act[2] <= v[2] and v[3] <= act[3] and v[3] - v[2] <= 24
        return True

    want = []
    for d in range(40):
        kept = []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], r[2] - r[3], r[1])):
            drop = False
            for k in kept:
                if r[2] < k[3] and k[2] < r[3] and not allowed(r, k):
                    if r[1] == "Victim" and k[1] == "Actor":
                        drop = True
                    elif k[1] == "Victim" and r[1] == "Actor":
                        kept.remove(k)
                    elif r[3] - r[2] <= k[3] - k[2]:
                        drop = True
                    else:
                        kept.remove(k)
                    break
            if not drop:
                kept.append(r)
        want += kept
    got = [tuple(r) for r in repair.overlap_policy(spark.createDataFrame(rows, SPANS)).collect()]
    assert sorted(got) == sorted(want) and len(want) < len(rows)


def test_rich_scores_by_hand(spark):
    kind = "doc_id long, label string, start long, end long, span_text string"
    gold = spark.createDataFrame([(1, "Actor", 0, 4, "NASA"), (1, "Action", 10, 30, "hid the landing data"), (2, "Actor", 0, 3, "CIA")], kind)
    pred = spark.createDataFrame([(1, "Actor", 0, 4, "NASA"), (1, "Effect", 10, 30, "hid the landing data"), (3, "Actor", 0, 3, "FBI")], kind)
    got = {r["doc_id"]: (r["matched"], r["credit"], r["score"]) for r in repair.rich_scores(gold, pred).collect()}
    p = r = 1.0
    assert got[1] == (2, 1.5, pytest.approx(5 * p * r / (4 * p + r))) and got[2] == (0, 0.0, 0.0) and got[3] == (0, 0.0, 0.0)


def test_repair_finds_changed_echoes(spark):
    docs = spark.createDataFrame([(1, "He said “it is a Hoax” and left."), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Evidence", 5, 16, '"IT is  a hoax"'), (1, "Actor", 0, 2, "He"), (1, "Place", 0, 2, "He"), (1, "Actor", 40, 50, "nobody"), (1, "Victim", 3, 7, None), (2, "Actor", 0, 3, "He")], SPANS + ", said string")
    got = {(r["doc_id"], r["label"], r["start"]): (r["status"], r["new_start"], r["new_end"], r["snapped"], r["slice"]) for r in repair.validate_and_repair(items, docs).collect()}
    assert got[1, "Evidence", 5] == ("mismatch", 8, 22, True, "“it is a Hoax”") and got[1, "Actor", 0] == ("ok", 0, 2, False, "He")
    assert got[1, "Place", 0][0] == "badkeys" and got[1, "Actor", 40][0] == "oob" and got[1, "Victim", 3][4] == "said" and got[2, "Actor", 0][0] == "oob"


def test_fewshot_fold(spark):
    rows = [(i, int(i % 9 == 0), i % 90 == 0, i % 45 == 0) for i in range(300)]
    pool = spark.createDataFrame(rows, "doc_id long, n_spans int, has_ae boolean, has_victim boolean")
    by = {r[0]: r for r in rows}
    got = [by[r["doc_id"]] for r in selection.fewshot_for_document(pool).orderBy("place").collect()]
    assert len(got) == 8 and sum(r[1] > 0 for r in got) >= 2 and any(r[2] for r in got) and any(r[3] for r in got) and got[0][2]
    assert selection.fewshot_for_document(pool.where("false")).count() == 0


def test_mmr_variants_equal_plain_loops(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(25, 4))
    score = rng.normal(size=25).round(3)
    df = spark.createDataFrame([(0, i, v[i].tolist(), float(score[i])) for i in range(25)], "query long, vec_id long, embedding array<double>, score double")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = unit @ unit.T

    def loop(rel, weight, first):
        picked = []
        while len(picked) < 6:
            near = [max((sim[i, j] for j in picked), default=first) if picked or first == -1 else 0 for i in range(25)]
            value = [round(weight * rel[i] - (1 - weight) * max(near[i], first if first == -1 else near[i]), 9) if i not in picked else -9 for i in range(25)]
            picked.append(int(np.argmax(value)))
        return picked

    mean = unit.mean(axis=0)
    got = [r["vec_id"] for r in retrieval.mmr_centroid(df, 6).orderBy("place").collect()]
    assert got == loop(unit @ mean / np.linalg.norm(mean), 0.6, -1)
    q = (score - score.min()) / (score.max() - score.min())
    got = [r["vec_id"] for r in retrieval.mmr_quality(df, 6).orderBy("place").collect()]
    assert got == loop(q, 0.5, 0)
    assert [r["vec_id"] for r in retrieval.mmr_quality(df, 99).orderBy("place").collect()] == list(range(25))


def test_greedy_jaccard_chain(spark):
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words[i : i + 20]) for i in range(8)] + ["", None, "W1 w1", "w1"]
    got = sorted(r["doc_id"] for r in selection.greedy_jaccard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    kept = []
    for i, t in enumerate(texts):
        s = set((t or "").lower().split())
        if s and all(len(s & k) < 0.8 * len(s | k) for _, k in kept):
            kept.append((i, s))
    assert got == [i for i, _ in kept]


def test_hash_ranks_and_nulls(spark):
    rows = [(i, None if i % 3 == 0 else "a") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = selection.hash_ranked(df, ["source"], sampling.shuffled("doc_id"), "doc_id", digits=1).collect()
    assert sorted(r["nth"] for r in got if r["source"] is None) == list(range(1, 68)) and len(got) == 200
    assert selection.pseudo_groups(df, 50).where("source is null").select("group").distinct().count() == 2


def test_text_shapes(spark):
    md = "# Title\n\nSome **bold** and *soft* text, a [link](http://x.y/z) ![pic](a.png)\n\n> quoted\n- item `code`\n```\nblock\n```\nend"
    df = spark.createDataFrame([(md, "ﬁne  “Ｆull”"), (None, None)], "m string, n string")
    r = df.select(tx.markdown_text(F.col("m")).alias("m"), tx.nfkc_key(F.col("n")).alias("n")).collect()
    assert r[0]["m"] == "Title Some bold and soft text, a link quoted item end" and r[0]["n"] == 'fine "full"' and r[1]["m"] is None and r[1]["n"] == ""


def test_profiles_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, source string, n_chars long, text string, doc_label string")
    assert profiles.describe(none, "n_chars", ["source"]).count() == 0
    marks = spark.createDataFrame([], SPANS)
    assert {r["docs"] for r in profiles.marker_presence(none, marks).where("kind <> 'types'").collect()} <= {0, None}
