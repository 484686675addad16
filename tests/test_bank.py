"""The diversified bank against its passes over the whole pool."""

import hashlib
import random

import pytest

from spanloom.operators import bank as bk


def slow_bank(rows, n, negatives, n_complex, most):
    """Every pass over all rows, by lists."""
    order = lambda r: (r["n_spans"], r["n_overlaps"], r["n_nested"], len(r["labels"]), "Action" in r["labels"] and "Effect" in r["labels"])
    rows = sorted(rows, key=lambda r: r["doc_id"])
    pos = [r for r in rows if r["labels"]]
    hard_ones = [r for r in pos if r["n_spans"] >= 6 and r["n_overlaps"] >= 1]
    others = [r for r in pos if r not in hard_ones]
    hard_ones.sort(key=order, reverse=True)
    others.sort(key=lambda r: (r["quality"], "Action" in r["labels"] and "Effect" in r["labels"], "Victim" in r["labels"]), reverse=True)
    budget, count, out, normals = n - negatives, {}, [], []
    fits = lambda r: all(count.get(x, 0) + 1 <= most for x in r["labels"])

    def take(r, how):
        out.append((r["doc_id"], how))
        if how != "complex":
            normals.append(r)
        for x in r["labels"]:
            count[x] = count.get(x, 0) + 1

    gone = lambda r: r["doc_id"] in [k for k, _ in out]
    for r in hard_ones:
        if len(out) < min(n_complex, budget) and fits(r):
            take(r, "complex")
    ev, ac = set(bk.EVIDENCE_KINDS), set(bk.ACTOR_KINDS)
    for r in others:
        if len(out) < budget and "Evidence" in r["labels"] and ev & set(r["evidence_kinds"]) and fits(r):
            take(r, "evidence")
            ev -= set(r["evidence_kinds"])
    for r in others:
        if len(out) < budget and not gone(r) and "Actor" in r["labels"] and ac & set(r["actor_kinds"]) and fits(r):
            take(r, "actor")
            ac -= set(r["actor_kinds"])
    for how, has in (("victim", lambda r: "Victim" in r["labels"]), ("action_effect", lambda r: "Action" in r["labels"] and "Effect" in r["labels"])):
        if not any(has(r) for r in normals):
            for r in others:
                if len(out) < budget and not gone(r) and has(r) and fits(r):
                    take(r, how)
                    break
    for r in others:
        if len(out) < budget and not gone(r) and fits(r):
            take(r, "quality")
    rest = sorted(pos, key=lambda r: (order(r), r["quality"]), reverse=True)
    for how in ("rest", "relaxed"):
        for r in rest:
            if len(out) < budget and not gone(r) and (fits(r) or how == "relaxed"):
                take(r, how)
    if not pos:
        negatives = n
    at = lambda r: (hashlib.md5(f"bank:{r['doc_id']}".encode()).hexdigest(), r["doc_id"])
    free = sorted((r for r in rows if r["pool"] and not r["labels"]), key=at)
    hard = [r for r in free if r["pool"] == "hard"][: min(1, negatives)]
    clean = [r for r in free if r["pool"] == "clean"][: max(0, negatives - len(hard))]
    return out + [(r["doc_id"], "hard") for r in hard] + [(r["doc_id"], "clean") for r in clean]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bank_is_the_passes_over_everything(spark, seed):
    rng = random.Random(seed)
    labels = ["Action", "Actor", "Effect", "Evidence", "Victim"]
    rows = []
    for i in range(1500):
        own = sorted(rng.sample(labels, rng.choice([0, 1, 1, 2, 3] if seed < 3 else [0, 1])))
        rows.append({
            "lang": rng.choice(["a", "b", "c", "d"]), "doc_id": i, "labels": own if i % 11 else [], "evidence_kinds": sorted(rng.sample(sorted(bk.EVIDENCE_KINDS), rng.choice([0, 1, 2]))) if "Evidence" in own else [],
            "actor_kinds": sorted(rng.sample(sorted(bk.ACTOR_KINDS), rng.choice([0, 1]))) if "Actor" in own else [], "n_spans": rng.choice([1, 2, 6, 7]), "n_overlaps": rng.choice([0, 1, 3]), "n_nested": rng.choice([0, 1]),
            "quality": rng.choice([0.5, 1.0, 2.5]), "pool": rng.choice([None, "clean", "hard"]),
        })
        if rows[-1]["lang"] == "d":
            rows[-1].update(labels=[], pool="clean")  # a value without positives
    schema = "lang string, doc_id long, labels array<string>, evidence_kinds array<string>, actor_kinds array<string>, n_spans long, n_overlaps long, n_nested long, quality double, pool string"
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(6)
    n, negatives, most = {1: (10, 2, 2), 2: (30, 4, 9), 3: (10, 2, 1)}[seed]
    got = {}
    for r in bk.diversified_bank(frame, "lang", n, negatives, 3, most=most).collect():
        got.setdefault(r.lang, []).append((r.doc_id, r.how, r.place))
    seen = set()
    for lang in "abcd":
        want = slow_bank([r for r in rows if r["lang"] == lang], n, negatives, 3, most)
        assert sorted((k, how) for k, how, _ in got[lang]) == sorted(want)
        assert sorted(p for _, _, p in got[lang]) == list(range(1, len(want) + 1))
        seen |= {how for _, how in want}
    assert seen >= {"complex", "hard", "clean"} and ({"evidence", "actor"} <= seen if seed == 2 else "relaxed" in seen)


def test_signals_of_spans(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    spans = spark.createDataFrame([(1, "Actor", 0, 10, "they and Jane Doe"), (1, "Evidence", 2, 5, "see www.x.org: 5 percent"), (1, "Victim", 2, 5, "us"), (1, "Actor", 9, 12, "BBC")], "doc_id long, label string, start long, end long, span_text string")
    a, b = bk.bank_signals(docs, spans, F.length("span_text")).orderBy("doc_id").collect()
    assert (a.n_spans, a.n_overlaps, a.n_nested, a.labels) == (4, 4, 4, ["Actor", "Evidence", "Victim"])
    assert (a.evidence_kinds, a.actor_kinds, a.quality) == (["numeric_source", "url"], ["named_org", "named_person", "vague_collective"], 11.5)
    assert (b.n_spans, b.n_overlaps, b.labels, b.evidence_kinds, b.quality) == (0, 0, [], [], 0.0)
    bank = spark.createDataFrame([(1, "quality")], "doc_id long, how string")
    assert [(r.label, r.start) for r in bk.bank_spans(bank, spans).orderBy("start", "label").collect()] == [("Actor", 0), ("Evidence", 2), ("Victim", 2)]
    assert bk.bank_spans(bank, spans, most=2).count() == 2
    assert bk.bank_spans(spark.createDataFrame([(1, "complex")], "doc_id long, how string"), spans, most=2).count() == 4
