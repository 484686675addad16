"""Gold spans meet predictions as in plain loops, and no row for a token moves."""

import random

import numpy as np

from spanloom.operators import evaluation as ev
from spanloom.operators import spans as sp


def _iou(a, b):
    common = min(a[1], b[1]) - max(a[0], b[0])
    return common / (max(a[1], b[1]) - min(a[0], b[0])) if common > 0 else 0.0


def _taken(gold, pred, threshold):
    """The greedy match in plain loops, over (group, start, end) in order."""
    used, hit = set(), []
    for g, *a in gold:
        best = max(((_iou(a, b), -k) for k, (p, *b) in enumerate(pred) if p == g and k not in used), default=(0.0, 0))
        hit.append(best[0] > 0 and best[0] >= threshold)
        if hit[-1]:
            used.add(-best[1])
    return hit


def test_matched_equals_loops(monkeypatch):
    rng = random.Random(5)
    for pairs in (1, 7, 1 << 20):
        monkeypatch.setattr(sp, "PAIRS", pairs)
        for _ in range(150):
            most = rng.choice((3, 12, 40))
            made = [sorted((rng.randrange(3), s := rng.randrange(-2, most), s + rng.randrange(-1, 9)) for _ in range(rng.randrange(25))) for _ in range(2)]
            sides = [tuple(np.array(x, np.int64).reshape(-1, 3).T) for x in made]
            t = rng.choice((0.0, 0.3, 0.5, 0.9))
            assert sp.matched(*sides, t).tolist() == _taken(*made, t), (made, t)


def test_token_match_equals_loops(spark):
    rng = random.Random(6)
    texts = {k: rng.choice((None, "", "  ", " ".join(rng.choice(("a", "bé", "\U0001d11eccc", "")) for _ in range(30)))) for k in range(40)}
    rows = [(k, rng.choice(("gold", "pred")), rng.choice(("Actor", "Victim")), s, s + rng.randrange(0, 12)) for k in range(42) for s in (rng.randrange(-3, 90) for _ in range(12))]
    rows += rows[:60]
    known = [k for k in range(40) if k % 3]
    spans = spark.createDataFrame(rows, "doc_id long, role string, label string, start long, end long")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    told = spark.createDataFrame([(k,) for k in known + known], "doc_id long")
    for only, strict in ((None, False), (told, False), (told, True)):
        sides = {"gold": [], "pred": []}
        for k, role, label, s, e in sorted(set(rows)):
            at, touched = 0, []
            for i, tok in enumerate((texts.get(k) or "").split(" ")):
                if tok and max(s, at) < min(e, at + len(tok)):
                    touched.append(i)
                at += len(tok) + 1
            if touched and (only is None or k in known or strict and role == "pred"):
                sides[role].append(((k, label), touched[0], touched[-1] + 1))
        gold, pred = sorted(sides["gold"]), sorted(sides["pred"])
        want = {x: [0, 0, 0] for x, *_ in gold + pred}
        for (x, *_), hit in zip(gold, _taken(gold, pred, 0.5), strict=True):
            want[x][0 if hit else 2] += 1
        for x, *_ in pred:
            want[x][1] += 1
        want = {x: (tp, p - tp, fn) for x, (tp, p, fn) in want.items()}
        got = ev.token_match(spans, docs, only, strict)
        assert {(r["doc_id"], r["label"]): (r["tp"], r["fp"], r["fn"]) for r in got.collect()} == want
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # neither tokens nor cells as rows
