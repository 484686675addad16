"""Similar sets of words: none is missed, and few others are looked at."""

import random

import pytest

from spanloom.operators import selection

KIND = "doc_id long, text string"


def _texts():
    rng = random.Random(7)
    common = [f"c{i}" for i in range(30)]
    own = [f"w{i}" for i in range(900)]
    out = []
    for i in range(240):
        m = rng.choice([4, 5, 9, 20, 60, 150, 400])
        words = rng.sample(common, min(m // 2, 30)) + rng.sample(own, m - min(m // 2, 30))
        out.append(words)
        for _ in range(i % 3):  # some words fewer, some others
            near = [w for w in words if rng.random() > rng.choice([0.02, 0.1, 0.2])]
            out.append((near or words) + rng.sample(own, rng.randrange(1 + m // 12)))
    rng.shuffle(out)
    return [" ".join(w) for w in out] + ["\t\n", ""]


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_candidates_have_all_similar_pairs(spark, threshold):
    sets = [sorted(set(t.split())) for t in _texts()]
    pairs = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and a != b and len(set(a) & set(b)) >= (threshold - 1e-9) * len(set(a) | set(b))}
    got = {(r["x"], r["y"]) for r in selection.jaccard_candidates(spark.createDataFrame(list(enumerate(sets)), "doc_id long, w array<string>"), threshold).collect()}
    assert len(pairs) > 100 and pairs <= got and len(got) < len(sets) ** 2 / 4
    gone = set()
    for i, a in enumerate(sets):
        same = any(b == a for b in sets[:i])
        if same or any((j, i) in pairs and j not in gone for j in range(i)) or not a:
            gone.add(i)
    kept = selection.greedy_jaccard(spark.createDataFrame(list(enumerate(_texts())), KIND), threshold).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(range(len(sets))) - gone)


def test_words_in_every_tenth_text_make_no_candidates(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(1000)]
    sets = [(i, sorted(rng.sample(words, 100))) for i in range(1500)]  # any two share ten words or so
    assert selection.jaccard_candidates(spark.createDataFrame(sets, "doc_id long, w array<string>"), 0.8).count() < 100
