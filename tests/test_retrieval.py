"""Nearest rows by blocks and by broadcast, against all pairs."""

import numpy as np
import pytest

from spanloom.operators import retrieval as rt
from spanloom.operators import staging


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_both_ways_find_the_nearest(spark, monkeypatch, limit):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(rt, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(rt, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(300, 6)), 1)
    v[40:60] = v[3]  # ties
    v[7] = 0
    rows = [(i, v[i].tolist(), int(i % 4), "ab"[i % 2]) for i in range(300)] + [(900, None, 1, "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, half string").repartition(5)
    queries = frame.where("vec_id % 5 = 0 or vec_id = 900")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
    sims = np.round(unit @ unit.T, 6)

    def best(q, among):
        return [(int(i), sims[q, i]) for i in sorted(among, key=lambda i: (-sims[q, i], i))[:9]]

    plain, tagged, halves = {}, {}, {}
    for r in rt.knn(frame, queries, 9).orderBy("rank").collect():
        plain.setdefault(r.query, []).append((r.vec_id, r.sim))
    for r in rt.knn(frame, queries, 9, tag="label").orderBy("rank").collect():
        tagged.setdefault(r.query, []).append((r.vec_id, r.sim))
    for r in rt.knn(frame, queries, 9, by="half").orderBy("rank").collect():
        halves.setdefault((r.query, r.half), []).append((r.vec_id, r.sim))
    for q in range(0, 300, 5):
        assert plain[q] == best(q, range(300))
        assert tagged[q] == best(q, [i for i in range(300) if i % 4 == q % 4])
        for h in (0, 1):
            assert halves[q, "ab"[h]] == best(q, range(h, 300, 2))
    assert 900 not in plain and rt.knn(frame, queries.limit(0), 9).count() == 0


def test_balanced_places_by_hand(spark):
    """One query, similarities by angle: the fallback, the evidence and the places as a list would have them."""
    angle = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    rows = [(0, angle(0), None)] + [(i, angle(i), label) for i, label in [(1, "non"), (2, "con"), (3, "non"), (4, "con"), (5, "con"), (6, "non"), (7, "cant"), (8, "amb"), (9, "con"), (10, "non")]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    from pyspark.sql import functions as F

    def picked(unclear, proof, k=5):
        out = rt.balanced(frame, frame.where("vec_id = 0"), k, "con", "non", unclear, F.col("vec_id") == proof, F.col("sim"))
        return [r.vec_id for r in out.orderBy("place").collect()]

    assert picked(("cant", "amb"), 2) == [2, 1, 7, 4, 3]
    assert picked(("nothing", "amb"), 2) == [2, 1, 8, 4, 3]
    assert picked(("nothing",), 2) == [2, 1, 4, 3, 6]  # the share of the unclear goes to the negative
    assert picked(("cant",), 10) == [2, 1, 7, 4, 3]  # the row with evidence follows, and is cut
    assert picked(("cant",), 10, 6) == [2, 1, 7, 4, 3, 6]
    assert picked(("nothing",), 9) == [2, 1, 4, 3, 9]


def test_strata_are_picked_as_one_group_is(spark):
    rng = np.random.default_rng(8)
    rows = [(i, np.round(rng.normal(size=5), 1).tolist(), "abc"[i % 3] if i < 90 else "few") for i in range(93)] + [(200, None, "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind string").repartition(6)
    got = {}
    for r in rt.mmr_strata(frame, {"a": 5, "b": 7, "few": 4}, "kind").orderBy("place").collect():
        got.setdefault(r.kind, []).append(r.vec_id)
    want = {}
    for kind, k in (("a", 5), ("b", 7), ("few", 4)):
        own = frame.where(f"kind = '{kind}' and embedding is not null").selectExpr("*", "0L as query")
        want[kind] = [r.vec_id for r in rt.mmr_centroid(own, k).orderBy("place").collect()]
    assert got == want and len(got["few"]) == 3
