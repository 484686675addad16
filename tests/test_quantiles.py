"""Exact quantiles from counts, in a window and in ranges, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import ranks, staging


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_quantiles_are_numpys(spark, monkeypatch, limit):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(3)
    rows = [(g, float(x)) for g, n in (("a", 500), ("b", 1), (None, 40), ("d", 2)) for x in np.round(rng.normal(size=n) * 3, 1)] + [("a", None), ("e", None)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(7)
    shares = {"q0": 0.0, "q13": 0.13, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    got = {r.g: r for r in ranks.quantiles(ranks.value_counts(frame, ["g"], F.col("x")), ["g"], shares).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for g, r in got.items():
        own = [x for h, x in rows if h == g and x is not None]
        for k, p in shares.items():
            assert r[k] == pytest.approx(np.quantile(own, p), abs=1e-12)
    (whole,) = ranks.quantiles(ranks.value_counts(frame, [], F.col("x")), [], shares).collect()
    assert whole.q13 == pytest.approx(np.quantile([x for _, x in rows if x is not None], 0.13), abs=1e-12)


def test_rank_test_has_ties_and_continuity(spark):
    """p against a plain computation of the same approximation, with math.erfc."""
    import math

    from spanloom.operators import statistics as st

    rng = np.random.default_rng(5)
    rows = [(m, "a" if i % 3 else "b", float(x)) for m, shift in (("near", 0.0), ("far", 1.2)) for i, x in enumerate(np.round(rng.normal(size=90), 1)) for x in [x + shift * (i % 3 == 0)]] + [("same", g, 1.0) for g in "aab"]
    got = {r.metric: r for r in st.mann_whitney_p(spark.createDataFrame(rows, "metric string, g string, v double"), "v", "g", "a", "b").collect()}
    for m, r in got.items():
        a, b = ([v for k, g, v in rows if k == m and g == side] for side in "ab")
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        n = len(a) + len(b)
        ties = sum(t**3 - t for t in (sum(v == w for w in a + b) for v in set(a + b)))
        spread = math.sqrt(max(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))), 0))
        z = max(abs(u - len(a) * len(b) / 2) - 0.5, 0) / spread if spread else 0.0
        assert r.u == pytest.approx(u) and r.p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=2e-6)
    assert got["same"].p == 1.0 and got["far"].p < 0.001 < got["near"].p
