"""A task's similarities stay within a bound, and the best do not depend on it."""

import tracemalloc

import numpy as np

from spanloom.operators import retrieval as rt


def test_bounded_and_exact():
    rng = np.random.default_rng(5)
    queries, rows = rng.integers(-3, 4, (2048, 8)).astype(float), rng.integers(-3, 4, (10_000, 8)).astype(float)
    keys = rng.permutation(10_000)
    tracemalloc.start()
    best = rt._Nearest(5, rt.BLOCK_QUERIES, np.arange(2048), list(queries), None)
    best.add(keys, list(rows), None, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20, peak
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10)
    got = next(best.frames("key", None)).sort_values(["query", "sim", "key"], ascending=[True, False, True])
    for q in range(0, 2048, 97):
        sims = np.round(unit(rows) @ unit(queries)[q], 6)
        want = np.lexsort((keys, -sims))[:5]
        assert got["key"][got["query"] == q].tolist() == keys[want].tolist()
