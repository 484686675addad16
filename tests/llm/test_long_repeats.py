"""Least substrings in texts of more bytes than their places' bits can number."""

import numpy as np

from spanloom.llm import repeats


def test_first_of_equals_across_blocks(monkeypatch):
    monkeypatch.setattr(repeats, "_AT", 6)
    rng = np.random.default_rng(2)
    value = rng.integers(0, 3, 1000).astype(np.uint64) << np.uint64(6)
    value |= rng.integers(0, 64, 1000).astype(np.uint64)
    want = [k + int(np.argmin(value[k : k + 20] >> np.uint64(6))) for k in range(981)]
    assert repeats.least_places(value, 20).tolist() == want
    assert repeats.least_places(value[:19], 20).tolist() == [] and repeats.least_places(value[:20], 20).tolist() == want[:1]


def test_equal_windows_agree_behind_16_mebibytes():
    rng = np.random.default_rng(4)
    own = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    twice = own(128)
    shared = own(80) + twice + own(120) + twice + own(60)  # one substring twice, so that ties matter
    places = []
    for before in (b"", own((1 << 24) - 300), own((1 << 24) - 90), own(2 * (1 << 24) - 250)):
        _, at, count, mer, _, lead = repeats.runs([before + shared], 400)
        found = {}
        for s, n, m, x in zip(at.tolist(), count.tolist(), mer.tolist(), lead.tolist(), strict=True):
            for k in range(max(s, len(before)), s + n):
                found[k - len(before)] = (m, x - (k - s))
        assert sorted(found) == list(range(len(shared) - 399))
        places.append(found)
    assert all(p == places[0] for p in places)
