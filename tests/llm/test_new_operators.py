"""Importance resampling, vector codes and exact duplicates."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import codes, common, crc, exact, importance
from spanloom.operators import staging

# ---------------------------------------------------------------- CRC algebra


def test_words_have_zlibs_crcs():
    texts = [b"", b"The Quick brown-fox_42", "näive ÄÖ 你好 x".encode(), b"a" * 1000 + b" " + b"B" * 47 + b" " + b"c" * 48 + b" " + b"d" * 49]
    data, starts, ends = crc.words(np.frombuffer(b"\n".join(texts), dtype=np.uint8))
    want = [w for t in texts for w in re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t))]
    assert [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] == want
    assert crc.word_crcs(data, starts, ends).tolist() == [zlib.crc32(w) for w in want]


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_runs_have_zlibs_crcs(width):
    rng = random.Random(width)
    docs = [[bytes(rng.choices(b"abcdefgh", k=rng.choice([1, 3, 7, 300, 70_000 if width == 2 else 9]))) for _ in range(rng.choice([0, 1, 2, 9]))] for _ in range(12)]
    flat = [(i, w) for i, d in enumerate(docs) for w in d]
    own = np.array([zlib.crc32(w) for _, w in flat], dtype=np.uint32)
    got, of = crc.gram_crcs(own, np.array([len(w) for _, w in flat]), np.array([i for i, _ in flat]), width)
    want = Counter((i, zlib.crc32(b" ".join(d[s : s + k]))) for i, d in enumerate(docs) for k in range(1, width + 1) for s in range(len(d) - k + 1))
    assert Counter(zip(of.tolist(), got.tolist(), strict=True)) == want


def test_joined_is_crc_of_concatenation():
    a, b = b"left part", b"right " * 999
    out = crc.joined(np.array([zlib.crc32(a), 0], dtype=np.uint32), np.array([zlib.crc32(b), 5], dtype=np.uint32), np.array([len(b), 0]))
    assert out.tolist() == [zlib.crc32(a + b), 5]


# ---------------------------------------------------------------- importance resampling


def brute_resample(docs, target, width, buckets=10_000, least=20, percent=10, seed=2024):
    """Rows (key, n_features, weight, score, rank) by plain loops over strings."""

    def features(t):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        return [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, width + 1) for i in range(len(w) - k + 1)], len(w)

    s, t = (Counter(f for x in texts for f in features(x)[0]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (S + buckets)) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for k, x in docs:
        f, n = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    enough = [r for r in rows if r[5] >= least]
    for i, r in enumerate(sorted(enough, key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))[: percent * len(enough) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def told(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("width", [1, 3])
def test_resample_is_brute_force(spark, width):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "ümlaut", "42", "x" * 60, "delta", "of", "the"]
    docs = [(i, " ".join(rng.choices(vocabulary[: rng.choice([2, 8])], k=rng.choice([0, 3, 19, 20, 21, 300])))) for i in range(300)] + [(300, None), (None, "alpha " * 25), (7, docs_text := "of the " * 40), (7, docs_text), (301, "w " * 400_000)]
    target = ["alpha Beta " * 9, None, "ümlaut"]
    frame = spark.createDataFrame([(k, t, 1.5) for k, t in docs], "doc_id long, text string, Score double").repartition(7)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resample(frame, bench, width=width, percent=25)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert told(map(tuple, out.collect())) == told(brute_resample(docs, target, width, percent=25))
    assert importance.resample(frame.limit(0), bench).count() == 0
    assert importance.resample(frame, bench.limit(0), width=1).where("rank is not null").count() > 0


# ---------------------------------------------------------------- vector codes


def brute_codes(rows, parts, entries, rounds):
    """(key, code, error) and the final entries, with whole numbers and plain loops."""
    ints = sorted(((k, [math.floor(4096 * x) for x in v]) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(ints[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v in ints[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v in ints:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if own[e] else old for e, old in enumerate(books[p])]
    found = [(k, [near(cut(v, p), books[p]) for p in range(parts)]) for k, v in ints]
    return [(k, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for k, f in found], books


@pytest.mark.parametrize(("width", "parts", "n"), [(32, 4, 200), (40, 8, 60), (8, 8, 9), (64, 1, 50)])
def test_codes_are_brute_force(spark, width, parts, n):
    rng = np.random.default_rng(width)
    vectors = np.round(rng.normal(size=(n, width)) * rng.choice([0.01, 1, 300], size=(n, 1)), 3).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000, vectors[0]), (None, vectors[1]), (5, vectors[2]), (-1, None), (-2, [None] * width), (-3, [math.nan] * width), (-4, [math.inf] + [0.0] * (width - 1))]
    labels = [None if i % 5 == 0 else i % 3 for i in range(len(rows))]
    frame = spark.createDataFrame([(k, v, y, "x") for (k, v), y in zip(rows, labels, strict=True)], "vec_id long, embedding array<float>, label int, Code string").repartition(5)
    out = codes.compress(frame, parts=parts, rounds=3)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    want, books = brute_codes(rows, parts, 16, 3)
    got = out.collect()
    assert told((r.vec_id, r.code, r.error) for r in got) == told(want)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()}
    total = Counter()
    for r in got:
        total[r.label] += r.error
    assert all(r.label_error == total[r.label] for r in got)


def test_odd_vectors_have_no_code(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, [1.0]), (4, [1e30, 0.0]), (5, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in codes.compress(frame, parts=2, label=None).collect()} == {1, 5}
    assert codes.compress(frame.limit(0), parts=2, label=None).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(frame, parts=3, label=None)


def test_bounds_filter_and_never_lose_the_nearest():
    rng = np.random.default_rng(3)
    x = np.floor(4096 * rng.normal(size=(3000, 16)) * rng.choice([0.001, 1, 900], size=(3000, 1))).astype(np.int64)
    book = np.concatenate([x[:15], x[3:4]])  # with a repeated entry: ties
    best, error = codes.nearest(x, book)
    all_of_them = ((x[:, None] - book) ** 2).sum(2)
    assert (best == all_of_them.argmin(1)).all() and (error == all_of_them.min(1)).all()
    near = rng.integers(0, 15, 3000)
    row, _ = codes.candidates(book[near] + rng.integers(-9, 9, (3000, 16)), book)
    assert len(row) < 0.5 * 3000 * 16  # most pairs are ruled out without their distance


# ---------------------------------------------------------------- exact duplicates


def test_copies_are_brute_force(spark):
    rng = random.Random(1)
    lead = "same first characters, as in a licence that many files begin with. " * 2
    pool = ["", "a", "b", "ab", "ba", lead + "x", lead + "y", lead + "xy", "é", "é", "zz ", "zz", "long " * 300_000]
    docs = [(i, rng.choice(pool)) for i in range(400)] + [(400, None), (None, "b"), (None, "only null key"), (None, "only null key"), (3, "twice"), (3, "twice"), (500, "alone")]
    frame = spark.createDataFrame([(k, t, "u", i) for i, (k, t) in enumerate(docs)], "doc_id long, text string, KEPT string, n long").repartition(6)
    out = exact.label_copies(frame)
    assert out.columns == ["doc_id", "n", "keep_id", "group_size", "kept", "text_sha256"]
    groups = defaultdict(list)
    for i, (k, t) in enumerate(docs):
        groups[t or ""].append((k, i))
    kept = Counter()
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r.n][1] or ""
        ids = [k for k, _ in groups[t] if k is not None]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), len(groups[t]))
        assert not r.kept or r.doc_id == r.keep_id
        kept[t] += r.kept
        alone_by_length = sum(len(u.encode()) == len(t.encode()) for u in groups) == 1 and len(groups[t]) == 1
        assert r.text_sha256 == (None if alone_by_length else hashlib.sha256(t.encode()).hexdigest()) or len(groups[t]) == 1
    assert set(kept) == set(groups) and set(kept.values()) == {1}
    assert {r.text_sha256 for r in exact.label_copies(frame, digests=True).collect()} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    assert exact.label_copies(frame.limit(0)).count() == 0
    folded = exact.label_copies(frame, normalise=lambda c: F.trim(c)).where("group_size > 1").agg(F.max("group_size")).first()[0]
    assert folded >= max(len(groups["zz"]) + len(groups["zz "]), 1)


def test_lookup_with_hot_keys_joins_as_broadcast_does(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"))
    groups = common.staged(rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most")))
    plain = told(map(tuple, common.lookup(rows, groups, ["k"], "n").select("id", "k", "n", "most").collect()))
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
    assert told(map(tuple, common.lookup(rows, groups, ["k"], "n").select("id", "k", "n", "most").collect())) == plain
    docs = spark.createDataFrame([(i, "hot" if i % 2 else f"text {i % 40}") for i in range(200)], "doc_id long, text string")
    assert exact.label_copies(docs).where("kept").count() == 21
