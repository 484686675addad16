"""The text classifier against a fit in numpy, hard examples and temperatures against plain searches."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spanloom.operators import mining


def numpy_fit(train, terms, penalty, stop):
    """TF-IDF and Newton steps to the minimum, in numpy: a function from texts to probabilities of class 1."""
    words = lambda t: [w for w in re.findall(r"\b\w\w+\b", (t or "").lower()) if w not in stop]
    total, df = Counter(), Counter()
    for t, _ in train:
        total.update(words(t))
        df.update(set(words(t)))
    chosen = sorted(total, key=lambda w: (-total[w], w))[:terms]
    at, n = {w: i for i, w in enumerate(chosen)}, len(train)
    idf = np.array([math.log((1 + n) / (1 + df[w])) + 1 for w in chosen])

    def matrix(texts):
        x = np.zeros((len(texts), len(chosen)))
        for i, t in enumerate(texts):
            for w in words(t):
                if w in at:
                    x[i, at[w]] += 1
        x *= idf
        return np.column_stack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), np.ones(len(texts))])

    x, y = matrix([t for t, _ in train]), np.array([v for _, v in train], dtype=float)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    free = np.diag([1.0] * len(chosen) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        grad = penalty * x.T @ (weight * (p - y)) + free @ w
        w -= np.linalg.solve(penalty * (x * (weight * p * (1 - p))[:, None]).T @ x + free, grad)
    return lambda texts: 1 / (1 + np.exp(-matrix(texts) @ w))


def test_classifier_is_numpys_fit(spark):
    rng = random.Random(2)
    common, odd = ["the", "paper", "says", "ünder", "x1", "a"], ["secret", "they", "plot", "hidden"]
    text = lambda y: " ".join(rng.choices(common + odd * (3 if y else 1), k=rng.randint(3, 40)))
    train = [(text(y), y) for y in (1 if i % 4 == 0 else 0 for i in range(160))] + [(None, 0), ("", 1)]
    dev = [(i, text(i % 2), "yes" if i % 2 else "no") for i in range(50)] + [(50, "zzz unknown", "yes"), (51, None, "no"), (52, "secret plot", "maybe")]
    frame = spark.createDataFrame([(t, "yes" if y else "no") for t, y in train] + [("secret", "maybe")], "text string, doc_label string").repartition(5)
    told = mining.confident_errors(frame, spark.createDataFrame(dev, "doc_id long, text string, doc_label string"), "yes", "no", terms=7, penalty=2.0, stop=["the"], least=0.6)
    want = numpy_fit(train, 7, 2.0, {"the"})([t for _, t, label in dev if label != "maybe"])
    rows = {r.doc_id: r for r in told.collect()}
    assert sorted(rows) == list(range(52))
    for (i, _, label), p in zip([x for x in dev if x[2] != "maybe"], want, strict=True):
        assert rows[i].confidence == pytest.approx(max(p, 1 - p), abs=1e-6)
        assert rows[i].predicted == ("yes" if p > 0.5 else "no")
        assert rows[i].confident_error == (rows[i].predicted != label and max(p, 1 - p) > 0.6)
    assert any(r.confident_error for r in rows.values())
    with pytest.raises(ValueError, match="both classes"):
        mining.fit_texts(spark.createDataFrame([("a b", 1)], "text string, y int"))


def test_hard_examples_have_all_reasons_in_order(spark):
    docs = spark.createDataFrame([(i, s, label) for i, (s, label) in enumerate([("mix", "a"), ("mix", "b"), ("mix", "c"), ("pure", "a"), ("pure", "a"), (None, "a")])], "doc_id long, source string, doc_label string")
    spans = spark.createDataFrame([(0, "Action", 0, 10), (0, "Effect", 1, 10), (3, "Action", 0, 10), (3, "Effect", 9, 30), (4, "Action", 0, 9), (4, "Effect", 0, 10)], "doc_id long, label string, start long, end long")
    errors = spark.createDataFrame([(0, 0.91, True), (3, 0.99, False), (5, 0.85, True)], "doc_id long, confidence double, confident_error boolean")
    got = {r.doc_id: r.reasons for r in mining.hard_examples(docs, spans, errors).collect()}
    mixed = "High Source Entropy (1.58)"
    assert got == {0: ["High Action/Effect IoU (0.90)", mixed, "Baseline Confident Error (Conf: 0.91)"], 1: [mixed], 2: [mixed], 4: ["High Action/Effect IoU (0.90)"], 5: ["Baseline Confident Error (Conf: 0.85)"]}


@pytest.mark.parametrize("spread", [0.3, 1.0, 4.0, 60.0])
def test_temperature_is_the_minimum(spark, spread):
    rng = np.random.default_rng(1)
    logit = rng.normal(size=400) * spread
    y = (rng.random(400) < 1 / (1 + np.exp(-logit / spread * 1.3))).astype(int)
    frame = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, logit, strict=True)] + [(1, None), (None, 2.0)], "y int, logit double")
    t, nll = mining.fit_temperature(frame)
    loss = lambda t: np.mean(np.logaddexp(0, np.where(y == 1, -logit, logit) / t))
    low, high = 0.05, 5.0
    for _ in range(200):  # golden section over the logarithm
        a, b = (math.exp(math.log(low) + (math.log(high) - math.log(low)) * f) for f in (0.382, 0.618))
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    assert t == pytest.approx(low, abs=1e-4) and nll == pytest.approx(loss(low), abs=1e-9)
