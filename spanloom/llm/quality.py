"""Quality classifier: conjunctive rules taken from boosted trees' paths, weighed by a lasso logistic fit, compiled to column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import concat, fresh, prefix_hash, shingles, slices, small_batches, word_hashes, words

#: The classifier is fitted on at most about so many labelled rows, chosen by a hash of their ids.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 24, 3, 0.3, 32

STATISTICS = ("n_bytes", "n_words", "word_bytes", "longest_word", "upper", "lower", "digit", "space", "high", "symbol", "point", "bang", "bar", "words_a_line", "same_lines", "kinds_of_words", "kinds_of_pairs", "commonest_word", "marked_words", "capital_words", "short_words")


def _classes() -> np.ndarray:
    """For each byte, which of ten kinds it is."""
    out = np.zeros(256, dtype=np.uint8)
    for i, group in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\n\v\f", "", "#$%&*+=<>@^~_\\/{}[]", ".,;:?'\"()-", "!", "|"), 1):
        out[[ord(c) for c in group]] = i
    out[128:] = 5
    return out


_CLASS = _classes()


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n groups: how many different values, and how often the commonest occurs."""
    if not len(value):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])]))
    size = np.diff(np.append(first, len(g)))
    most = np.zeros(n)
    np.maximum.at(most, g[first], size)
    return np.bincount(g[first], minlength=n).astype(float), most


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """STATISTICS of each text; texts without words or bytes have 0 throughout where a share is undefined."""
    n = len(texts)
    data, at = concat(texts)
    size = (np.diff(at) - 1).astype(float)
    out = {"n_bytes": size}
    kind = _CLASS[data]
    share = lambda x, of: np.divide(x, of, out=np.zeros(n), where=of > 0)
    for name, k in zip(("upper", "lower", "digit", "space", "high", "symbol", "point", "bang", "bar"), range(1, 10), strict=True):
        here = np.add.reduceat(kind == k, at[:-1], dtype=np.int64) if n else np.zeros(0)
        out[name] = share(here - (k == 4), size)  # without the line end after each text
    s, e = words(data)
    h, _ = word_hashes(data)
    first = np.searchsorted(s, at)
    doc = np.repeat(np.arange(n), np.diff(first))
    count = np.diff(first).astype(float)
    length = (e - s).astype(float)
    out["n_words"] = count
    out["word_bytes"] = share(np.bincount(doc, length, minlength=n), count)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    out["longest_word"] = longest
    if len(s):
        head, tail = _CLASS[data[s]], _CLASS[data[e - 1]]
        out["marked_words"] = share(np.bincount(doc, ((tail == 6) | (tail == 8)).astype(float), minlength=n), count)
        out["capital_words"] = share(np.bincount(doc, (head == 1).astype(float), minlength=n), count)
        out["short_words"] = share(np.bincount(doc, (length <= 3).astype(float), minlength=n), count)
    else:
        out |= {k: np.zeros(n) for k in ("marked_words", "capital_words", "short_words")}
    kinds_of, most = _distinct(doc, h, n)
    out["kinds_of_words"], out["commonest_word"] = share(kinds_of, count), share(most, count)
    pair, begin = shingles(texts, 2)
    m = np.diff(begin).astype(float)
    out["kinds_of_pairs"] = share(_distinct(np.repeat(np.arange(n), np.diff(begin)), pair, n)[0], m)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    p, up = prefix_hash(data)
    line_doc = np.searchsorted(at, starts, side="right") - 1
    full = ends > starts
    lines = np.bincount(line_doc[full], minlength=n).astype(float)
    out["words_a_line"] = share(count, lines)
    out["same_lines"] = share(lines - _distinct(line_doc[full], (p[ends] - p[starts])[full] * up[starts[full]], n)[0], lines)
    return {k: out[k] for k in STATISTICS}


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """Adds a struct of STATISTICS of the whole text (null: that of an empty one); returns its name, too."""
    (name,) = fresh(docs, "stats")
    kind = pa.struct([(k, pa.float64()) for k in STATISTICS])

    @F.arrow_udf(f"struct<{','.join(f'{k}: double' for k in STATISTICS)}>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [statistics(texts) for _, _, texts in slices(batch)]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.float64()) for k in STATISTICS], fields=list(kind))

    return docs.withColumn(name, measure(F.col(text).cast("binary"))), name


# ---------------------------------------------------------------- fitting, on the bounded sample


def _grow(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple, paths: list, step: np.ndarray) -> None:
    """Grows a regression tree on binned columns; adds the path of each node below the root to paths, and each leaf's value to step."""
    best = (1e-6, None)
    g, h = grad[rows].sum(), hess[rows].sum()
    if depth and len(rows) >= 40:
        for j in range(bins.shape[1]):
            gs = np.bincount(bins[rows, j], grad[rows], minlength=BINS).cumsum()[:-1]
            hs = np.bincount(bins[rows, j], hess[rows], minlength=BINS).cumsum()[:-1]
            ns = np.bincount(bins[rows, j], minlength=BINS).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < 15) | (len(rows) - ns < 15)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
    if best[1] is None:
        step[rows] = -g / (h + 1)
        return
    j, k = best[1]
    low = bins[rows, j] <= k
    for side, part in ((True, rows[low]), (False, rows[~low])):
        here = (*path, (j, k, side))
        paths.append(here)
        _grow(bins, grad, hess, part, depth - 1, here, paths, step)


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the logistic loss with an absolute penalty on the weights, not on the offset."""
    n, m = x.shape
    wide = np.column_stack([x, np.ones(n)])
    rate = 4.0 / max(np.linalg.eigvalsh(wide.T @ wide / n)[-1], 1e-9)
    w = z = np.zeros(m)
    b = c = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    t = 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(x @ z + c, -35, 35))) - y
        w2 = z - rate * (x.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        b2 = c - rate * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        moved = max(np.abs(w2 - w).max(initial=0), abs(b2 - b))
        w, b, t = w2, b2, t2
        if moved < 1e-4:
            break
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 5) -> tuple[list[tuple[float, tuple]], float]:
    """Weighted rules and an offset: a rule is a tuple of (column number, threshold, whether at most it).

    The penalty is that of a few with the least log loss on a fifth of the rows; the weights are then fitted on all.
    """
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        return [], float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    f = np.zeros(len(y))
    paths: list[tuple] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        half = np.sort(rng.permutation(len(y))[: max(1, len(y) * 3 // 4)])
        tree: list[tuple] = []
        _grow(bins, p - y, p * (1 - p), half, DEPTH, (), tree, step)
        paths += tree
        f += RATE * step
    rules = []
    for path in dict.fromkeys(tuple(sorted(p)) for p in paths):
        bound: dict[tuple[int, bool], int] = {}
        for j, k, side in path:  # of two bounds on one column the tighter
            bound[j, side] = (min if side else max)(k, bound.get((j, side), k))
        rules.append(tuple((j, float(cuts[j][k]), side) for (j, side), k in sorted(bound.items()) if k < len(cuts[j])))
    rules = [r for r in dict.fromkeys(rules) if r]
    hit = np.column_stack([np.all([(x[:, j] <= t) == side for j, t, side in r], axis=0) for r in rules]).astype(float)
    held = rng.random(len(y)) < 0.2
    loss = {}
    for penalty in (0.01, 0.003, 0.001, 0.0003):
        w, b = _lasso(hit[~held], y[~held], penalty)
        q = np.clip(1 / (1 + np.exp(-(hit[held] @ w + b))), 1e-6, 1 - 1e-6)
        loss[penalty] = -(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q)).mean()
    w, b = _lasso(hit, y, min(loss, key=loss.get))
    return [(float(v), r) for v, r in zip(w, rules, strict=True) if abs(v) > 1e-4], float(b)


def compile_rules(rules: list[tuple[float, tuple]], offset: float, stats: str) -> Column:
    """The probability that the weighted rules give, as a column expression over the statistics."""
    terms = F.lit(offset)
    for weight, rule in rules:
        fits = F.lit(True)
        for j, t, at_most in rule:
            c = F.col(f"{stats}.{STATISTICS[j]}")
            fits = fits & ((c <= t) if at_most else (c > t))
        terms = terms + F.when(fits, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-terms))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Scores every row's whole text: adds held_out, score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Learns from labelled rows that are not held out, of which at most about SAMPLE_ROWS are taken by a hash of
    their ids; an id labelled both ways counts by its mean label, null labels not at all. Inputs are STATISTICS of
    the text only. Null and empty texts are scored as texts of no bytes. Without usable labels every score is the
    offset's. Columns of the added names are replaced; repeated rows get equal scores.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.avg(label).alias("y"))
    n = known.count()
    chosen = known.where(F.shiftrightunsigned(F.xxhash64(F.lit(3), F.col("k").cast("string")), 33) < F.lit(int((1 << 31) * min(1.0, SAMPLE_ROWS / max(n, 1)))))
    sample = docs.select(F.col(key).alias("k"), text).join(F.broadcast(chosen), "k")
    sample, stats = with_statistics(sample, text)
    # Of several texts of one id the least statistics count, so that refits agree.
    rows = sample.select("y", "k", stats).groupBy("k").agg(F.min("y").alias("y"), F.min(stats).alias(stats)).select("y", "k", f"{stats}.*").toPandas().sort_values("k")  # at most about SAMPLE_ROWS rows of numbers
    rules, offset = fit_rules(rows[list(STATISTICS)].to_numpy(dtype=float), (rows["y"].to_numpy() >= 0.5).astype(float))
    out, stats = with_statistics(docs, text)
    out = out.withColumn("score", compile_rules(rules, offset, stats)).drop(stats)
    return out.withColumns({"held_out": held_out(F.col(key)), "predicted": (F.col("score") >= threshold).cast("int")})
