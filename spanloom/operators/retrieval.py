"""Vector search: exact filtered nearest neighbours, two-stage ranking, and selection for diversity."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import staging
from .staging import small_batches, staged, table_bytes


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for vectors of (almost) no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 1e-10, dot(a, b) / n).otherwise(F.lit(0.0))


#: Queries that a task compares at a time, and rows of one block of a join of blocks.
BLOCK_QUERIES, BLOCK_ROWS = 4096, 32768
#: Similarities that a task holds at a time; sorting takes a few times their bytes.
CELLS = 1 << 20


class _Nearest:
    """The best k of what was scored so far for each query and group of rows: of bounded size, however many rows come."""

    def __init__(self, k: int, block: int, ids: np.ndarray, vectors: list, tags: list | None):
        self.k, self.block, self.ids, self.tags = k, block, ids, None if tags is None else np.array(tags, dtype=object)
        m = np.array([np.asarray(v, dtype=np.float64) for v in vectors]).reshape(len(ids), -1 if len(ids) else 1)
        self.unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10)
        self.best: dict = {}

    def add(self, keys: np.ndarray, vectors: list, tags: np.ndarray | None, groups: np.ndarray | None) -> None:
        if not len(keys) or not len(self.ids):
            return
        order = np.argsort(keys, kind="stable")
        m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])[order]
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10)
        keys, names = keys[order], [None] * len(order) if groups is None else groups[order]
        for group in dict.fromkeys(names):
            own = np.arange(len(keys)) if groups is None else np.flatnonzero(names == group)
            for lo in range(0, len(self.ids), self.block):
                here = slice(lo, lo + self.block)
                most = max(1, CELLS // len(self.unit[here]))
                for at in range(0, len(own), most):
                    some = own[at : at + most]
                    sims = np.round(self.unit[here] @ m[some].T, 6)
                    if self.tags is not None:
                        sims = np.where(self.tags[here, None] == tags[order][some][None, :], sims, -2.0)
                    top = np.argsort(-sims, axis=1, kind="stable")[:, : self.k]  # rows stand by key: of equals the lesser comes first
                    found = np.take_along_axis(sims, top, 1), keys[some][top]
                    if (old := self.best.get((group, lo))) is not None:
                        sim, key = (np.concatenate(x, axis=1) for x in zip(old, found, strict=True))
                        top = np.lexsort((key, -sim), axis=1)[:, : self.k]
                        found = np.take_along_axis(sim, top, 1), np.take_along_axis(key, top, 1)
                    self.best[group, lo] = found

    def frames(self, key: str, by: str | None):
        for (group, lo), (sim, found) in self.best.items():
            q = np.repeat(np.arange(lo, lo + len(sim)), sim.shape[1])
            ok = sim.ravel() > -2
            out = pd.DataFrame({"query": self.ids[q][ok], key: found.ravel()[ok], "sim": sim.ravel()[ok]})
            yield out.assign(**{by: group}) if by else out


def knn(vectors: DataFrame, queries: DataFrame, k: int, tag: str | None = None, key: str = "vec_id", vector: str = "embedding", by: str | None = None, block: int | None = None) -> DataFrame:
    """For each query the k rows with the highest cosine similarity (of equals the lesser key): query, key, sim, rank. With tag, only rows
    whose tag equals the query's; with ``by``, k rows of each value of that column of the rows (a string), which is returned, too.

    Queries whose measured bytes fit go to every task, which keeps the best k for each while it reads its rows once. More queries are dealt
    to blocks by a hash, and so are the rows: each pair of blocks meets in a task that keeps as little. What tasks keep meets by query. Rows
    and queries without a vector match nothing. Similarities are rounded to 6 digits. A task compares ``block`` queries at a time.
    """
    block = block or BLOCK_QUERIES
    small_batches(vectors.sparkSession)
    also = [c for c in (tag, by) if c]
    src = vectors.where(F.col(vector).isNotNull()).select(key, vector, *also)
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("vector_"), *([F.col(tag).alias("tag_")] if tag else []))
    kind = f"query long, {key} long, sim double" + (f", {by} string" if by else "")
    column = lambda pdf, c: pdf[c].to_numpy(dtype=object) if c else None
    if table_bytes(asked) <= staging.BROADCAST_BYTES:
        rows = asked.orderBy("query").collect()
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r.query for r in rows], dtype=np.int64), [np.array(r.vector_, dtype=np.float64) for r in rows], [r.tag_ for r in rows] if tag else None))

        def score(batches):
            best = _Nearest(k, block, *shared.value)
            for pdf in batches:
                best.add(pdf[key].to_numpy(), pdf[vector].to_list(), column(pdf, tag), column(pdf, by))
            yield from best.frames(key, by)

        found = src.mapInPandas(score, kind)
    else:
        n_queries, n_rows = asked.count(), src.count()
        left, right = (max(1, -(-n // most)) for n, most in ((n_queries, 4 * block), (n_rows, BLOCK_ROWS)))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        blocks = asked.withColumn("q_", part("query", left)).withColumn("r_", every(right)), src.withColumn("r_", part(key, right)).withColumn("q_", every(left))

        def meet(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            best = _Nearest(k, block, own["query"].to_numpy(dtype=np.int64), own["vector_"].to_list(), own["tag_"].to_list() if tag else None)
            for lo in range(0, len(rows), block):
                pdf = rows.iloc[lo : lo + block]
                best.add(pdf[key].to_numpy(), pdf[vector].to_list(), column(pdf, tag), column(pdf, by))
            empty = pd.DataFrame({c.split()[0]: [] for c in kind.split(", ")})
            return pd.concat([*best.frames(key, by)] or [empty])

        found = blocks[0].groupBy("q_", "r_").cogroup(blocks[1].groupBy("q_", "r_")).applyInPandas(meet, kind)
    w = Window.partitionBy("query", *([by] if by else [])).orderBy(F.desc("sim"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def minmax(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """value scaled to [0, 1] as ``norm``: .5 if all are equal, 1 if there is one. Bounds are aggregated first."""
    keys = [by] if by else []
    b = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    j = df.join(b, keys) if keys else df.join(F.broadcast(b))  # one row without keys
    norm = F.when(F.col("_n") == 1, 1.0).when(F.col("_hi") == F.col("_lo"), 0.5).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return j.withColumn("norm", F.round(norm, 6)).drop("_lo", "_hi", "_n")


def two_stage(vectors: DataFrame, queries: DataFrame, k: int, factor: int, second: Column, most: int = 50, key: str = "vec_id") -> DataFrame:
    """For each query k·factor (at most ``most``) nearest, then the k best of them by a second score over sim and the row's columns."""
    first = knn(vectors, queries, min(most, k * factor), key=key).drop("rank")
    scored = first.join(vectors, key).withColumn("second", F.round(second, 6))
    w = Window.partitionBy("query").orderBy(F.desc("second"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", key, "sim", "second", "rank")


def mmr(candidates: DataFrame, k: int, weight: float = 0.6, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Of each query's candidates (a retrieval's result with vectors) picks k in turn: the highest weight·sim − (1−weight)·greatest
    similarity to those picked; of equals the lesser key. Returns query, key, place and sim."""
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        v = np.array(pdf[vector].to_list(), dtype=float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-10)
        rel, near, left, order = pdf["sim"].to_numpy(float), np.zeros(len(pdf)), np.ones(len(pdf), bool), []
        for _ in range(min(k, len(pdf))):
            value = np.where(left, np.round(weight * rel - (1 - weight) * near, 9), -np.inf)
            i = int(value.argmax())
            order.append(i)
            left[i] = False
            near = v @ v[i] if len(order) == 1 else np.maximum(near, v @ v[i])
        return pd.DataFrame({"query": pdf["query"].iloc[order].to_numpy(), key: pdf[key].iloc[order].to_numpy(), "place": np.arange(1, len(order) + 1), "sim": rel[order]})

    return candidates.groupBy("query").applyInPandas(pick, f"query long, {key} long, place long, sim double")


def _mmr_order(vectors: np.ndarray, relevance: np.ndarray, k: int, weight: float, first: float) -> tuple[list[int], list[float]]:
    """Indices in the order of greatest weight·relevance − (1−weight)·similarity to those picked (``first`` before any is), and these
    values; of equals the earlier."""
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-10)
    near, left, order, values = np.full(len(v), first), np.ones(len(v), bool), [], []
    for _ in range(min(k, len(v))):
        value = np.where(left, np.round(weight * relevance - (1 - weight) * near, 9), -np.inf)
        i = int(value.argmax())
        order.append(i)
        values.append(float(value[i]))
        left[i] = False
        near = np.maximum(near, v @ v[i]) if len(order) > 1 or first == -1.0 else v @ v[i]
    return order, values


def mmr_centroid(candidates: DataFrame, k: int, weight: float = 0.6, by: str = "query", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Of each group's candidates picks k that are near the mean of all their directions and far from each other; all in key order if there
    are no more than k. Returns by, key, place.

    A group is one query's candidates, and thus of bounded size.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        order = list(range(len(pdf)))
        if k < len(pdf):
            v = np.array(pdf[vector].to_list(), dtype=float)
            v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-10
            mean = v.mean(axis=0)
            order, _ = _mmr_order(v, v @ mean / max(float(np.linalg.norm(mean)), 1e-10), k, weight, -1.0)
        return pd.DataFrame({by: pdf[by].iloc[order].to_numpy(), key: pdf[key].iloc[order].to_numpy(), "place": np.arange(1, len(order) + 1)})

    return candidates.groupBy(by).applyInPandas(pick, f"{by} long, {key} long, place long")


def mmr_strata(rows: DataFrame, quotas: dict[str, int], by: str, weight: float = 0.6, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """What mmr_centroid picks, of strata of any size: of each value of ``by`` in quotas as many rows as it says. Returns by, key and place.

    A round picks one row of each stratum: every task scores its rows against the picks so far and keeps its best, and these meet as one row
    a task and stratum. Only picks, as many as the quotas, come to the driver. Rows without a vector are left out; a stratum of no more than its quota
    gives all, in key order.
    """
    small_batches(rows.sparkSession)
    src = staged(rows.where(F.col(vector).isNotNull() & F.col(by).isin(*quotas)).select(F.col(by).alias("by_"), F.col(key).alias("key_"), F.col(vector).cast("array<double>").alias("v_")), "strata")
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-10)
    kind = dict(src.dtypes)["key_"]

    def sums(batches):
        for pdf in batches:
            for b, g in pdf.groupby("by_"):
                m = unit(np.array(g["v_"].to_list(), dtype=float))
                yield pd.DataFrame({"by_": b, "n": len(m), "at": np.arange(m.shape[1]), "x": m.sum(axis=0)})

    mean: dict[str, dict[int, float]] = {}
    sizes: dict[str, int] = {}
    for r in src.mapInPandas(sums, "by_ string, n long, at long, x double").groupBy("by_", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        mean.setdefault(r.by_, {})[r.at] = r.x / r.n
        sizes[r.by_] = r.n
    centre = {b: (lambda v: v / max(float(np.linalg.norm(v)), 1e-10))(np.array([x[i] for i in range(len(x))])) for b, x in mean.items()}
    whole = [b for b, n in sizes.items() if n <= quotas[b]]
    picked: dict[str, list] = {b: [] for b in sizes if b not in whole}
    taken: dict[str, list[np.ndarray]] = {b: [] for b in picked}
    while any(len(p) < quotas[b] for b, p in picked.items()):
        open_ = {b: (set(picked[b]), np.array(taken[b])) for b in picked if len(picked[b]) < quotas[b]}

        def best(batches, open_=open_):
            top: dict = {}
            for pdf in batches:
                for b, g in pdf[pdf["by_"].isin(open_)].groupby("by_"):
                    done, near = open_[b]
                    g = g[~g["key_"].isin(done)]
                    if not len(g):
                        continue
                    m = unit(np.array(g["v_"].to_list(), dtype=float))
                    like = (m @ near.T).max(axis=1) if len(near) else np.full(len(m), -1.0)
                    value = np.round(weight * (m @ centre[b]) - (1 - weight) * like, 9)
                    i = np.lexsort((g["key_"].to_numpy(), -value))[0]
                    found = (-value[i], g["key_"].iloc[i], m[i].tolist())
                    top[b] = min(top.get(b, found), found, key=lambda f: f[:2])
            if top:
                yield pd.DataFrame([(b, *f) for b, f in top.items()], columns=["by_", "less", "key_", "v_"])

        rows_ = src.mapInPandas(best, f"by_ string, less double, key_ {kind}, v_ array<double>").groupBy("by_").agg(F.min(F.struct("less", "key_", "v_")).alias("b")).collect()
        for r in rows_:
            picked[r.by_].append(r.b.key_)
            taken[r.by_].append(np.array(r.b.v_))
    all_of = src.where(F.col("by_").isin(*whole)).select("by_", "key_", F.row_number().over(Window.partitionBy("by_").orderBy("key_")).alias("place")) if whole else None
    found = rows.sparkSession.createDataFrame([(b, x, i + 1) for b, p in picked.items() for i, x in enumerate(p)], f"by_ string, key_ {kind}, place int")
    out = found if all_of is None else found.unionByName(all_of)
    return out.toDF(by, key, "place")


def mmr_quality(candidates: DataFrame, k: int, score: str = "score", weight: float = 0.5, by: str = "query", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Of each group's candidates picks k by a score, brought to 0 to 1 within the group (1 if all are equal), and distance to those picked;
    the first has the best score. All in key order if there are no more than k. Returns by, key, place."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        order = list(range(len(pdf)))
        if k < len(pdf):
            q = pdf[score].to_numpy(float)
            q = (q - q.min()) / (q.max() - q.min()) if q.max() > q.min() else np.ones(len(q))
            order, _ = _mmr_order(np.array(pdf[vector].to_list(), dtype=float), q, k, weight, 0.0)
        return pd.DataFrame({by: pdf[by].iloc[order].to_numpy(), key: pdf[key].iloc[order].to_numpy(), "place": np.arange(1, len(order) + 1)})

    return candidates.groupBy(by).applyInPandas(pick, f"{by} long, {key} long, place long")


def hard_negatives(vectors: DataFrame, queries: DataFrame, flag: Column, k: int, factor: int, second: Column, most: int = 50, key: str = "vec_id") -> DataFrame:
    """two_stage() among the rows that ``flag`` marks as hard negatives."""
    return two_stage(vectors.where(flag), queries, k, factor, second, most, key)


def stratified(vectors: DataFrame, queries: DataFrame, strata: dict[str, tuple[Column, int]], k: int, key: str = "vec_id") -> DataFrame:
    """For each query the nearest rows of each stratum up to its number, first ones first, cut at k: query, key, sim, stratum, turn, place."""
    parts = [knn(vectors.where(where), queries, n, key=key).select("query", key, "sim", F.lit(name).alias("stratum"), F.lit(i).alias("nth"), F.col("rank").alias("turn")) for i, (name, (where, n)) in enumerate(strata.items())]
    place = F.row_number().over(Window.partitionBy("query").orderBy("turn", "nth"))
    return reduce(DataFrame.unionByName, parts).withColumn("place", place).where(F.col("place") <= k).drop("nth")


def balanced(vectors: DataFrame, queries: DataFrame, k: int, positive: str, negative: str, unclear: tuple[str, ...], evidence: Column, second: Column, factor: int = 3, most: int = 50, key: str = "vec_id", label: str = "label") -> DataFrame:
    """For each query k rows of balanced labels: query, key, sim, side and place.

    A fifth (one at least) are of the first of the ``unclear`` labels that has any, the others half positive and half negative; where no
    unclear ones are, their share goes to the negative. Each stratum gives its nearest rows, ``factor`` times its share but at most
    ``most``, and of these the best by the second score (by nearness, if there are no more than its share). The nearest row with evidence
    joins its side (positive, or else negative) if it is not there yet. Positive and negative take turns, what is left over follows, the
    unclear ones come in behind the second, and k rows stay.

    One pass scores all strata; what remains for a query is a few dozen rows.
    """
    n_unclear = max(1, k // 5)
    shares = {"positive": (k - n_unclear) // 2, "negative": (k - n_unclear) - (k - n_unclear) // 2, "evidence": 1} | {f"unclear{i}": n_unclear for i in range(len(unclear))}
    of = F.when(F.col(label) == positive, "positive").when(F.col(label) == negative, "negative")
    for i, name in enumerate(unclear):
        of = of.when(F.col(label) == name, f"unclear{i}")
    strata = F.array_compact(F.array(of, F.when(evidence, "evidence")))
    rows = vectors.select(*vectors.columns, F.explode(strata).alias("stratum_"))
    widest = max(min(most, s * factor) for s in shares.values())
    # One side's rank is cut at its own number of candidates; the widest serves all.
    near = knn(rows, queries, widest, key=key, by="stratum_").join(vectors.drop("embedding"), key)
    least = F.element_at(F.create_map(*(F.lit(x) for kv in shares.items() for x in kv)), F.col("stratum_"))
    width = F.when(F.col("stratum_") == "evidence", 1).otherwise(F.least(F.lit(most), least * factor))
    own, whole = Window.partitionBy("query", "stratum_"), Window.partitionBy("query")
    near = near.where(F.col("rank") <= width).withColumn("n_", F.count("*").over(own)).withColumn("second_", F.round(second, 6))
    few = F.col("n_") <= least
    near = near.withColumn("turn_", F.row_number().over(own.orderBy(F.when(few, F.col("rank")), F.desc("second_"), key)))
    first = F.min(F.when(F.col("stratum_").startswith("unclear"), F.col("stratum_"))).over(whole)
    near = near.withColumn("first_", first)
    room = F.when(F.col("stratum_") == "negative", least + F.when(F.col("first_").isNull(), n_unclear).otherwise(0)).when(F.col("stratum_").startswith("unclear") & (F.col("stratum_") != F.col("first_")), 0).otherwise(least)
    kept = near.where(F.col("turn_") <= room)
    kept = kept.withColumn("met_", F.count("*").over(Window.partitionBy("query", key))).where("stratum_ <> 'evidence' or met_ = 1")
    side = F.when(F.col("stratum_").startswith("unclear"), "unclear").when(F.col("stratum_") == "evidence", F.when(F.col(label) == positive, "positive").otherwise("negative")).otherwise(F.col("stratum_"))
    kept = kept.withColumn("side", side)
    kept = kept.withColumn("i_", F.row_number().over(Window.partitionBy("query", "side").orderBy(F.col("stratum_") == "evidence", "turn_")))
    count = lambda name: F.count_if(F.col("side") == name).over(whole)
    kept = kept.withColumns({"p_": count("positive"), "m_": count("negative"), "u_": count("unclear")})
    both, i = F.least("p_", "m_"), F.col("i_")
    turns = F.when(i > both, both + i).otherwise(2 * i - F.when(F.col("side") == "positive", 1).otherwise(0))
    behind = F.least(F.col("p_") + F.col("m_"), F.lit(2))
    place = F.when(F.col("side") == "unclear", behind + i).otherwise(turns + F.when(turns > behind, F.col("u_")).otherwise(0))
    return kept.withColumn("place", place.cast("int")).where(F.col("place") <= k).select("query", key, "sim", "side", "place")


def attach_most(df: DataFrame, by: str, n: int, order: list[Column]) -> DataFrame:
    """At most the first n rows of each value of ``by``, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def embed(docs: DataFrame, embedder, size: int, batch: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Vectors of texts by a function from a list of texts to a list of vectors, in batches; where it fails texts are tried alone, and those
    that fail again get zeros."""
    def run(batches):
        for pdf in batches:
            out: list = []
            texts = pdf[text].fillna("").to_list()
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    out += embedder(part)
                except Exception:  # noqa: BLE001  an embedder may fail in any way
                    for t in part:
                        try:
                            out += embedder([t])
                        except Exception:  # noqa: BLE001
                            out.append([0.0] * size)
            yield pd.DataFrame({key: pdf[key], "embedding": [list(map(float, v)) for v in out]})

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>")
