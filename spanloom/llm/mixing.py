"""Mixing sources to target weights by fitting each source's budget as a bounded subset sum over document lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, small, staged, unstage

#: Up to so many sources their targets are computed on the driver, beyond in aggregates over a table of them.
DRIVER_SOURCES = 100_000
#: The dynamic programme covers sums in a range of so many words.
PROGRAMME_WORDS = 1 << 20
#: Documents of one source and length are ranked in parts of about so many.
PART_ROWS = 128
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Splits budget by weight; what exceeds ``most`` times a source's size is split again among the others until none exceeds it."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(budget)
    while open_:
        unit = left / w if (w := sum(weights[i] for i in open_)) > 0 else 0.0
        full = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        open_ = [i for i in open_ if i not in set(full)]
    return out


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length to take so that their words come as near ``budget`` as can be (the lesser sum of two as near).

    A bounded-knapsack programme over all sums decides where all documents have at most PROGRAMME_WORDS. Beyond, an
    even share of each length is taken first, and the programme then adds and gives back documents, over sums
    within PROGRAMME_WORDS / 2 of the budget. It ends as soon as it meets the whole number next to the budget that
    the lengths' common divisor allows, than which none is nearer.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    budget = min(float(budget), float(total))
    if not total or budget <= 0:
        return take
    order = [int(i) for i in np.argsort(-lengths, kind="stable") if lengths[i] > 0 and counts[i] > 0]
    low, high = 0, total
    if total > PROGRAMME_WORDS:
        low, high = -(PROGRAMME_WORDS // 2), PROGRAMME_WORDS // 2
        take = np.floor(counts * (budget / total)).astype(np.int64)
        for i in order:  # a remainder beyond the range is cut down by the longest documents
            left = budget - int((lengths * take).sum())
            if abs(left) <= PROGRAMME_WORDS / 4:
                break
            k = int(abs(left) // lengths[i])
            take[i] += min(k, int(counts[i] - take[i])) if left > 0 else -min(k, int(take[i]))
    left = budget - int((lengths * take).sum())
    step = int(np.gcd.reduce(lengths[order]))
    below = int(left // step) * step
    goal = below if left - below <= below + step - left else below + step  # no sum is nearer
    seen = np.zeros(high - low + 1, dtype=bool)
    by = np.full(high - low + 1, -1, dtype=np.int32)  # the item that first reached a sum
    seen[-low] = True
    items: list[tuple[int, int, int]] = []
    for sign in (1, -1) if low else (1,):
        for i in order:
            n, power = int(counts[i] - take[i]) if sign > 0 else int(take[i]), 1
            n = min(n, (high - low) // int(lengths[i]))
            while n > 0 and not (low <= goal <= high and seen[goal - low]):
                k = min(power, n)
                w = k * int(lengths[i])
                if w < len(seen):
                    there, here = (seen[w:], seen[:-w]) if sign > 0 else (seen[:-w], seen[w:])
                    new = here & ~there
                    (by[w:] if sign > 0 else by[:-w])[new] = len(items)
                    there |= new
                items.append((i, sign * k, sign * w))
                n, power = n - k, power * 2
    sums = np.flatnonzero(seen) + low
    best = int(sums[np.argmin(np.abs(sums - left))])
    while best:
        i, k, w = items[by[best - low]]
        take[i] += k
        best -= w
    return take


def _plan(lengths: DataFrame, src: str, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """Columns src, source_size and target, a row per source; see targets()."""
    per = staged(lengths.groupBy(src).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    spark, n = lengths.sparkSession, per.count()
    if n <= DRIVER_SOURCES:
        rows = sorted(per.collect(), key=lambda r: r[0].encode())
        sizes = [int(r[1]) for r in rows]
        aims = targets(sizes, [float(weights[i % len(weights)]) for i in range(n)], share * sum(sizes), most)
        return spark.createDataFrame([(r[0], s, float(t)) for r, s, t in zip(rows, sizes, aims, strict=True)], f"`{src}` string, source_size long, target double")
    # The number of each source in order: of its range's first one, and within the range.
    sorted_ = staged(per.repartitionByRange(max(1, n // DRIVER_SOURCES), src).sortWithinPartitions(src).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("at", 33)
    counts = {r[0]: r[1] for r in sorted_.groupBy(part.alias("part")).count().collect()}  # a row for each range
    first = dict(zip(sorted(counts), np.cumsum([0, *(counts[p] for p in sorted(counts))]).tolist(), strict=False))
    table = spark.createDataFrame(list(first.items()), "part long, first long")
    number = F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (number % len(weights) + 1).cast("int"))
    every = staged(sorted_.withColumn("part", part).join(F.broadcast(table), "part").select(src, "source_size", weight.alias("weight")), "weighed")
    unstage(sorted_)
    # A source is full from some unit on for good, as the others' unit only grows.
    unit, budget = -1.0, share * every.agg(F.sum("source_size")).first()[0]
    while True:
        full = F.col("weight") * unit > F.lit(most) * F.col("source_size")
        taken, left = every.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        again = (budget - most * taken) / left if left > 0 else 0.0
        if again <= unit or left <= 0:
            break
        unit = again
    return every.select(src, "source_size", F.when(full, F.lit(most) * F.col("source_size")).otherwise(F.col("weight") * max(unit, 0.0)).cast("double").alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Decides how often each document enters a mix whose sources have words in given proportions.

    A document's size is its number of runs without ASCII white space (null: 0). The sources, by code point with
    null last, take ``weights`` in turn and share ``share`` times all words; see targets(). Each source takes whole
    copies of all its documents as often as its target holds them, and fits the remaining budget by counting
    documents of each exact length (fit_counts); which documents of a length go is decided by a seeded hash of
    key and text, so reruns agree.

    Adds size, source_size, target, copies (0 to ``most``) and taken (copies times size) to every row; columns of
    these names are replaced. Documents without words have copies 0 unless whole copies are taken. Null sources
    are one source. Repeated rows count as documents each. An empty table stays empty.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    # Working columns have names that docs does not have.
    src, whole, extra, alike, rank, cut, places, same = fresh(docs, "src", "whole", "extra", "alike", "rank", "cut", "places", "same")
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(key).isNull(), F.col(text)), 1)
    out = docs.withColumns({"size": words, rank: spread, src: F.concat(F.when(F.col(source).isNull(), "1").otherwise("0"), F.coalesce(source, F.lit("")))})
    narrow = staged(out.select(src, "size", rank), "narrow")  # all that is decided on; texts are read once more, at the end
    lengths = staged(narrow.groupBy(src, "size").agg(F.count("*").alias("n")), "lengths")
    plan = _plan(lengths, src, weights, share, most)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        full = int(pdf["target"][0] // pdf["source_size"][0]) if pdf["source_size"][0] else 0
        full = min(full, most)
        some = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), pdf["target"][0] - full * pdf["source_size"][0]) if full < most else 0
        return pdf.assign(whole=full, extra=some)

    fitted = lengths.join(small(plan), src).groupBy(src).applyInPandas(fit, f"`{src}` string, size long, n long, source_size long, target double, whole int, extra long")
    fitted = staged(fitted.select(src, "size", "source_size", "target", F.col("whole").alias(whole), F.col("extra").alias(extra), F.col("n").alias(alike)), "fitted")
    # Where only some documents of a length go: the rank up to which they do, found in parts by the rank itself.
    some = narrow.join(small(fitted.where(F.col(extra).between(1, F.col(alike) - 1))), [src, "size"])
    parts = F.greatest(F.lit(1), F.ceil(F.col(alike) / F.greatest(F.lit(PART_ROWS), F.sqrt(F.col(alike)))))
    some = some.select(src, "size", rank, extra, F.floor(F.col(rank).cast("double") * parts / F.lit(float(1 << 63))).cast("long").alias("part"))
    counted = staged(some.groupBy(src, "size", "part", extra).agg(F.count("*").alias("inside")), "parts")
    before = F.coalesce(F.sum("inside").over(Window.partitionBy(src, "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = counted.withColumn("before", before).where((F.col("before") < F.col(extra)) & (F.col("before") + F.col("inside") >= F.col(extra)))
    edge = staged(edge.select(src, "size", "part", (F.col(extra) - F.col("before")).alias("wanted")), "edge")
    ranks = some.join(small(edge), [src, "size", "part"]).groupBy(src, "size", "wanted", rank).agg(F.count("*").alias(same))
    upto = F.sum(same).over(Window.partitionBy(src, "size").orderBy(rank))
    last = ranks.withColumn("upto", upto).where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col(same) < F.col("wanted")))
    last = staged(last.select(src, "size", F.col(rank).alias(cut), (F.col("wanted") - F.col("upto") + F.col(same)).alias(places), same), "cuts")
    torn = not last.where(F.col(places) < F.col(same)).isEmpty()  # rows of one rank are equal in key and text; only some of them go
    out = out.join(small(fitted), [src, "size"]).join(small(last), [src, "size"], "left")
    goes = F.when(F.col(extra) >= F.col(alike), 1).when(F.col(extra) < 1, 0).when(F.col(rank) < F.col(cut), 1).when((F.col(rank) == F.col(cut)) & (F.col(places) == F.col(same)), 1).otherwise(0)
    every = out.withColumn("copies", F.col(whole) + goes)
    if torn:
        split = F.coalesce((F.col(rank) == F.col(cut)) & (F.col(places) < F.col(same)), F.lit(False))
        told = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))  # reruns agree on rows that differ elsewhere
        nth = F.row_number().over(Window.partitionBy(src, "size").orderBy(rank, told))
        every = every.where(~split).unionByName(out.where(split).withColumn("copies", F.col(whole) + F.when(nth <= F.col(places), 1).otherwise(0)))
    unstage(lengths, narrow, counted, edge)
    return every.withColumns({"copies": F.col("copies").cast("int"), "taken": F.col("copies") * F.col("size")}).select(*docs.columns, "size", "source_size", "target", "copies", "taken")
