"""Deterministic samples, folds and orders: a hash of seed and id takes the place of a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import sums_before


def shuffled(key: str, seed: str = "42") -> Column:
    """A sort key that shuffles by id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def unit(key: str, seed: str = "42") -> Column:
    """A number in [0, 1) by id: the first 32 bits of the shuffling hash."""
    return F.conv(F.substring(shuffled(key, seed), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_ranked(df: DataFrame, by: list[str], order: Column, key: str, digits: int = 3) -> DataFrame:
    """df with nth: the rank (from 1) within ``by`` in the order of a hash in hexadecimal, then key. Ranks are counted in parts by the
    hash's first digits, so that a value with a third of all rows is not one task's."""
    part = df.withColumns({"hash_": order, "part_": F.substring(order, 1, digits)})
    counts = part.groupBy(*by, "part_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before_", before).drop("n_")
    own = F.row_number().over(Window.partitionBy(*by, "part_").orderBy("hash_", key))
    inside = part.withColumn("own_", own)
    on = [inside[b].eqNullSafe(counts[b]) for b in by] + [inside["part_"] == counts["part_"]]
    return inside.join(counts, on).select(*(inside[c] for c in df.columns), (F.col("before_") + F.col("own_")).alias("nth"))


def folds(df: DataFrame, k: int, key: str = "doc_id", label: str = "doc_label", seed: str = "42") -> DataFrame:
    """Rows dealt to k folds in turn within each label, in shuffled order; a null label is a stratum. Ranks are counted in parts of the
    hash, so that a label with most rows is not one task's."""
    ranked = hash_ranked(df, [label], shuffled(key, seed), key)
    return ranked.withColumn("fold", F.pmod(F.col("nth") - 1, F.lit(k)).cast("int")).drop("nth")


def hash_sample(df: DataFrame, share: float, keep: Column, key: str = "doc_id", seed: str = "42") -> DataFrame:
    """Rows with ``keep``, and about ``share`` of the others."""
    return df.where(keep | (unit(key, seed) < share))


def per_key_quota(df: DataFrame, by: str, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each value of ``by``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def interleave(df: DataFrame, by: str, order: list[Column], strata: list[str]) -> DataFrame:
    """First rows of each stratum, then second ones, and so on: adds position, from 1. order: ascending columns, unique within a stratum;
    ranks are counted in ranges of them, so that no task has a whole stratum."""
    nth = F.array_position(F.array(*(F.lit(s) for s in strata)), F.col(by))
    at, before = "_at", "_before"
    ranked = sums_before(df.where(F.col(by).isin(*strata)).withColumn(at, F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))), [by], at, {before: F.lit(1)})
    out = ranked.withColumns({"turn": F.col(before) + 1, "nth": nth}).drop(at, before)
    # In turn t a row stands behind all rows of lesser turns: that many can be counted from the strata's sizes.
    sizes = df.where(F.col(by).isin(*strata)).groupBy(by).agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("other", F.array_position(F.array(*(F.lit(s) for s in strata)), F.col(by))).groupBy(F.lit(1).alias("one")).agg(F.collect_list(F.struct("other", "size")).alias("sizes"))
    before = F.aggregate("sizes", F.lit(0).cast("long"), lambda acc, x: acc + F.least(x["size"], F.col("turn") - 1 + (x["other"] < F.col("nth")).cast("long")))
    return out.join(F.broadcast(sizes)).withColumn("position", before + 1).drop("sizes", "one", "nth")


def quota_sample(df: DataFrame, quotas: dict[str, int], target: int, stratum: str, order: list[Column], key: str = "doc_id") -> DataFrame:
    """The first rows of each stratum up to its quota, then the first of the rest until ``target`` rows; each row once."""
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col(stratum)), F.lit(0))
    # A rank beyond the largest quota matters to nobody: it is cut in every task, before the strata meet.
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_rank") <= max(quotas.values(), default=0))
    picked = ranked.where(F.col("_rank") <= limit).drop("_rank").withColumn("how", F.lit("quota"))
    taken = sum(min(q, r["n"]) for r in df.groupBy(stratum).agg(F.count("*").alias("n")).where(F.col(stratum).isin(*quotas)).collect() for q in [quotas[r[stratum]]])
    # Of the first ``target`` rows of all at most as many as were taken are gone.
    rest = df.orderBy(*order).limit(target).join(picked.select(key), key, "left_anti").orderBy(*order).limit(max(0, target - taken))
    return picked.unionByName(rest.withColumn("how", F.lit("fill")))


def split_search(groups: DataFrame, seeds: int, share: float, group: str = "grp", label: str = "doc_label") -> DataFrame:
    """Of ``seeds`` random splits of whole groups the one with the least objective: the label shares' distance between the sides plus half
    of how far the side's size is from ``share``.

    groups: one row per (group, label) with n. A seed's side holds the groups whose hash is below ``share``.
    """
    trial = groups.withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seeds - 1).cast("long"))))  # summed up in the task that makes them
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col(group).cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    side = trial.withColumn("inside", u < share).groupBy("seed", label).agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("b"))
    total = side.groupBy("seed").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    gap = F.abs(F.col("a") / F.greatest("ta", F.lit(1)) - F.col("b") / F.greatest("tb", F.lit(1)))
    scored = side.join(total, "seed").groupBy("seed", "ta", "tb").agg(F.sum(gap).alias("l1"))
    out = scored.withColumn("objective", F.round(F.col("l1") + 0.5 * F.abs(F.col("ta") / (F.col("ta") + F.col("tb")) - share), 6))
    return out.orderBy("objective", "seed").limit(1).select("seed", F.col("ta").alias("n_in"), F.col("tb").alias("n_out"), "objective")


def bootstrap_mean(df: DataFrame, value: str, by: str, replicates: int, seed: str = "42") -> DataFrame:
    """Mean and 95 % interval by group: each replicate weighs every row by a Poisson(1) number drawn from a hash of replicate and row id.

    df: by, id, value. Poisson weights need no row numbers, so replicates are sums over the rows where they are.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = sum((F.when(F.col("u") >= s, 1).otherwise(0) for s in steps[1:]), F.when(F.col("u") >= steps[0], 1).otherwise(0))
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("u", u).withColumn("w", weight)
    means = reps.groupBy(by, "rep").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    mean = df.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n"))
    ci = means.groupBy(by).agg(F.round(F.percentile("m", F.lit(0.025)) + 1e-7, 4).alias("low"), F.round(F.percentile("m", F.lit(0.975)) + 1e-7, 4).alias("high"))
    return mean.join(ci, by)
