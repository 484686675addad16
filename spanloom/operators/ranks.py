"""Running sums in the order of a column, in ranges of it, so that no task has all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import staging
from .staging import staged, table_bytes


def sums_before(df: DataFrame, by: list[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """df with, for each name in sums, the sum of that column over the rows of equal ``by`` with a lesser ``order``, which is unique within ``by``.

    Rows go to tasks by ranges of ``order``. Each range's totals are added up (there are as many rows of them as ranges), and within a range
    a window does the rest.
    """
    part = "part_"
    fixed = staged(df.repartitionByRange(F.col(order)).withColumn(part, F.spark_partition_id()))
    totals = fixed.groupBy(*by, part).agg(*(F.sum(c).alias(f"{n}_t_") for n, c in sums.items()))
    ahead = Window.partitionBy(*(by or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, part, *(F.coalesce(F.sum(f"{n}_t_").over(ahead), F.lit(0)).alias(f"{n}_b_") for n in sums))
    inside = Window.partitionBy(*by, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = fixed.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{n}_i_") for n, c in sums.items()))
    on = [out[b].eqNullSafe(totals[b]) for b in by] + [out[part] == totals[part]]
    return out.join(totals, on).select(*(out[c] for c in df.columns), *((F.col(f"{n}_b_") + F.col(f"{n}_i_")).alias(n) for n in sums))


def value_counts(df: DataFrame, by: list[str], value: Column, **sums: Column) -> DataFrame:
    """A table of by, value, n (rows) and the given sums, for every value that is not null: what quantiles and means need, counted by task first."""
    rows = df.select(*by, value.alias("value"), *(c.alias(k) for k, c in sums.items())).where(F.col("value").isNotNull())
    return staged(rows.groupBy(*by, "value").agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in sums)), "counts")


def quantiles(counts: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """by, and for each name in shares that exact quantile, between the two values at its place: from the counts of ``value_counts``.

    A value covers the ranks from the number of lesser rows on; these are running sums of the counts, in ranges of values beyond what
    is measured to fit in a task. No group's values meet in one buffer.
    """
    if table_bytes(counts) <= staging.BROADCAST_BYTES:
        ahead = Window.partitionBy(*(by or [F.lit(0)])).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.withColumn("below", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    else:
        ranked = sums_before(counts, by, "value", {"below": F.col("n")})
    total = counts.groupBy(*by).agg(F.sum("n").alias("all_")).toDF(*(f"{b}_of_" for b in by), "all_")
    on = [ranked[b].eqNullSafe(total[f"{b}_of_"]) for b in by]
    ranked = ranked.join(total, on) if by else ranked.join(F.broadcast(total))  # one row without keys
    covers = lambda at: (F.col("below") <= at) & (at < F.col("below") + F.col("n"))
    found = []
    for k, p in shares.items():
        at = F.lit(float(p)) * (F.col("all_") - 1)
        found += [F.max(F.when(covers(F.floor(at)), F.col("value"))).alias(f"{k}_lo_"), F.max(F.when(covers(F.ceil(at)), F.col("value"))).alias(f"{k}_hi_"), F.max(at).alias(f"{k}_at_")]
    got = ranked.groupBy(*by).agg(*found) if by else ranked.agg(*found)
    part = lambda k: F.when(F.col(f"{k}_lo_") == F.col(f"{k}_hi_"), F.col(f"{k}_lo_").cast("double")).otherwise((F.ceil(f"{k}_at_") - F.col(f"{k}_at_")) * F.col(f"{k}_lo_") + (F.col(f"{k}_at_") - F.floor(f"{k}_at_")) * F.col(f"{k}_hi_"))
    return got.select(*by, *(part(k).alias(k) for k in shares))
