"""Priors, conflicts, boundary words and policies of labels as lines of text, for prompts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import LABELS


def _number(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def priors_lines(priors: DataFrame) -> DataFrame:
    """line for each label of priors (label, mu, sigma, alpha, beta, q90): its typical and its usual greatest length, and where it tends to start."""
    alpha, beta = F.col("alpha"), F.col("beta")
    mode = F.when((alpha > 1) & (beta > 1), (alpha - 1) / (alpha + beta - 2)).otherwise(alpha / (alpha + beta))
    where = F.when(mode < 1 / 3, "early").when(mode < 2 / 3, "in the middle").otherwise("late")
    line = F.concat("label", F.lit(": about "), F.round(F.exp("mu"), 0).cast("int").cast("string"), F.lit(" characters, at most "), F.col("q90").cast("string"), F.lit(" as a rule; starts "), where)
    return priors.select("label", line.alias("line"))


def conflict_lines(pairs: DataFrame, n: int = 4) -> DataFrame:
    """rank and line for the n pairs of labels (pair, n, mean_iou, iou_50) that overlap most, by mean IoU, then name."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_iou"), "pair")  # a row for each pair of labels
    line = F.concat("pair", F.lit(": mean overlap "), _number(F.col("mean_iou"), 2), F.lit(", strong in "), _number(F.col("iou_50") * 100, 0), F.lit("% of "), F.col("n").cast("string"))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("rank", line.alias("line"))


def cue_lines(boundary: DataFrame, kinds: tuple[str, ...] = ("word_before", "word_after"), n: int = 2) -> DataFrame:
    """line for each label: the n words that stand most often before and behind its spans (rows label, kind, value, rank)."""
    top = boundary.where(F.col("kind").isin(*kinds) & (F.col("rank") <= n))
    each = top.groupBy("label", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), ", ").alias("words"))
    place = F.array_position(F.array(*(F.lit(k) for k in kinds)), F.col("kind"))
    parts = F.array_sort(F.collect_list(F.struct(place.alias("at"), F.concat(F.replace("kind", F.lit("_"), F.lit(" ")), F.lit(": "), "words").alias("part"))))
    return each.groupBy("label").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "; ").alias("said")).select("label", F.concat("label", F.lit(" - "), "said").alias("line"))


def top_terms(effects: DataFrame, k: int = 5, term: str = "term", effect: str = "effect") -> DataFrame:
    """The k terms with the largest effects in either direction, of equals the lesser term: term, effect, rank."""
    first = effects.select(term, effect).orderBy(F.desc(F.abs(effect)), term).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs(effect)), term)))  # k rows


def policy(priors: DataFrame, pairs: DataFrame, boundary: DataFrame) -> DataFrame:
    """All lines as one table: section, nth and line, labels in their own order."""
    place = lambda df: F.array_position(F.array(*(F.lit(x) for x in LABELS)), df["label"]).cast("int")
    a, c = priors_lines(priors), cue_lines(boundary)
    rows = [a.select(F.lit("priors").alias("section"), place(a).alias("nth"), "line"), conflict_lines(pairs).select(F.lit("conflicts").alias("section"), F.col("rank").alias("nth"), "line"), c.select(F.lit("cues").alias("section"), place(c).alias("nth"), "line")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
