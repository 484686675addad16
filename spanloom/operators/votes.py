"""Aggregation of independent verdicts and the rules that damp, override or appeal them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def council(votes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per key over votes (juror, verdict yes/no, confidence): tally, mean confidences, signed sum, dissent and level of consensus
    (unanimous, strong from three alike on, else split; chaotic without votes)."""
    yes, no = F.col("verdict") == "yes", F.col("verdict") == "no"
    agg = votes.groupBy(key).agg(F.count_if(yes).alias("yes"), F.count_if(no).alias("no"), F.round(F.coalesce(F.avg(F.when(yes, F.col("confidence"))), F.lit(0.0)), 6).alias("yes_confidence"), F.round(F.coalesce(F.avg(F.when(no, F.col("confidence"))), F.lit(0.0)), 6).alias("no_confidence"),
                                 F.round(F.sum(F.when(yes, F.col("confidence")).otherwise(-F.col("confidence"))), 6).alias("signed"))
    total, least = F.col("yes") + F.col("no"), F.least("yes", "no")
    dissent = F.round(F.when(total > 0, least / total).otherwise(0.0), 6)
    level = F.when(total == 0, "chaotic").when(least == 0, "unanimous").when(F.greatest("yes", "no") >= 3, "strong").otherwise("split")
    return agg.withColumns({"dissent": dissent, "consensus": level})


def repeated_flags(votes: DataFrame, key: str = "doc_id", flags: str = "flags", least: int = 2) -> DataFrame:
    """Flags that at least so many jurors of a key raise."""
    return votes.select(key, F.explode(flags).alias("flag")).groupBy(key, "flag").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def damped(confidence: Column, consensus: Column, cap: float = 0.75) -> Column:
    """Confidence of at most ``cap`` where jurors are split."""
    return F.when(consensus.isin("split", "chaotic"), F.least(confidence, F.lit(cap))).otherwise(confidence)


def appeal(confidence: Column, consensus: Column, appealed: Column) -> Column:
    """Whether a verdict is tried again: once, if it is neither sure nor unanimous."""
    return (confidence <= 0.8) & (consensus != "unanimous") & ~appealed


def lite_rule(verdict: Column, confidence: Column, consensus: Column) -> Column:
    return F.when((consensus == "split") & (confidence < 0.65), "no").otherwise(verdict)


def override_flags(verdict: Column, majority: Column, confidence: Column) -> Column:
    return F.array_compact(F.array(F.when(verdict != majority, F.lit("override")), F.when(confidence.between(0.45, 0.55), F.lit("borderline"))))


def soft_gate(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys whose rejection is intercepted: an Actor and an Action, or three spans."""
    n = spans.groupBy(key).agg(F.count_if(F.col("label") == "Actor").alias("actors"), F.count_if(F.col("label") == "Action").alias("actions"), F.count("*").alias("n"))
    return n.withColumn("intercept", ((F.col("actors") >= 1) & (F.col("actions") >= 1)) | (F.col("n") >= 3))


def label_vote(votes: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("yes", "no")) -> DataFrame:
    """The commonest verdict; of equals the one with the longest rationale, then by ``order``."""
    place = F.array_position(F.array(*(F.lit(o) for o in order)), F.col("verdict"))
    n = votes.groupBy(key, "verdict").agg(F.count("*").alias("n"), F.max(F.length("rationale")).alias("longest"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), F.desc("longest"), place)
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, "verdict", "n")


def average_probability(samples: DataFrame, key: str = "doc_id") -> DataFrame:
    """Samples (p_yes, p_no, either may be null): the missing one is the complement, both are scaled to 1, then averaged."""
    yes = F.coalesce("p_yes", 1 - F.col("p_no"), F.lit(0.5))
    no = F.coalesce("p_no", 1 - F.col("p_yes"), F.lit(0.5))
    p = yes / F.when(yes + no > 0, yes + no).otherwise(1)
    return samples.groupBy(key).agg(F.round(F.avg(p), 6).alias("p_yes"), F.count("*").alias("n")).withColumn("verdict", F.when(F.col("p_yes") >= 0.5, "yes").otherwise("no"))


def usage(rows: DataFrame, rate_in: float = 1.75, rate_out: float = 14.0) -> DataFrame:
    """Sums of tokens and what they cost at rates per million."""
    s = rows.agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("*").alias("requests"))
    return s.withColumn("cost", F.round(F.col("tokens_in") / 1e6 * rate_in + F.col("tokens_out") / 1e6 * rate_out, 6))


def dossier(spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per key the different texts of each role, sorted: 'Role: a; b' lines in order of role."""
    per = spans.groupBy(key, "label").agg(F.array_join(F.array_sort(F.collect_set(text)), "; ").alias("texts"))
    return per.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "label", "texts"))), "\n").alias("dossier"))


def graded_score(votes: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """1 where the commonest verdict (of equals yes) is the gold one, else the share of votes for the gold one."""
    n = votes.groupBy(key).agg(F.count_if(F.col("verdict") == "yes").alias("yes"), F.count("*").alias("n")).join(gold.select(key, "gold"), key)
    for_gold = F.when(F.col("gold") == "yes", F.col("yes")).otherwise(F.col("n") - F.col("yes"))
    win = F.when(F.col("yes") * 2 >= F.col("n"), "yes").otherwise("no")
    return n.select(key, F.round(F.when(win == F.col("gold"), 1.0).otherwise(for_gold / F.col("n")), 6).alias("score"))


def judge_flags(verdict: Column, majority: Column, consensus: Column) -> tuple[Column, Column]:
    """Whether a judge's verdict is borderline (the council was split or had no votes), and whether it overrides the council: differs from
    its majority where it was not split."""
    return consensus.isin("split", "chaotic"), (verdict != majority) & (consensus != "split")


def appeal_diagnosis(verdict: Column, jaqing: Column, intensity: Column, shouting: Column, agency: Column) -> Column:
    """What an appeal is to look at, by the verdict and the text's profile: of a no, questions that insinuate, terms of truth and waking,
    else claims of engineered harm; of a yes, anger in capitals, named targets in place of vague ones, else plainer explanations. Null for
    other verdicts."""
    no = F.when(jaqing, "asks_questions").when(intensity > 1.5, "truth_terms").otherwise("structural_claims")
    yes = F.when(shouting > 3.0, "shouting").when(agency < 0.2, "named_targets").otherwise("plain_causes")
    return F.when(verdict == "no", no).when(verdict == "yes", yes)
