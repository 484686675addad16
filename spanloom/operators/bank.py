"""Banks of examples that cover kinds of evidence and actors, labels and complexity, under a cap on each label."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import shuffled
from .spans import overlap_join

# What tells the kinds of evidence and of actors.
EVIDENCE_KINDS = {
    "url": r"(?i)https?://|www\.",
    "named": r"(?i)\b(Reuters|AP|BBC|NYT|WHO|CDC|Kremlin|Ministry|Harvard|Stanford|Boudry|Meigs|Dunbar)\b",
    "quote_attr": r"(?i)['\"“”‘’].+['\"“”‘’]\s*(?:—|-)?\s*(?:said|told|according to|reported|writes|stated)\b",
    "numeric_source": r"(?i)\b\d+(\.\d+)?\s*(%|percent|pp|people|cases|pages?)\b",
}
ACTOR_KINDS = {
    "vague_collective": r"(?i)\b(they|the elite|globalists|deep state|big pharma)\b",
    "named_org": EVIDENCE_KINDS["named"],
    "named_person": r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b",
}


def _kinds(text: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in patterns.items())))


def bank_signals(docs: DataFrame, spans: DataFrame, score: Column, evidence: dict[str, str] | None = None, actors: dict[str, str] | None = None, key: str = "doc_id") -> DataFrame:
    """docs with what a bank asks of them: labels, evidence_kinds and actor_kinds (sorted arrays), n_spans, n_overlaps, n_nested (ordered
    pairs, equal spans both ways) and quality, the mean of ``score`` over its spans (columns key, label, start, end, span_text); empty, 0
    and 0.0 without spans."""
    said = F.trim("span_text")
    kinds = lambda label, patterns: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("label") == label, _kinds(said, patterns))))))
    per = spans.groupBy(key).agg(
        F.count("*").alias("n_spans"), F.array_sort(F.collect_set("label")).alias("labels"), F.avg(score).alias("quality"),
        kinds("Evidence", EVIDENCE_KINDS if evidence is None else evidence).alias("evidence_kinds"), kinds("Actor", ACTOR_KINDS if actors is None else actors).alias("actor_kinds"),
    )
    order = Window.partitionBy(key).orderBy("start", "end", "label")
    numbered = spans.select(key, "start", "end", F.row_number().over(order).alias("n"))
    pairs = overlap_join(numbered, numbered, [key])
    within = lambda a, b: ((F.col(f"start_{a}") <= F.col(f"start_{b}")) & (F.col(f"end_{b}") <= F.col(f"end_{a}"))).cast("int")
    met = pairs.where("n_a < n_b").groupBy(key).agg(F.count("*").alias("n_overlaps"), F.sum(within("a", "b") + within("b", "a")).alias("n_nested"))
    out = docs.join(per, key, "left").join(met, key, "left")
    none = F.array().cast("array<string>")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("n_spans", "n_overlaps", "n_nested")} | {c: F.coalesce(c, none) for c in ("labels", "evidence_kinds", "actor_kinds")}
    return out.withColumns(filled | {"quality": F.round(F.coalesce("quality", F.lit(0.0)), 6)})


def _picked(rows: list[dict], n: int, negatives: int, n_complex: int, most: int, evidence: set[str], actors: set[str]) -> list[tuple[dict, str]]:
    """The passes over candidates, each in its order; every pass goes once through those that are left."""
    fullness = lambda r: (r["n_spans"], r["n_overlaps"], r["n_nested"], len(r["labels"]), {"Action", "Effect"} <= set(r["labels"]))
    budget = max(0, n - negatives)
    rows = sorted(rows, key=lambda r: r["key"])
    positive = [r for r in rows if r["labels"]]
    complex_ = sorted((r for r in positive if r["complex"]), key=fullness, reverse=True)  # stable: of equals the lesser key
    normal = sorted((r for r in positive if not r["complex"]), key=lambda r: (r["quality"], {"Action", "Effect"} <= set(r["labels"]), "Victim" in r["labels"]), reverse=True)
    count: dict[str, int] = {}
    out: list[tuple[dict, str]] = []
    taken: set = set()

    def sweep(pool, how, room, wanted=lambda r: True, once=False, capped=True) -> None:
        for r in pool:
            if room() <= 0:
                return
            if r["key"] in taken or not wanted(r) or capped and any(count.get(x, 0) >= most for x in r["labels"]):
                continue
            taken.add(r["key"])
            out.append((r, how))
            for x in r["labels"]:
                count[x] = count.get(x, 0) + 1
            if how in ("evidence", "actor"):
                (evidence if how == "evidence" else actors).difference_update(r[f"{how}_kinds"])
            if once:
                return

    first = min(n_complex, budget)
    sweep(complex_, "complex", lambda: first - len(out))
    room = lambda: budget - len(out)  # what complex ones leave goes to the normal ones
    own = lambda: [set(r["labels"]) for r, how in out if how != "complex"]
    sweep(normal, "evidence", room, lambda r: "Evidence" in r["labels"] and bool(evidence & set(r["evidence_kinds"])))
    sweep(normal, "actor", room, lambda r: "Actor" in r["labels"] and bool(actors & set(r["actor_kinds"])))
    if not any("Victim" in x for x in own()):
        sweep(normal, "victim", room, lambda r: "Victim" in r["labels"], once=True)
    if not any({"Action", "Effect"} <= x for x in own()):
        sweep(normal, "action_effect", room, lambda r: {"Action", "Effect"} <= set(r["labels"]), once=True)
    sweep(normal, "quality", room)
    rest = sorted(positive, key=lambda r: (fullness(r), r["quality"]), reverse=True)
    sweep(rest, "rest", room)
    sweep(rest, "relaxed", room, capped=False)
    if not positive:
        negatives = n
    mixed = sorted((r for r in rows if r["pool"] and not r["labels"]), key=lambda r: (r["at"], r["key"]))
    hard = [r for r in mixed if r["hard"]][: min(1, negatives)]
    clean = [r for r in mixed if r["pool"] == "clean" and r not in hard][: max(0, negatives - len(hard))]
    return out + [(r, "hard") for r in hard] + [(r, "clean") for r in clean]


def diversified_bank(rows: DataFrame, by: str, n: int = 10, negatives: int = 2, n_complex: int = 3, least_spans: int = 6, least_overlaps: int = 1, most: int = 4, evidence: tuple[str, ...] = tuple(EVIDENCE_KINDS), actors: tuple[str, ...] = tuple(ACTOR_KINDS), key: str = "doc_id") -> DataFrame:
    """For each value of ``by`` a bank of n examples: by, key, how and place, a shuffled order.

    rows: ``bank_signals`` with pool (clean, hard or null: as ``negative_pools`` has it; hard may be told apart by a column hard). Complex
    ones come first, by spans, overlaps, nested pairs, labels, and an Action with an Effect. Normal ones follow by quality, in passes: for
    kinds of evidence not seen yet, for kinds of actors, for a Victim, for an Action with an Effect, then any. What is missing comes from
    all others. No label is in more than ``most`` examples, until nothing else is left (relaxed). One hard negative and clean ones close the
    bank; without any positive there are only these.

    Rows that have the same labels and kinds can only be taken in their order, so the first n of each such class are all that any pass can
    reach: ranks are cut there, by task first, and what a bank chooses from is as bounded as the classes. Ties go to the lesser key.
    """
    df = rows.select(F.col(by).alias("by_"), F.col(key).alias("key"), "labels", "evidence_kinds", "actor_kinds", "n_spans", "n_overlaps", "n_nested", "quality", "pool",
                     (F.col("hard") if "hard" in rows.columns else F.coalesce(F.col("pool") == "hard", F.lit(False))).alias("hard"), shuffled(key, "bank").alias("at"))
    df = df.withColumn("complex", (F.col("n_spans") >= least_spans) & (F.col("n_overlaps") >= least_overlaps))
    kind = Window.partitionBy("by_", "complex", "labels", "evidence_kinds", "actor_kinds")
    full = [F.desc(c) for c in ("n_spans", "n_overlaps", "n_nested")]  # labels are the same within a class
    positive = df.where(F.size("labels") > 0)

    def front(pool: DataFrame, w) -> DataFrame:
        return pool.withColumn("nth_", F.row_number().over(w)).where(F.col("nth_") <= n).drop("nth_")

    parts = [front(positive, kind.orderBy(*full, "key")), front(positive, kind.orderBy(*full, F.desc("quality"), "key")), front(positive, kind.orderBy(F.desc("quality"), "key"))]
    for name in ("hard", "clean"):
        own = df.where(F.size("labels") == 0).where(F.col("hard") if name == "hard" else F.col("pool") == "clean")
        parts.append(front(own, Window.partitionBy("by_").orderBy("at", "key")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.dropDuplicates(["by_", "key"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        for c in ("labels", "evidence_kinds", "actor_kinds"):
            pdf[c] = pdf[c].map(list)
        got = _picked(pdf.to_dict("records"), n, negatives, n_complex, most, set(evidence), set(actors))
        order = {r["key"]: i + 1 for i, r in enumerate(sorted((r for r, _ in got), key=lambda r: (r["at"], r["key"])))}
        return pd.DataFrame([(pdf["by_"].iloc[0], r["key"], how, order[r["key"]]) for r, how in got], columns=[by, key, "how", "place"])

    kinds = dict(rows.dtypes)
    return every.groupBy("by_").applyInPandas(choose, f"{by} {kinds[by]}, {key} {kinds[key]}, how string, place int")


def bank_spans(bank: DataFrame, spans: DataFrame, most: int = 10, key: str = "doc_id") -> DataFrame:
    """The spans that a bank's examples show: all of complex ones, of others the first of each label, at most ``most`` in order of place."""
    own = spans.join(bank.select(key, "how"), key)  # a bank is few rows
    first = F.row_number().over(Window.partitionBy(key, "label").orderBy("start", "end"))
    own = own.withColumn("nth_", first).where((F.col("how") == "complex") | (F.col("nth_") == 1))
    place = F.row_number().over(Window.partitionBy(key).orderBy("start", "end", "label"))
    return own.withColumn("nth_", place).where((F.col("how") == "complex") | (F.col("nth_") <= most)).drop("nth_", "how")
