"""Choosing few examples from many: strata, balance, diversity, prototypes and scores.

Orders that a random stream would give come from a hash of seed and id, so reruns and any partitioning agree.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import LABELS
from .retrieval import mmr_strata
from .sampling import hash_ranked, shuffled
from .staging import small_batches, staged

# Cues that scores count, and the windows of length of the pools.
CONSPIRACY_CUES = r"(?i)deep state|globalist|elite|agenda|cover[- ]?up|false flag|hoax|they\s+want|they're trying|new world order|pedo|chemtrail|MK[-\s]?Ultra|shadow government"
DEBUNK_CUES = r"(?i)\b(debunk|myth|not true|no evidence|conclusion is wrong|conspiracy theory(?:ies)? as such)\b"
SALIENCE_CUES = ("control", "cover up", "agenda", "rigged", "evidence", "plot", "blame", "secret")


def example_bank(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with what its spans say: n_spans, labels (sorted), has_ae (an Action and an Effect) and has_victim."""
    per = spans.groupBy(key).agg(F.count("*").alias("n_spans"), F.array_sort(F.collect_set("label")).alias("labels"))
    out = docs.join(per, key, "left").withColumns({"n_spans": F.coalesce("n_spans", F.lit(0)), "labels": F.coalesce("labels", F.array().cast("array<string>"))})
    has = lambda x: F.array_contains("labels", x)
    return out.withColumns({"has_ae": has("Action") & has("Effect"), "has_victim": has("Victim")})


def round_robin(df: DataFrame, by: str, n: int, order: list[Column], within: list[str] | None = None, name: str = "pick") -> DataFrame:
    """The first n rows when each value of ``by`` gives one row in turn, keys in shuffled order; adds the turn's position (from 1). within:
    columns whose values are dealt apart.

    Only the first n rows of a value can be among them, which is cut before rows of all values meet.
    """
    keys = within or []
    first = df.withColumn("turn_", F.row_number().over(Window.partitionBy(*keys, by).orderBy(*order))).where(F.col("turn_") <= n)
    place = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("turn_", shuffled(by), by))
    return first.withColumn(name, place).where(F.col(name) <= n).drop("turn_")


def stratified_examples(bank: DataFrame, n: int, source: str = "source", key: str = "doc_id") -> DataFrame:
    """n examples: a quarter without spans, two fifths with one or two, the rest with more; each stratum by round robin over sources.

    What the shares' rounding leaves goes to the last stratum. Missing ones come from the rest of the table, those with spans first.
    """
    level = F.when(F.col("n_spans") == 0, "negative").when(F.col("n_spans") <= 2, "simple").otherwise("complex")
    want = {"negative": int(n * 0.25), "simple": int(n * 0.40)}
    want["complex"] = n - sum(want.values())
    dealt = round_robin(bank.withColumn("stratum", level), source, n, [shuffled(key), F.col(key)], ["stratum"])
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in want.items() for x in kv)), F.col("stratum"))
    picked = dealt.where(F.col("pick") <= limit).withColumn("how", F.lit("stratum")).drop("pick")
    return _filled(picked, bank.withColumn("stratum", level), n, [(F.col("n_spans") == 0).cast("int"), shuffled(key, "fill"), F.col(key)], key)


def _filled(picked: DataFrame, pool: DataFrame, n: int, order: list[Column], key: str) -> DataFrame:
    """picked (fewer than a few thousand rows), and the first of the other rows of pool until there are n."""
    first = pool.orderBy(*order).limit(2 * n)  # of these at least n are not picked
    rest = first.join(picked.select(key), key, "left_anti").withColumn("how", F.lit("fill"))
    both = picked.withColumn("late", F.lit(0)).unionByName(rest.withColumn("late", F.lit(1)))
    return both.withColumn("nth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("late", *order))).where(F.col("nth") <= n).drop("late", "nth")


def halved_examples(bank: DataFrame, n: int, label: str = "doc_label", source: str = "source", key: str = "doc_id") -> DataFrame:
    """n examples, half of them conspiracy and half not (any other label counts as not), by round robin over sources; missing ones from the
    rest, in shuffled order."""
    side = F.when(F.col(label) == "conspiracy", "conspiracy").otherwise("non")
    pool = bank.withColumn("side", side)
    picked = round_robin(pool, source, n // 2, [shuffled(key), F.col(key)], ["side"]).withColumn("how", F.lit("half")).drop("pick")
    return _filled(picked, pool, n, [shuffled(key, "fill"), F.col(key)], key)


def balanced_pick(df: DataFrame, n: int, label: str = "doc_label", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The first n rows of each of the two classes by source, then shuffled."""
    by = Window.partitionBy(label).orderBy(source, shuffled(key), key)
    return df.where(F.col(label).isin("conspiracy", "non")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def pseudo_groups(df: DataFrame, size: int = 60, source: str = "source", key: str = "doc_id") -> DataFrame:
    """Adds group '<source>#<i>': the rows of a source, shuffled, in as few parts of at most ``size`` rows as possible, the first ones
    larger by one where they do not divide.

    A source's rows are ranked in ranges of their hash, so that no task has a whole source.
    """
    ranked = hash_ranked(df, [source], shuffled(key), key)
    sizes = df.groupBy(source).agg(F.count("*").alias("rows_"))
    on = ranked[source].eqNullSafe(sizes[source])
    j = ranked.join(sizes, on).select(ranked["*"], "rows_")
    parts = F.ceil(F.col("rows_") / size)
    small, wide = F.floor(F.col("rows_") / parts), F.col("rows_") % parts
    at = F.col("nth") - 1
    part = F.when(at < wide * (small + 1), F.floor(at / (small + 1))).otherwise(wide + F.floor((at - wide * (small + 1)) / small))
    return j.withColumn("group", F.concat(F.coalesce(source, F.lit("__unknown__")), F.lit("#"), part.cast("bigint").cast("string"))).drop("rows_", "nth")


def negative_pools(bank: DataFrame, text: str = "text") -> DataFrame:
    """Rows without spans that may serve as negatives, with pool: clean (60 to 220 characters without any cue), hard (80 to 240 characters
    with one)."""
    n = F.length(text)
    cue = F.col(text).rlike(r"(?i)http|www\.|@[a-z0-9_]|%|[0-9]{4}|deep state|globalist|they|elite")
    tempting = F.col(text).rlike(r"(?i)they|elite|deep state|globalist|agenda|cover[- ]?up|manipulat|engineer|weaponiz")
    pool = F.when(n.between(60, 220) & ~cue, "clean").when(n.between(80, 240) & tempting, "hard")
    return bank.where(F.col("n_spans") == 0).withColumn("pool", pool).where("pool is not null")


def cue_signals(df: DataFrame, cues: str = CONSPIRACY_CUES, debunk: str = DEBUNK_CUES, text: str = "text") -> DataFrame:
    """Adds cues (matches), debunk (whether there is one), qmarks and length. Where a pattern ignores case, it does so for letters beyond a to z, too."""
    c = F.col(text)
    read = F.translate(c, "\u0130\u0131", "\ufffd\ufffd")  # I with, i without a dot are other letters than i
    return df.withColumns({"cues": F.regexp_count(read, F.lit(f"(?u){cues}")), "debunk": read.rlike(f"(?u){debunk}"), "qmarks": F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit(""))), "length": F.length(c)})


def class_scores(df: DataFrame) -> DataFrame:
    """Over rows with cue_signals(): how well a text stands for the class conspiracy (score_yes) or the other (score_no)."""
    long = F.least(F.col("length") / 400.0, F.lit(1.0))
    yes = 3.0 * F.col("cues") + long - F.when(F.col("debunk"), 4.0).otherwise(0.0) - 0.5 * F.col("qmarks")
    no = long + F.when(F.col("debunk"), 2.0).otherwise(0.0) + F.when((F.col("cues") > 0) & ~F.col("debunk"), 1.0).otherwise(0.0) - 0.2 * F.col("qmarks")
    return df.withColumns({"score_yes": F.round(yes, 6), "score_no": F.round(no, 6)})


def halves_by_score(scored: DataFrame, n: int, label: str = "doc_label", key: str = "doc_id") -> DataFrame:
    """n rows of ``class_scores`` with a label: half of them (one at least) the conspiracies with the highest score_yes, the others those of
    non with the highest score_no, ties to the lesser key; what is missing comes from the rest, in shuffled order. Adds how."""
    first = max(1, n // 2)
    parts = []
    for name, score, most in (("conspiracy", "score_yes", first), ("non", "score_no", n - first)):
        parts.append(scored.where(F.col(label) == name).orderBy(F.desc(score), key).limit(most))
    picked = parts[0].unionByName(parts[1]).withColumn("how", F.lit("score"))
    return _filled(picked, scored, n, [shuffled(key, "fill"), F.col(key)], key)


def diverse_pick(df: DataFrame, n: int, order: list[Column], source: str = "source") -> DataFrame:
    """The first row of each source (whatever its case), sources in the order of these rows, at most n. Rows without a source all qualify."""
    own = F.lower(F.coalesce(source, F.lit("")))
    first = df.withColumn("src_", own).withColumn("nth_", F.row_number().over(Window.partitionBy("src_").orderBy(*order)))
    return first.where((F.col("nth_") == 1) | (F.col("src_") == "")).orderBy(*order).limit(n).drop("src_", "nth_")


def per_label_examples(bank: DataFrame, n: int, cues: tuple[str, ...] = SALIENCE_CUES, per_label: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each label the first per_label examples that have it, then the most salient others until n: those with most cues, a text of at
    most 220 characters counting as one more.

    An example chosen for several labels is there once. Adds label (the first it was chosen for) and salience.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    salience = sum((F.contains(low, F.lit(c)).cast("int") for c in cues), (F.length(low) <= 220).cast("int"))
    rows = bank.withColumn("salience", salience)
    each = rows.select(key, F.explode("labels").alias("label")).withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy(key))).where(F.col("nth") <= per_label)
    place = F.array_position(F.array(*(F.lit(x) for x in LABELS)), F.col("label"))
    chosen = each.groupBy(key).agg(F.min_by("label", place).alias("label"))
    picked = rows.join(chosen, key).withColumn("how", F.lit("label"))
    return _filled(picked, rows.withColumn("label", F.lit(None).cast("string")), n, [F.desc("salience"), F.col(key)], key)


def prototype_order(examples: DataFrame, n: int = 8, position: str = "position", key: str = "doc_id") -> DataFrame:
    """Orders chosen examples (key, position, labels, reason): the first without labels, then for each label its prototype, then a
    conflicting one, then the others; n at most. Adds place from 1.

    A label's prototype is the first example that has it and whose reason begins with prototype_clean, or else is
    per_label_top; a conflicting one's reason begins with ambiguous_pair_. examples are few.
    """
    r = F.coalesce("reason", F.lit(""))
    good = F.when(r.startswith("prototype_clean"), 0).when(r == "per_label_top", 1)
    each = examples.select(key, position, F.explode("labels").alias("label"), good.alias("good")).where("good is not null")
    best = each.groupBy("label").agg(F.min(F.struct("good", position, key)).alias("b"))
    place = F.array_position(F.array(*(F.lit(x) for x in LABELS)), F.col("label"))
    protos = best.where(place > 0).select(F.col(f"b.{key}").alias(key), place.cast("int").alias("rank_"))
    first = lambda keep, rank: examples.where(keep).groupBy().agg(F.min_by(key, position).alias(key)).where(F.col(key).isNotNull()).withColumn("rank_", F.lit(rank))
    ranks = first(F.size("labels") == 0, 0).unionByName(protos).unionByName(first(r.startswith("ambiguous_pair_"), 6)).groupBy(key).agg(F.min("rank_").alias("rank_"))
    out = examples.join(ranks, key, "left").withColumn("rank_", F.coalesce("rank_", F.lit(7)))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank_", position))).where(F.col("place") <= n).drop("rank_")


def closeness(spans: DataFrame, priors: DataFrame, lengths: DataFrame, pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds z_len, pos_dist and score: how near a span is to its label's usual length and place, with a bonus where its document has an
    ambiguous pair and where it is not overlong.

    priors: label, mu, sigma, mode, q90; lengths: key, n_text; pairs: key of documents with such a pair.
    """
    j = spans.join(F.broadcast(priors), "label").join(lengths, key).join(pairs.select(key, F.lit(1.0).alias("pair_")).distinct(), key, "left")
    n = F.greatest(F.lit(1), F.col("end") - F.col("start"))
    z = F.abs((F.ln(n) - F.col("mu")) / F.col("sigma"))
    d = F.abs(F.col("start") / F.greatest(F.lit(1), F.col("n_text")) - F.col("mode"))
    score = 1.5 * (1 - F.least(F.lit(3.0), z) / 3) + 1.5 * (1 - F.least(F.lit(1.0), d)) + F.coalesce("pair_", F.lit(0.0)) + 0.25 * (n <= F.col("q90")).cast("double")
    return j.select(*spans.columns, F.round(z, 6).alias("z_len"), F.round(d, 6).alias("pos_dist"), F.round(score, 6).alias("score"))


def fewshot_for_document(pool: DataFrame, k: int = 8, key: str = "doc_id") -> DataFrame:
    """k examples of pool (key, n_spans, has_ae, has_victim) in shuffled order, changed so that two have spans, one a Victim and one an
    Action with an Effect, if the pool has them.

    Positives from behind replace the first ones without spans; a Victim then takes the last place and an Action
    with Effect the first. Ordered by what they show, then by key; adds place. Only the first rows of each kind are
    looked at, so the pool may be any size.
    """
    mixed = pool.select(key, (F.col("n_spans") > 0).alias("pos"), "has_ae", "has_victim", shuffled(key).alias("at"))
    kinds = [mixed.orderBy("at", key).limit(k)] + [mixed.where(c).orderBy("at", key).limit(k + 2) for c in ("pos", "has_victim", "has_ae")]
    rows = kinds[0]
    for other in kinds[1:]:
        rows = rows.unionByName(other)
    rows = sorted(rows.distinct().collect(), key=lambda r: (r["at"], str(r[key])))  # at most 4 k + 6 rows
    base, pool_ = rows[:k], rows
    pos = sum(r["pos"] for r in base)
    for extra in [r for r in pool_ if r["pos"] and r not in base]:
        i = next((i for i, r in enumerate(base) if not r["pos"]), None)
        if pos >= 2 or i is None:
            break
        base[i], pos = extra, pos + 1
    for kind, at in (("has_victim", -1), ("has_ae", 0)):
        found = next((r for r in pool_ if r[kind] and r not in base), None)
        if base and found and not any(r[kind] for r in base):
            base[at] = found
    base.sort(key=lambda r: (-100 * r["has_ae"] - 10 * r["has_victim"] - r["pos"], str(r[key])))
    return pool.sparkSession.createDataFrame([(r[key], i + 1) for i, r in enumerate(base)], f"{key} {dict(pool.dtypes)[key]}, place int")


def document_score(bank: DataFrame) -> DataFrame:
    """Adds score: a tenth for each span, 2 for an Action with an Effect, 1 for a Victim."""
    return bank.withColumn("score", F.round(0.1 * F.col("n_spans") + 2.0 * F.col("has_ae").cast("int") + F.col("has_victim").cast("int"), 6))


def rare_quotas(bank: DataFrame, n: int, rare: tuple[str, ...] = ("Evidence", "Victim"), key: str = "doc_id") -> DataFrame:
    """n examples: half with spans, of which up to 60 % have a rare label, and as many without; each in shuffled order. Adds how."""
    kind = F.when(F.col("n_spans") == 0, "negative").when(F.arrays_overlap("labels", F.array(*(F.lit(x) for x in rare))), "rare").otherwise("common")
    half = n // 2
    ranked = bank.withColumn("how", kind).withColumn("nth", F.row_number().over(Window.partitionBy("how").orderBy(shuffled(key), key))).where(F.col("nth") <= half)
    n_rare = ranked.where(F.col("how") == "rare").count()
    quota = {"rare": min(n_rare, int(half * 0.6)), "negative": half}
    quota["common"] = max(0, half - quota["rare"])
    return ranked.where(F.col("nth") <= F.element_at(F.create_map(*(F.lit(x) for kv in quota.items() for x in kv)), F.col("how"))).drop("nth")


def rare_quotas_diverse(bank: DataFrame, n: int, rare: tuple[str, ...] = ("Evidence", "Victim"), key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """As rare_quotas(), but within each kind the examples are picked by nearness to its centre and distance to those picked: key, how, place."""
    kind = F.when(F.col("n_spans") == 0, "negative").when(F.arrays_overlap("labels", F.array(*(F.lit(x) for x in rare))), "rare").otherwise("common")
    rows = bank.where(F.col(vector).isNotNull()).withColumn("how", kind)
    half = n // 2
    n_rare = min(rows.where(F.col("how") == "rare").count(), int(half * 0.6))
    quotas = {"rare": n_rare, "common": max(0, half - n_rare), "negative": half}
    return mmr_strata(rows, {k: v for k, v in quotas.items() if v}, "how", key=key, vector=vector)


def component_folds(df: DataFrame, k: int, component: str = "component", label: str = "doc_label", seed: str = "42") -> DataFrame:
    """component, label and fold: whole components dealt to k folds in turn within the label that most of their rows have (of equals the
    first by name). Ranks are counted in parts by hash."""
    votes = df.groupBy(component, label).agg(F.count("*").alias("n"))
    major = votes.groupBy(component).agg(F.max_by(label, F.struct("n", F.lit(0))).alias("any"), F.max("n").alias("top"))
    best = votes.join(major.select(component, "top"), component).where("n = top").groupBy(component).agg(F.min(label).alias(label))
    ranked = hash_ranked(best, [label], shuffled(component, seed), component)
    return ranked.withColumn("fold", F.pmod(F.col("nth") - 1, F.lit(k)).cast("int")).drop("nth")


#: Words are counted in so many buckets of a hash.
WORD_BUCKETS = 1 << 18


def _size_classes(threshold: float) -> Iterator[tuple[int, int]]:
    """The sizes where the classes of sets begin, and into how many parts a class cuts a set: a set has at most the sizes of its own
    class and the next above it among those of larger sets that may be similar."""
    rest = (1 - threshold) / (1 + threshold)
    low = 1
    while True:
        after = max(low + 1, math.ceil(low / threshold - 1e-9))
        yield low, max(int(2 * (after - 1) * rest + 1e-6) + 1, -(-low // 2))
        low = after


def _mixed(h: np.ndarray) -> np.ndarray:
    """64 bits, each of which depends on all bits of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _part_signs(hashes: np.ndarray, size: np.ndarray, weight: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """For the sets of a batch (word hashes, one set behind the other, and how many each has): numbers of sets, and the signatures of
    parts that stand for them, once in their own class of sizes and once in the next."""
    lows, parts = map(np.array, zip(*itertools.takewhile(lambda x: x[0] <= 2 * int(size.max()) / threshold + 9, _size_classes(threshold)), strict=True))
    rest = (1 - threshold) / (1 + threshold)
    own = np.searchsorted(lows, size, side="right") - 1
    largest = np.floor(size / threshold + 1e-6).astype(np.int64)  # of the sets that may be similar
    for up in (0, 1):
        at = np.flatnonzero(largest >= lows[own + up]) if up else np.arange(len(size))
        if not len(at):
            continue
        group = own[at] + up
        # So many words at most are in one of two similar sets only; each makes one part differ.
        differ = np.floor((size[at] + np.minimum(largest[at], lows[group + 1] - 1)) * rest + 1e-6).astype(np.int64)
        n = parts[group]
        first = np.cumsum(n) - n
        there = np.repeat(np.isin(np.arange(len(size)), at), size)
        row = np.repeat(np.arange(len(at)), size[at])
        h = hashes[there]
        place = first[row] + (_mixed(h ^ _mixed(group.astype(np.uint64) + np.uint64(1))[row]) % n[row].astype(np.uint64)).astype(np.int64)
        total = int(n.sum())
        said = _mixed(h)
        low = np.bincount(place, (said & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)  # whole numbers, exact
        high = np.bincount(place, (said >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
        told = np.bincount(place, weight[there], total)
        of = np.repeat(np.arange(len(at)), n)
        nth = (np.arange(total) - first[of]).astype(np.uint64)
        sign = _mixed(low + (high << np.uint64(32)) + _mixed((group[of].astype(np.uint64) << np.uint64(32)) + nth))
        order = np.lexsort((sign, -told, of))
        kept = order[np.arange(total) - first[of] <= differ[of]]
        yield at[of[kept]], sign[kept].view(np.int64), not up


def _sketches(hashes: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """For each set of a batch, for as many places as the least power of two from its size on (64 at least), whether an odd number of its
    words falls there: sets that differ in d words differ in at most d places. The halves' differences are the sketch of half the length."""
    places = 1 << np.maximum(6, np.ceil(np.log2(size)).astype(np.int64))
    first = np.cumsum(places) - places
    at = np.repeat(first, size) + (_mixed(hashes + np.uint64(1)) & np.repeat(places - 1, size).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(places.sum())) & 1).astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(places >> 6)).astype(np.int32)), pa.array(odd))


def jaccard_candidates(sets: DataFrame, threshold: float, key: str = "doc_id", words: str = "w") -> DataFrame:
    """x and y (x the lesser key) of all rows whose sorted sets of words may have a Jaccard similarity of ``threshold`` or more: a superset.

    Similar sets differ in at most d words, so of any n parts that the words' hashes cut them into at least n - d are equal; hence the d + 1
    parts of a set that say most have one in common with those of every similar set. Parts of some two words meet far less
    often than words. What a part says is the rarity of its words, by counts in WORD_BUCKETS buckets; it decides how many
    candidates there are, and not which similar pairs are met. Of these, sketches rule out pairs that differ in too many places.
    """
    small_batches(sets.sparkSession)
    kind = sets.schema[key].dataType.simpleString()
    hashed = sets.select(key, F.transform(words, lambda t: F.xxhash64(t)).alias("h_"))
    counts = np.ones(WORD_BUCKETS)
    for r in hashed.select(F.explode("h_").alias("h")).groupBy(F.pmod("h", F.lit(WORD_BUCKETS)).cast("int").alias("b")).count().toLocalIterator():
        counts[r["b"]] += r["count"]
    says = sets.sparkSession.sparkContext.broadcast(np.floor(1000 * np.log(counts.sum() / counts)).astype(np.int32))

    def batches_of(batches):
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(1)), 0))
            if batch.num_rows:
                h = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield batch.column(0), h, pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)

    def signs(batches):
        for ids, h, size in batches_of(batches):
            for at, sign, own in _part_signs(h.view(np.uint64), size, says.value[h & (WORD_BUCKETS - 1)], threshold):
                cols = [ids.take(pa.array(at)), pa.array(size[at].astype(np.int32)), pa.array(np.full(len(at), own)), pa.array(sign)]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "m", "own", "sign"])

    def sketches(batches):
        for ids, h, size in batches_of(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int32)), _sketches(h.view(np.uint64), size)], names=[key, "m", "s"])

    signed = hashed.mapInArrow(signs, f"{key} {kind}, m int, own boolean, sign long")
    signed = staged(signed.withColumn("n_", F.count("*").over(Window.partitionBy("sign"))).where("n_ > 1").drop("n_"))
    sketched = staged(hashed.mapInArrow(sketches, f"{key} {kind}, m int, s array<long>"))
    a, b = signed.alias("a"), signed.alias("b")
    like = F.least("a.m", "b.m") >= F.lit(threshold - 1e-9) * F.greatest("a.m", "b.m")
    met = (F.col(f"a.{key}") < F.col(f"b.{key}")) & like & F.when(F.col("a.m") >= F.col("b.m"), F.col("a.own")).otherwise(F.col("b.own"))
    met = a.join(b, F.col("a.sign") == F.col("b.sign")).where(met).select(F.col(f"a.{key}").alias("x"), F.col(f"b.{key}").alias("y")).distinct()
    side = lambda c: sketched.select(F.col(key).alias(c), F.col("m").alias(f"m{c}"), F.col("s").alias(f"s{c}"))
    both = met.join(side("x"), "x").join(side("y"), "y")
    odd = lambda p, q: F.zip_with(p, q, lambda i, j: i.bitwiseXOR(j))
    half = lambda s: (F.size(s) / 2).cast("int")
    cut = lambda s, other: F.when(F.size(s) > F.size(other), odd(F.slice(s, 1, half(s)), F.slice(s, half(s) + 1, half(s)))).otherwise(F.col(s))
    differ = F.aggregate(odd(cut("sx", "sy"), cut("sy", "sx")), F.lit(0), lambda n, w: n + F.bit_count(w))
    return both.where(differ <= F.floor((F.col("mx") + F.col("my")) * F.lit((1 - threshold) / (1 + threshold)) + 1e-6)).select("x", "y")


def greedy_jaccard(df: DataFrame, threshold: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that stay when each row goes that has a Jaccard similarity of ``threshold`` or more, of sets of lowered words, with a row
    that stayed before it by key. Texts without words go.

    Rows of equal sets count as the first of them. Pairs are met by ``jaccard_candidates`` and compared; they are decided in rounds,
    each settling the rows whose earlier neighbours are settled.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.trim(F.lower(text)), r"[ \t\r\n\f\x0B]+"), lambda w: w != "")))
    sets = df.select(key, words.alias("w")).where(F.size("w") > 0)
    sets = staged(sets.groupBy(F.md5(F.to_json(F.struct("w"))).alias("set")).agg(F.min(key).alias(key), F.first("w").alias("w")).select(key, "w"))
    met = jaccard_candidates(sets, threshold, key)
    x, y = sets.select(F.col(key).alias("x"), F.col("w").alias("wx")), sets.select(F.col(key).alias("y"), F.col("w").alias("wy"))
    both = F.size(F.array_intersect("wx", "wy"))
    pairs = staged(met.join(x, "x").join(y, "y").where(both >= F.lit(threshold - 1e-9) * (F.size("wx") + F.size("wy") - both)).select("x", "y"))
    gone = None
    open_ = pairs
    while not open_.isEmpty():
        later = open_.select(F.col("y").alias("x")).distinct()
        stay = open_.join(later, "x", "left_anti").select("x").distinct()  # no open row is before them: they stay
        drop = staged(open_.join(stay, "x", "left_semi").select(F.col("y").alias(key)).distinct())
        gone = drop if gone is None else gone.unionByName(drop)
        left = open_.join(stay, "x", "left_anti")
        left = left.join(drop.select(F.col(key).alias("x")), "x", "left_anti").join(drop.select(F.col(key).alias("y")), "y", "left_anti")
        open_ = staged(left.select("x", "y"))
    kept = sets.select(key) if gone is None else sets.select(key).join(gone, key, "left_anti")
    return df.join(kept, key, "left_semi")
