"""Span algebra: interval joins, merging, voting, suppression and conflict rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import LABELS
from ..functions.spans import contains, iou, overlaps, trimmed

#: Spans meet in the cells of this many characters that both touch.
CELL = 64


def _cells(df: DataFrame) -> DataFrame:
    return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of spans of equal ``on`` that share a character; other columns get the suffixes _a and _b.

    Both sides are dealt by ``on`` and the cells a span touches, so long documents do not meet as a whole; a pair is
    taken in the first cell that both touch. Empty spans overlap nothing.
    """
    def name(df: DataFrame, s: str) -> DataFrame:
        df = _cells(df.where("end > start"))
        return df.select(*on, "_cell", *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in (*on, "_cell")))

    pairs = name(left, a).join(name(right, b), [*on, "_cell"])
    first = F.greatest(F.floor(F.col(f"start_{a}") / CELL), F.floor(F.col(f"start_{b}") / CELL))
    meet = overlaps(F.col(f"start_{a}"), F.col(f"end_{a}"), F.col(f"start_{b}"), F.col(f"end_{b}"))
    return pairs.where(meet & (F.col("_cell") == first)).drop("_cell")


def with_text(spans: DataFrame, docs: DataFrame, derive: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds columns derived from a span and its document's text: derive maps a name to a function of (text, span struct).

    Spans of a document meet its text as one array, so a text moves once and not once for each of its spans. Spans
    without a document go.
    """
    cols = [c for c in spans.columns if c != key]
    grouped = spans.groupBy(key).agg(F.collect_list(F.struct(*cols)).alias("_spans"))
    j = grouped.join(docs.select(key, F.col(text).alias("_text")), key)
    made = F.transform("_spans", lambda s: F.struct(*(s[c].alias(c) for c in cols), *(f(F.col("_text"), s).alias(n) for n, f in derive.items())))
    return j.select(key, F.inline(made))


#: Texts are cut into pieces of this many characters.
PIECE = 512


class Pieces:
    """A text in pieces, so that what stands at a place is read there and not sought from the text's first character on."""

    def __init__(self, pieces: Column, length: Column):
        self.pieces, self.length = pieces, length

    def cut(self, start: Column, length: Column) -> Column:
        """The text from the character ``start`` (from 0) on; empty before the text's first."""
        start, length = start.cast("int"), length.cast("int")
        k = (start / PIECE).cast("int")
        off = start - k * PIECE
        piece = lambda i: F.coalesce(F.get(self.pieces, i), F.lit(""))
        long = F.array_join(F.slice(self.pieces, k + 1, ((off + length) / PIECE).cast("int") + 1), "")
        part = F.when(start.isNull() | length.isNull(), F.lit(None)).when((start < 0) | (length <= 0), "").when(off + length <= 2 * PIECE, F.concat(piece(k), piece(k + 1))).otherwise(long)
        return F.substring(part, off + 1, length)


def with_pieces(spans: DataFrame, docs: DataFrame, derive: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As with_text(), but derive's functions get the text as Pieces: the work grows with the text and its spans, not with their product.
    Spans of a document without a text get nulls."""
    cols = [c for c in spans.columns if c != key]
    grouped = spans.groupBy(key).agg(F.collect_list(F.struct(*cols)).alias("_spans"))
    # Cut before the join, so that no plan moves the cutting to each span.
    cut = docs.select(key, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("_pieces"), F.length(text).alias("_n"))
    j = grouped.join(cut, key)
    there = lambda c: F.when(F.col("_n").isNotNull(), c)
    made = F.transform("_spans", lambda s: F.struct(*(s[c].alias(c) for c in cols), *(there(f(Pieces(F.col("_pieces"), F.col("_n")), s)).alias(n) for n, f in derive.items())))
    return j.select(key, F.inline(made))


def self_overlaps(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Unordered pairs of overlapping spans of a document, ordered by (start, end, label), with iou."""
    pairs = overlap_join(spans, spans, [key])
    before = F.struct("start_a", "end_a", "label_a") < F.struct("start_b", "end_b", "label_b")
    return pairs.where(before).withColumn("iou", iou(F.col("start_a"), F.col("end_a"), F.col("start_b"), F.col("end_b")))


def subset_dedup(spans: DataFrame, by: list[str]) -> DataFrame:
    """Without spans contained in another of the same ``by`` that starts earlier, or at the same place and is not shorter."""
    w = Window.partitionBy(*by).orderBy("start", F.desc("end"), *[c for c in ("label",) if c in spans.columns and c not in by])
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_reach", reach).where("_reach is null or _reach < end").drop("_reach")


def merge_gaps(spans: DataFrame, by: list[str], gap: int, merge_overlaps: bool = True) -> DataFrame:
    """Spans of the same ``by`` at most ``gap`` characters apart as one: by, start, end, n. Overlapping ones merge only if merge_overlaps."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    if merge_overlaps:
        far = F.col("start") - F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = F.coalesce(far > gap, F.lit(True))
    else:
        far = F.col("start") - F.lag("end").over(w)
        new = F.coalesce(~far.between(0, gap), F.lit(True))
    islands = spans.withColumn("_new", new.cast("int")).withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def merge_adjacent_texts(spans: DataFrame, by: list[str], gap: int = 2, text: str = "span_text") -> DataFrame:
    """Spans of the same ``by`` of which each begins 0 to ``gap`` characters behind the one before as one: by, start, end (the last one's),
    their texts joined by blanks, and n."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    new = F.coalesce(~(F.col("start") - F.lag("end").over(w)).between(0, gap), F.lit(True))
    islands = spans.withColumn("_new", new.cast("int")).withColumn("_island", F.sum("_new").over(w))
    said = F.array_sort(F.collect_list(F.struct("start", "end", F.coalesce(text, F.lit("")).alias("said"))))
    out = islands.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"), said.alias("_said"), F.count("*").alias("n"))
    return out.select(*by, "start", "end", F.array_join(F.transform("_said", lambda s: s["said"]), " ").alias(text), "n")


def trim_boundaries(spans: DataFrame, text: str = "text") -> DataFrame:
    """Bounds without outer white space; spans that are empty then, or out of the text, go."""
    inside = spans.where((F.col("start") >= 0) & (F.col("end") <= F.length(text)) & (F.col("start") < F.col("end")))
    s, e = trimmed(F.col(text), F.col("start"), F.col("end"))
    return inside.withColumns({"new_start": s, "new_end": e}).where("new_start < new_end")


def exact_vote(spans: DataFrame, key: str = "doc_id", voter: str = "role", least: int = 2) -> DataFrame:
    """Spans (label, start, end) that at least so many voters have."""
    return spans.groupBy(key, "label", "start", "end").agg(F.countDistinct(voter).alias("votes")).where(F.col("votes") >= least)


def ranked_votes(spans: DataFrame, k: int = 4, key: str = "doc_id", text: str = "span_text") -> DataFrame:
    """Of each document the k spans (label, start, end) that occur most often; of equals the longer, then the earlier, then the later in the
    labels' order. Adds votes, rank and the commonest text (of equals the lesser; null without any)."""
    each = spans.groupBy(key, "label", "start", "end", text).agg(F.count("*").alias("n"))
    told = F.when(F.coalesce(text, F.lit("")) != "", F.struct((-F.col("n")).alias("n"), F.col(text).alias("t")))
    votes = each.groupBy(key, "label", "start", "end").agg(F.sum("n").alias("votes"), F.min(told)["t"].alias(text))
    place = F.array_position(F.array(*(F.lit(x) for x in LABELS)), F.col("label"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), F.desc(F.col("end") - F.col("start")), "start", F.desc(place), "label")
    return votes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_consensus(votes: DataFrame, key: str = "doc_id", label: str = "label") -> DataFrame:
    """The commonest label of each key; keys whose two commonest labels are as common go."""
    counts = votes.groupBy(key, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), label)
    ranked = counts.withColumns({"rn": F.row_number().over(w), "second": F.lead("n").over(w)})
    return ranked.where("rn = 1 and (second is null or second < n)").select(key, label, "n")


def pair_rule_action_effect(j: Column, d_action: Column, d_effect: Column, prefer_action: bool = True) -> Column:
    """both, action or effect: of an Action and an Effect that overlap strongly the one nearer its prior stays."""
    return F.when(j < 0.6, "both").when(d_action < d_effect, "action").when(d_effect < d_action, "effect").otherwise("action" if prefer_action else "effect")


def pair_rule_actor_victim(s1: Column, e1: Column, s2: Column, e2: Column, position: Column, q25: Column) -> Column:
    """both, actor or victim: nested spans leave the smaller one, weak overlaps both, else the Actor stays if it comes early."""
    nested = contains(s1, e1, s2, e2) | contains(s2, e2, s1, e1)
    smaller = F.when(e1 - s1 <= e2 - s2, "actor").otherwise("victim")
    return F.when(nested, smaller).when(iou(s1, e1, s2, e2) < 0.5, "both").when(position <= q25, "actor").otherwise("victim")


# ---------------------------------------------------------------- ordered folds, one document and label at a time


def _iou(a, b) -> float:
    common = min(a[1], b[1]) - max(a[0], b[0])
    return common / (max(a[1], b[1]) - min(a[0], b[0])) if common > 0 else 0.0


def _folded(spans: DataFrame, by: list[str], fold, order: list[str], schema: str) -> DataFrame:
    """What fold makes of whole groups: it gets rows in order and where each group starts (last, how many rows there are), and returns rows. A
    group is one document's spans.

    Rows are dealt and sorted by Spark and pass through in batches, a group that a batch's end may have cut waits for
    the next; so many small groups cost no more than few large ones.
    """
    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            starts = (pdf[by] != pdf[by].shift()).any(axis=1).to_numpy().nonzero()[0]
            rest = pdf.iloc[starts[-1] :].reset_index(drop=True)
            yield fold(pdf.iloc[: starts[-1]], starts)
        if rest is not None and len(rest):
            yield fold(rest, np.array([0, len(rest)]))

    keys = [F.desc(o[1:]) if o.startswith("-") else F.col(o) for o in order]
    return spans.repartition(*by).sortWithinPartitions(*by, *keys).mapInPandas(run, schema)


def _fold(spans: DataFrame, by: list[str], keep, order: list[str], schema: str) -> DataFrame:
    """Applies keep to every group (a dict of arrays, by column, in order); it returns tuples of what follows ``by``."""
    names = spans.columns
    fields = [f.split()[0] for f in schema.split(", ")]

    def fold(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        cols = {c: pdf[c].to_numpy() for c in names}
        out = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            group = {c: v[a:b] for c, v in cols.items()}
            head = tuple(group[c][0] for c in by)
            out += [head + r for r in keep(group)]
        return pd.DataFrame(out, columns=fields)

    return _folded(spans, by, fold, order, schema)


def nms(spans: DataFrame, thresholds: dict[str, float], default: float = 0.5, key: str = "doc_id") -> DataFrame:
    """Greedy suppression per document and label: by falling score (then start and end), a span stays if its IoU with every kept one is
    below the label's threshold."""
    def keep(g: dict) -> list[tuple]:
        t = thresholds.get(g["label"][0], default)
        at: dict[int, list[int]] = {}  # kept spans by the cells they touch
        out = []
        for i, (s, e) in enumerate(zip(g["start"].tolist(), g["end"].tolist(), strict=True)):
            cells = range(s // CELL, max(s, e - 1) // CELL + 1)
            if all(_iou((s, e), (g["start"][k], g["end"][k])) < t for k in {k for c in cells for k in at.get(c, ())}):
                for c in cells:
                    at.setdefault(c, []).append(i)
                out.append((s, e, float(g["score"][i])))
        return out

    return _fold(spans, [key, "label"], keep, ["-score", "start", "end"], f"{key} long, label string, start long, end long, score double")


def consensus_clusters(spans: DataFrame, voters: int, key: str = "doc_id") -> DataFrame:
    """Clusters of spans per document and label: by (start, end) a span joins the first cluster whose first member it overlaps; clusters of
    more than half of the voters give their longest, then earliest, span."""
    def keep(g: dict) -> list[tuple]:
        rows = list(zip(g["start"].tolist(), g["end"].tolist(), strict=True))
        clusters: list[list[tuple[int, int]]] = []
        live: list[list[tuple[int, int]]] = []  # those that a later span may still overlap
        for s, e in rows:
            live = [c for c in live if c[0][1] > s]
            home = next((c for c in live if max(c[0][0], s) < min(c[0][1], e)), None)
            if home is None:
                clusters.append([(s, e)])
                live.append(clusters[-1])
            else:
                home.append((s, e))
        return [(*min(c, key=lambda x: (x[0] - x[1], x[0])), len(c)) for c in clusters if len(c) >= voters // 2 + 1]

    return _fold(spans, [key, "label"], keep, ["start", "end"], f"{key} long, label string, start long, end long, votes long")


def positional_nms(spans: DataFrame, threshold: float = 0.9, key: str = "doc_id") -> DataFrame:
    """Per document and label, by (start, end): a span stays if its IoU with every kept one is below the threshold."""
    def keep(g: dict) -> list[tuple]:
        kept: list[tuple[int, int]] = []
        live: list[tuple[int, int]] = []
        for s, e in zip(g["start"].tolist(), g["end"].tolist(), strict=True):
            live = [t for t in live if t[1] > s]
            if all(_iou((s, e), t) < threshold for t in live):
                kept.append((s, e))
                live.append((s, e))
        return kept

    return _fold(spans, [key, "label"], keep, ["start", "end"], f"{key} long, label string, start long, end long")


def self_consistency(spans: DataFrame, runs: int, threshold: float = 0.8, key: str = "doc_id") -> DataFrame:
    """Spans of several runs, per document and label by (start, end): a span joins the first cluster whose representative, its middle
    member, it overlaps with at least the threshold; clusters of max(2, runs/3) members give their representative."""
    def keep(g: dict) -> list[tuple]:
        clusters: list[list[tuple[int, int]]] = []
        live: list[list[tuple[int, int]]] = []
        for s, e in zip(g["start"].tolist(), g["end"].tolist(), strict=True):
            live = [c for c in live if c[len(c) // 2][1] > s]  # a representative only ever moves on by joining
            home = next((c for c in live if _iou((s, e), c[len(c) // 2]) >= threshold), None)
            if home is None:
                clusters.append([(s, e)])
                live.append(clusters[-1])
            else:
                home.append((s, e))
        return [(*c[len(c) // 2], len(c)) for c in clusters if len(c) >= max(2, runs // 3)]

    return _fold(spans, [key, "label"], keep, ["start", "end"], f"{key} long, label string, start long, end long, votes long")


def cap_per_label(spans: DataFrame, n: int, order: list[Column], key: str = "doc_id") -> DataFrame:
    """The first n spans of each label of a document."""
    return spans.withColumn("rank", F.row_number().over(Window.partitionBy(key, "label").orderBy(*order))).where(F.col("rank") <= n)


def salience(label: Column, length: Column) -> Column:
    """Weight of a span as an example: Actions and Effects before Actors and Victims before Evidence, short ones first."""
    weight = F.when(label.isin("Action", "Effect"), 3).when(label.isin("Actor", "Victim"), 2).otherwise(1)
    return weight + 1 / (1 + length / 10.0)


#: Matching looks at about so many pairs of a gold span and a prediction at a time.
PAIRS = 1 << 20


def matched(gold: tuple[np.ndarray, np.ndarray, np.ndarray], pred: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Which gold spans take a prediction when each in turn takes the free one of its group with the highest IoU of at least the threshold (the
    first of equals). Both sides are arrays of group, start and end, in this order.

    Gold spans none of whose predictions another one may take are decided at once, the others one by one.
    """
    (g, gs, ge), (p, ps, pe) = gold, pred
    hit = np.zeros(len(g), bool)
    if not len(g) or not len(p):
        return hit
    low = min(gs.min(), ps.min())
    wide = max(ge.max(), pe.max(), gs.max(), ps.max()) - low + 2
    longest = np.zeros(max(g[-1], p[-1]) + 1, np.int64)
    np.maximum.at(longest, p, pe - ps)
    place = p * wide + ps - low
    at = np.searchsorted(place, g * wide + np.maximum(gs - longest[g] - low, 0))
    n = np.maximum(np.searchsorted(place, g * wide + np.maximum(ge - low, 0)) - at, 0)
    upto = n.cumsum()
    used = np.zeros(len(p), bool)
    i = 0
    while i < len(g):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, side="right")))
        of = np.repeat(np.arange(i, j), n[i:j])
        k = np.arange(len(of)) - np.repeat(upto[i:j] - n[i:j] - (upto[i - 1] if i else 0) - at[i:j], n[i:j])
        common = np.minimum(ge[of], pe[k]) - np.maximum(gs[of], ps[k])
        near = np.flatnonzero((common > 0) & ~used[k])
        of, k = of[near], k[near]
        iou = common[near] / (np.maximum(ge[of], pe[k]) - np.minimum(gs[of], ps[k]))
        near = np.flatnonzero(iou >= threshold)
        near = near[np.lexsort((k[near], -iou[near], of[near]))]
        of, k = of[near], k[near]
        shared = np.unique(of[np.bincount(k, minlength=len(p))[k] > 1]) if len(k) else of
        alone = ~np.isin(of, shared)
        mine, first = np.unique(of[alone], return_index=True)
        hit[mine] = used[k[alone][first]] = True
        for a, b in zip(of[~alone].tolist(), k[~alone].tolist(), strict=True):
            if not hit[a] and not used[b]:
                hit[a] = used[b] = True
        i = j
    return hit


def greedy_match(gold: DataFrame, pred: DataFrame, threshold: float = 0.5, key: str = "doc_id") -> DataFrame:
    """Matches per document and label: each gold span in order takes the unmatched prediction with the highest IoU of at least the threshold
    (the first of equals). Counts tp, fp, fn."""
    both = gold.select(key, "label", "start", "end", F.lit(True).alias("is_gold")).unionByName(pred.select(key, "label", "start", "end", F.lit(False).alias("is_gold")))

    def fold(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        n = len(starts) - 1
        group, gold_ = np.repeat(np.arange(n), np.diff(starts)), pdf["is_gold"].to_numpy(bool)
        side = lambda of: (group[of], pdf["start"].to_numpy(np.int64)[of], pdf["end"].to_numpy(np.int64)[of])
        tp = np.bincount(group[gold_][matched(side(gold_), side(~gold_), threshold)], minlength=n)
        counts = {"tp": tp, "fp": np.bincount(group[~gold_], minlength=n) - tp, "fn": np.bincount(group[gold_], minlength=n) - tp}
        return pdf.iloc[starts[:-1]][[key, "label"]].reset_index(drop=True).assign(**counts)

    return _folded(both, [key, "label"], fold, ["start", "end"], f"{key} long, label string, tp long, fp long, fn long")


def resolve_conflicts(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Role-aware conflict rules over a document's spans (label, start, end, score) in order of place.

    Same label and IoU of at least 0.9: the higher score stays. Action and Effect that overlap: the later one is
    trimmed to begin after the earlier, or goes if nothing is left. Actor and Victim nested: the smaller stays.
    """
    def keep(g: dict) -> list[tuple]:
        rows = [list(r) for r in zip(g["label"].tolist(), g["start"].tolist(), g["end"].tolist(), g["score"].tolist(), strict=True)]
        begin = [r[1] for r in rows]
        alive = [True] * len(rows)
        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                if not alive[i] or begin[j] >= rows[i][2]:
                    break
                if not alive[j] or rows[j][1] >= rows[i][2]:
                    continue
                (la, sa, ea, pa), (lb, sb, eb, pb) = rows[i], rows[j]
                if la == lb and _iou((sa, ea), (sb, eb)) >= 0.9:
                    alive[i if pb > pa else j] = False
                elif {la, lb} == {"Action", "Effect"}:
                    rows[j][1] = max(sb, ea)
                    alive[j] = rows[j][1] < eb
                elif {la, lb} == {"Actor", "Victim"} and ((sa <= sb and eb <= ea) or (sb <= sa and ea <= eb)):
                    alive[i if ea - sa > eb - sb else j] = False
        return [tuple(r) for r, a in zip(rows, alive, strict=True) if a]

    return _fold(spans, [key], keep, ["start", "end", "label"], f"{key} long, label string, start long, end long, score double")


def snap_to_tokens(spans: DataFrame, tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Bounds moved out to those of the tokens a span touches (spans touching none go)."""
    t = tokens.select(key, F.col("s").alias("start"), (F.col("s") + F.length("tok")).alias("end")).where("end > start")
    hit = overlap_join(spans, t, [key])
    cols = [c for c in spans.columns if c not in (key, "start", "end")]
    return hit.groupBy(key, *(F.col(f"{c}_a").alias(c) for c in cols), F.col("start_a").alias("start"), F.col("end_a").alias("end")).agg(F.min("start_b").alias("new_start"), F.max("end_b").alias("new_end"), F.count("*").alias("n_tokens"))


def label_tokens(tokens: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each token that a span touches: the labels of those spans, sorted."""
    t = tokens.select(key, "i", F.col("s").alias("start"), (F.col("s") + F.length("tok")).alias("end"))
    hit = overlap_join(t, spans.select(key, "label", "start", "end"), [key])
    return hit.groupBy(key, F.col("i_a").alias("i")).agg(F.array_join(F.array_sort(F.collect_set("label_b")), "|").alias("labels"))
