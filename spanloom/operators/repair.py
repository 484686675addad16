"""Bringing predicted spans into order: gates, splits, overlap rules, repair of offsets, hygiene, recovery and partial credit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicons import LABELS
from . import spans as sp
from .location import locate_plain, similarity

# Words that are no span by themselves, what marks an action, what an actor does not begin with, the purpose that splits an
# action from its effect, least lengths by role, words that spans do not begin with, and what is no victim or actor.
EMPTY_WORDS = ("to", "of", "and", "the", "you", "them", "it", "he", "she", "they", "we", "us")
VERBISH = r"(?i)(^|[^a-z0-9_])([a-z0-9_]+ed|[a-z0-9_]+ing|[a-z0-9_]+s|be|is|are|was|were|do|does|did|have|has|had|make|take|give|get|use|say|go)([^a-z0-9_]|$)"
AUXILIARY = r"(?i)^(is|are|was|were|be|do|did|does|to)([^a-z0-9_]|$)"
PURPOSES = ("in order to", "so that", "to")
LEAST_LENGTHS = {"Actor": 3, "Victim": 3, "Action": 3, "Effect": 7, "Evidence": 5}
STOPWORDS = ("to", "of", "in", "on", "at", "for", "with", "by", "a", "an", "the", "and", "or")
NO_VICTIMS = ("bribe money", "taxes", "cash", "evidence", "agenda", "plan", "policy")
MONEY = r"^\$?[0-9][0-9,]*([.][0-9]+)?( *(k|m|b|million|billion))?$"
REPORTERS = ("reuters", "the author", "op", "users", "critics")
NATURAL_FORCES = ("virus", "covid", "inflation", "market")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def guard_rails(spans: DataFrame, why: Column, names: tuple[str, ...] = REPORTERS, forces: tuple[str, ...] = NATURAL_FORCES, unless: str = "engineer") -> DataFrame:
    """Without Actors that only report, and Actors that are forces of nature unless the reason given says otherwise."""
    t = F.lower("span_text")
    bad = (F.col("label") == "Actor") & (t.isin(*names) | (_any(t, forces) & ~F.contains(F.lower(F.coalesce(why, F.lit(""))), F.lit(unless))))
    return spans.where(~bad)


def quality_gate(spans: DataFrame, q90: DataFrame | None = None, verbish: str = VERBISH, attribution: str = tx.ATTRIBUTION, numbers: str = tx.NUMBERS) -> DataFrame:
    """Spans (label, start, end, span_text) that may stand: of the five labels, at least three characters and not one empty word; Evidence
    that names its source, Actions with a verb, Actors and Victims that do not begin with an auxiliary, and none but Evidence longer than
    1.2 times its label's 90 % length (q90: label, q90; at least 8)."""
    t = F.trim(F.coalesce("span_text", F.lit("")))
    words = F.size(F.filter(F.split(t, r"[ \t\r\n\f\x0B]+"), lambda w: w != ""))
    ok = F.col("label").isin(*LABELS) & (F.col("end") > F.col("start")) & (F.length(t) >= 3) & ~((words == 1) & F.lower(t).isin(*EMPTY_WORDS))
    ok = ok & F.when(F.col("label") == "Evidence", tx.is_evidence(t, attribution, numbers)).when(F.col("label") == "Action", t.rlike(verbish)).when(F.col("label").isin("Actor", "Victim"), ~t.rlike(AUXILIARY)).otherwise(True)
    out = spans.where(ok)
    if q90 is None:
        return out
    most = q90.select("label", F.floor(1.2 * F.greatest(F.lit(8), F.col("q90"))).alias("most_"))  # five rows
    out = out.join(F.broadcast(most), "label", "left").where((F.col("label") == "Evidence") | F.col("most_").isNull() | (F.col("end") - F.col("start") <= F.col("most_")))
    return out.select(*spans.columns)


def split_purposes(spans: DataFrame, purposes: tuple[str, ...] = PURPOSES) -> DataFrame:
    """An Action with a purpose clause becomes the Action before it and the Effect behind its marker; pieces under three characters: a short
    head leaves the span whole, a short tail goes."""
    found = rf"(?i)(?<![A-Za-z0-9_])({'|'.join(purposes)})(?![A-Za-z0-9_])"
    at = F.regexp_instr("span_text", F.lit(found))
    marker = F.length(F.regexp_extract("span_text", found, 1))
    df = spans.withColumns({"at_": F.when(F.col("label") == "Action", at).otherwise(0), "len_": marker})
    tail = F.expr("substring(span_text, at_ + len_)")
    skipped = F.length(tail) - F.length(F.ltrim(tail))
    df = df.withColumns({"cut_": F.col("start") + F.col("at_") - 1, "tail_": F.ltrim(tail), "from_": F.col("start") + F.col("at_") - 1 + F.col("len_") + skipped})
    others = [c for c in spans.columns if c not in ("label", "start", "end", "span_text")]
    piece = lambda label, s, e, t: F.struct(*others, label.alias("label"), s.cast("long").alias("start"), e.cast("long").alias("end"), t.alias("span_text"))
    whole = piece(F.col("label"), F.col("start"), F.col("end"), F.col("span_text"))
    head = piece(F.col("label"), F.col("start"), F.col("cut_"), F.expr("substring(span_text, 1, at_ - 1)"))
    rest = piece(F.lit("Effect"), F.col("from_"), F.col("end"), F.col("tail_"))
    parts = F.when((F.col("at_") == 0) | (F.col("at_") - 1 < 3), F.array(whole)).when(F.length("tail_") < 3, F.array(head)).otherwise(F.array(head, rest))
    return df.select(F.inline(parts)).select(*spans.columns)


def clip(spans: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of the five labels with bounds moved into the text and slice, what stands there; those that are empty then go."""
    low = lambda x, t: F.least(t.length.cast("long"), F.greatest(F.lit(0).cast("long"), x))
    named = spans.where(F.col("label").isin(*LABELS)).select(key, "label", F.col("start").alias("s_"), F.col("end").alias("e_"))
    body = lambda t, s: t.cut(low(s["s_"], t), low(s["e_"], t) - low(s["s_"], t))
    out = sp.with_pieces(named, docs, {"start": lambda t, s: low(s["s_"], t), "end": lambda t, s: low(s["e_"], t), "slice": body}, key, text)
    return out.where("end > start").select(key, "label", "start", "end", "slice")


def long_enough(spans: DataFrame, least: dict[str, int] | None = None) -> DataFrame:
    """Spans at least as long as their role's least length."""
    table = F.create_map(*(F.lit(x) for kv in (least or LEAST_LENGTHS).items() for x in kv))
    return spans.where(F.col("end") - F.col("start") >= F.coalesce(F.element_at(table, F.col("label")), F.lit(3)))


def overlap_policy(spans: DataFrame, key: str = "doc_id", short: int = 24) -> DataFrame:
    """Per document by (start, longer first): a span that overlaps a kept one in a way that is not allowed takes its place or goes.

    Actor and Victim never overlap, and the Actor stays; a Victim and an Action only if the Victim is inside and at
    most ``short`` long, else the longer stays, of equals the earlier. All other overlaps are allowed. Only the first
    such kept span counts.
    """

    def allowed(a: tuple, b: tuple) -> bool:
        kinds = {a[0], b[0]}
        if kinds == {"Actor", "Victim"}:
            return False
        if kinds == {"Victim", "Action"}:
            v, act = (a, b) if a[0] == "Victim" else (b, a)
            return act[1] <= v[1] and v[2] <= act[2] and v[2] - v[1] <= short
        return True

    def keep(g: dict) -> list[tuple]:
        rows = sorted(zip(g["label"].tolist(), g["start"].tolist(), g["end"].tolist(), strict=True), key=lambda r: (r[1], r[1] - r[2], r[0]))
        done: list[tuple] = []
        live: list[tuple] = []
        for r in rows:
            done += [k for k in live if k[2] <= r[1]]  # nothing later overlaps these
            live = [k for k in live if k[2] > r[1]]
            clash = next((k for k in live if r[1] < k[2] and k[1] < r[2] and not allowed(r, k)), None)
            if clash is not None:
                kinds = (r[0], clash[0])
                stays = kinds == ("Victim", "Actor") or (kinds != ("Actor", "Victim") and r[2] - r[1] <= clash[2] - clash[1])
                if stays:
                    continue
                live.remove(clash)
            live.append(r)
        return sorted(done + live, key=lambda r: (r[1], r[2], r[0]))

    return sp._fold(spans.select(key, "label", "start", "end"), [key], keep, ["start", "end", "label"], f"{key} long, label string, start long, end long")


def validate_and_repair(items: DataFrame, docs: DataFrame, window: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds status, new_start, new_end and slice to predicted spans (key, label, start, end, said): offsets move to where the text they echo
    stands within ``window`` characters, if it does.

    status: badkeys (label not of the five, or no length), oob (outside the text), else ok, or mismatch where the slice
    differs from what was said; snapped tells that offsets moved. The slice of the text counts. Echoes are
    sought as they are, then whatever their case, quotes and white space.
    """
    good = F.col("label").isin(*LABELS) & F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") > F.col("start"))
    rows = items.withColumn("good_", F.coalesce(good, F.lit(False)))
    lo = lambda s: F.greatest(F.lit(0), s["start"] - window).cast("int")
    near = lambda t, s: t.cut(lo(s), F.least(t.length, F.greatest(s["start"], s["end"]) + window) - lo(s))
    got = sp.with_pieces(rows, docs, {"near_": near, "lo_": lambda t, s: lo(s), "n_": lambda t, s: t.length}, key, text)
    said = F.coalesce("said", F.lit(""))
    at = F.instr("near_", said)

    @F.pandas_udf("start long, end long")
    def soft(near_: pd.Series, said_: pd.Series) -> pd.DataFrame:
        from .location import _normal

        out = []
        for a, b in zip(near_, said_, strict=True):
            (t, where), (q, _) = _normal(a or ""), _normal(b or "")
            i = t.find(q) if q else -1
            out.append((where[i], where[i + len(q) - 1] + 1) if i >= 0 else (None, None))
        return pd.DataFrame(out, columns=["start", "end"])

    hard = got.withColumn("at_", F.when((said != "") & F.col("good_"), at).otherwise(-1))
    found = hard.where("at_ <> 0").withColumns({"s_": F.when(F.col("at_") > 0, F.col("lo_") + F.col("at_") - 1).otherwise(F.col("start")).cast("long"), "e_": F.when(F.col("at_") > 0, F.col("lo_") + F.col("at_") - 1 + F.length(said)).otherwise(F.col("end")).cast("long")})
    lost = hard.where("at_ = 0").withColumn("soft_", soft("near_", "said"))
    lost = lost.withColumns({"s_": F.coalesce(F.col("lo_") + F.col("soft_.start"), "start").cast("long"), "e_": F.coalesce(F.col("lo_") + F.col("soft_.end"), "end").cast("long")}).drop("soft_")
    both = found.unionByName(lost)
    inside = (F.col("s_") >= 0) & (F.col("s_") < F.col("e_")) & (F.col("e_") <= F.col("n_"))
    cut = F.substring("near_", (F.col("s_") - F.col("lo_") + 1).cast("int"), (F.col("e_") - F.col("s_")).cast("int"))
    both = both.withColumn("slice", F.when(F.col("good_") & inside, cut))
    status = F.when(~F.col("good_"), "badkeys").when(~inside, "oob").when((said != "") & (said != F.col("slice")), "mismatch").otherwise("ok")
    return both.select(*items.columns, status.alias("status"), F.when(F.col("good_"), F.col("s_")).alias("new_start"), F.when(F.col("good_"), F.col("e_")).alias("new_end"), (F.col("good_") & ((F.col("s_") != F.col("start")) | (F.col("e_") != F.col("end")))).alias("snapped"), "slice")


def hygiene(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans fit for examples: at least two words, no Victim or Effect that is a mere time, no Evidence of two words that is an address or a
    time; of equal texts in a document Evidence stays, else the first."""
    t = F.trim(F.coalesce("span_text", F.lit("")))
    words = F.size(F.filter(F.split(t, r"[ \t\r\n\f\x0B]+"), lambda w: w != ""))
    timed = tx.time_anchor(t)
    bad = (F.col("label").isin("Victim", "Effect") & timed) | ((F.col("label") == "Evidence") & (words <= 2) & (t.rlike(r"https?://|www\.") | timed))
    own = spans.withColumn("text_", t).where((words >= 2) & ~bad)
    first = F.row_number().over(Window.partitionBy(key, "text_").orderBy(F.when(F.col("label") == "Evidence", 0).otherwise(1), "start", "end", "label"))
    return own.withColumn("nth_", first).where("nth_ = 1").drop("nth_", "text_")


def span_scores(spans: DataFrame, verbish: str = VERBISH) -> DataFrame:
    """Adds score: what a span shows of its role. Evidence 2 for each kind; an Action 2 for a verb and 1 for two words; an Effect 2 for a
    purpose and 1 for three words; a Victim 1 for a word for people."""
    t = F.trim("span_text")
    words = F.size(F.split(t, r"[ \t\r\n\f\x0B]+"))
    score = (F.when(F.col("label") == "Evidence", 2 * F.size(tx.evidence_kinds(t)))
             .when(F.col("label") == "Action", F.when(t.rlike(verbish), 2).otherwise(0) + F.when(words >= 2, 1).otherwise(0))
             .when(F.col("label") == "Effect", F.when(tx.starts_purpose(t), 2).otherwise(0) + F.when(words >= 3, 1).otherwise(0))
             .when(F.col("label") == "Victim", t.rlike(r"(?i)(^|[^a-z0-9_])(victim|people|citizens|children|us|we|them)([^a-z0-9_]|$)").cast("int")).otherwise(0))
    return spans.withColumn("score", score.cast("int"))


def prune(spans: DataFrame, k: int, stopwords: tuple[str, ...] = STOPWORDS, key: str = "doc_id") -> DataFrame:
    """Spans for the next stage: at least three characters, not begun with a stop word, no Victim that is money or an abstract; of each
    label the k most salient."""
    t = F.lower(F.trim("span_text"))
    first = F.regexp_extract(t, r"^([a-z0-9_]+|[^a-z0-9_ ])", 1)
    bad = (F.length("span_text") < 3) | (t == "") | first.isin(*stopwords) | ((F.col("label") == "Victim") & (t.rlike(MONEY) | t.isin(*NO_VICTIMS)))
    return sp.cap_per_label(spans.where(~bad), k, [F.desc(sp.salience(F.col("label"), F.col("end") - F.col("start"))), F.col("start"), F.col("end")], key)


def recover(quotes: DataFrame, text: str = "text", quote: str = "quote") -> DataFrame:
    """Adds start, end and how to rows: where the quote stands, else where it does without its first word (leading), else without its last
    (trailing); -1 and missing otherwise."""
    q = F.coalesce(quote, F.lit(""))
    blank = r"[ \t\r\n\f\x0B]+"
    body = F.regexp_replace(q, f"^{blank}|{blank}$", "")
    cut = lambda p: F.when(body.rlike(blank), F.regexp_replace(body, p, "")).otherwise("")
    df = quotes.withColumns({"q0_": q, "q1_": cut(rf"^[^ \t\r\n\f\x0B]+{blank}"), "q2_": cut(rf"{blank}[^ \t\r\n\f\x0B]+$")})
    tries = [locate_plain(F.col(text), F.col(f"q{i}_")) for i in range(3)]
    df = df.withColumns({"a0_": tries[0], "a1_": tries[1], "a2_": tries[2]})
    hit = lambda i: F.col(f"a{i}_") >= 0
    start = F.when(hit(0), F.col("a0_")).when(hit(1), F.col("a1_")).when(hit(2), F.col("a2_")).otherwise(-1)
    length = F.when(hit(0), F.length("q0_")).when(hit(1), F.length("q1_")).when(hit(2), F.length("q2_")).otherwise(0)
    how = F.when(hit(0), "whole").when(hit(1), "leading").when(hit(2), "trailing").otherwise("missing")
    return df.select(*quotes.columns, start.cast("long").alias("start"), (start + length).cast("long").alias("end"), how.alias("how"))


def nth_positions(quotes: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The place of each quote (key, label, quote, nth: a number from 1) in its document: its nth occurrence (of those that do not overlap),
    or the first where there are fewer; quotes that do not occur go. One row for each label and place.

    A document meets its quotes as one array; the nth occurrence is found by going from one to the next.
    """
    step = "aggregate(sequence(1L, s.nth), 0, (at, k) -> if(at < 0, at, coalesce(nullif(locate(s.quote, text_, if(at = 0, 1, at + length(s.quote))), 0), -1)))"
    rows = quotes.where(F.length("quote") > 0).groupBy(key).agg(F.collect_list(F.struct("label", "quote", F.col("nth").cast("long").alias("nth"))).alias("spans_"))
    j = rows.join(docs.select(key, F.col(text).alias("text_")), key)
    made = F.expr(f"transform(spans_, s -> named_struct('label', s.label, 'quote', s.quote, 'at', if({step} > 0, {step}, locate(s.quote, text_))))")
    out = j.select(key, F.inline(made)).where("at > 0")
    return out.select(key, "label", "quote", (F.col("at") - 1).cast("long").alias("start"), (F.col("at") - 1 + F.length("quote")).cast("long").alias("end")).dropDuplicates([key, "label", "start", "end"])


def without_embedded_victims(spans: DataFrame, bare: str, key: str = "doc_id") -> DataFrame:
    """Without Victims of one bare word (a pattern for the whole span) that stand inside an Action."""
    victims = spans.where((F.col("label") == "Victim") & F.trim("span_text").rlike(bare))
    inside = sp.overlap_join(victims.select(key, "start", "end"), spans.where("label = 'Action'").select(key, "start", "end"), [key], "v", "a")
    inside = inside.where("start_a <= start_v and end_v <= end_a").select(key, F.col("start_v").alias("start"), F.col("end_v").alias("end"), F.lit("Victim").alias("label")).distinct()
    return spans.join(inside, [key, "label", "start", "end"], "left_anti")


def violations(spans: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What is wrong with quoted spans (key, label, quote and the text): missing (not in the text, whatever the case) or short (an Action of
    one word)."""
    words = F.size(F.filter(F.split("quote", r"[ \t\r\n\f\x0B]+"), lambda w: w != ""))
    kind = F.when(locate_plain(F.col(text), F.col("quote")) < 0, "missing").when((F.col("label") == "Action") & (words < 2), "short")
    return spans.withColumn("violation", kind).where("violation is not null").select(key, "label", "quote", "violation")


def rich_scores(gold: DataFrame, pred: DataFrame, key: str = "doc_id", beta: float = 2.0, least: float = 0.4) -> DataFrame:
    """F-beta by document with partial credit: each prediction in order of place takes the unmatched gold span that it is most like (IoU
    above 0.3, else the texts' similarity) if at least ``least``.

    A match counts 1 if it is above 0.9 like and of the same label, its similarity if not so near, half of that if of
    another label. Rows: key, label, start, end, span_text. Documents with neither are not there; with one side only, the score is 0.
    """
    both = gold.withColumn("is_gold", F.lit(True)).unionByName(pred.withColumn("is_gold", F.lit(False)))

    def alike(a: tuple, b: tuple) -> float:
        common = max(0, min(a[2], b[2]) - max(a[1], b[1]))
        v = common / ((a[2] - a[1]) + (b[2] - b[1]) - common)
        return v if v > 0.3 else similarity(a[3], b[3])

    def keep(g: dict) -> list[tuple]:
        rows = list(zip(g["label"].tolist(), g["start"].tolist(), g["end"].tolist(), g["span_text"].tolist(), g["is_gold"].tolist(), strict=True))
        want, got = [r for r in rows if r[4]], [r for r in rows if not r[4]]
        used: set[int] = set()
        credit = 0.0
        for p in got:
            best, at = 0.0, -1
            for i, q in enumerate(want):
                if i not in used and (v := alike(p, q)) > best:
                    best, at = v, i
                    if v == 1.0:
                        break
            if best >= least and at >= 0:
                used.add(at)
                credit += (1.0 if best > 0.9 else best) if p[0] == want[at][0] else best * 0.5
        fp, fn = len(got) - len(used), len(want) - len(used)
        p = credit / (credit + fp) if credit + fp > 0 else 0.0
        r = credit / (credit + fn) if credit + fn > 0 else 0.0
        f = (1 + beta**2) * p * r / (beta**2 * p + r) if p + r > 0 else 0.0
        return [(len(want), len(got), len(used), round(credit, 6), round(f, 6))]

    return sp._fold(both.select(key, "label", "start", "end", "span_text", "is_gold"), [key], keep, ["start", "end", "label"], f"{key} long, n_gold long, n_pred long, matched long, credit double, score double")
