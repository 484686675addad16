"""Profiles of documents and groups: descriptions, presence, priors with rates, groups of annotations, runs and windows of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import LABELS
from .statistics import r6

# Word lists and tables of the second document profile and of sources.
HEDGES_2 = ("maybe", "might", "possibly", "seems", "appears", "could", "unsure", "allegedly", "claims", "purportedly", "rumored", "potential", "think", "believe")
EPISTEMIC = ("truth", "lie", "lies", "wake", "awake", "sheep", "realize", "proven", "undeniable", "exposed", "reveal", "hidden", "agenda", "narrative", "mainstream", "msm", "psyop", "shill", "bot")
VAGUE_AGENTS = ("they", "them", "their", "elites", "globalists", "cabal", "powers")
NAMED_AGENTS = ("biden", "trump", "cdc", "fbi", "cia", "fda", "who", "pfizer", "moderna", "putin", "zelensky", "nato", "eu", "china", "russia")
LEADING = ("why is", "why are", "coincidence", "strange", "curious", "how come", "why won't")
PROFILE_2 = {"hedges": HEDGES_2, "epistemic": EPISTEMIC, "vague": VAGUE_AGENTS, "named": NAMED_AGENTS, "leading": LEADING}
HUBS = ("conspiracy", "highstrangeness")
LIKELY_SOURCES = ("conspiracy", "HighStrangeness", "Wuhan_Flu", "LockdownSkepticism")
REPORTING_SOURCES = ("news", "worldnews", "science", "skeptic")


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of a number by group; the quartiles come from counts of each value, interpolated."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    up = Window.partitionBy(*by).orderBy("v")
    ranked = counts.withColumn("upto", F.sum("n").over(up)).withColumns({"all": F.sum("n").over(Window.partitionBy(*by)), "next": F.lead("v").over(up)})
    q = []
    for p in (0.25, 0.5, 0.75):
        at = p * (F.col("all") - 1)
        low, here = F.floor(at), (F.col("upto") > F.floor(at)) & (F.col("upto") - F.col("n") <= F.floor(at))
        after = F.when(F.col("upto") > low + 1, F.col("v")).otherwise(F.coalesce("next", "v"))
        q.append(r6(F.max(F.when(here, F.col("v") + (at - low) * (after - F.col("v"))))).alias(f"q{int(p * 100)}"))
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    out = ranked.groupBy(*by).agg(F.sum("n").alias("count"), r6(mean).alias("mean"), F.min("v").alias("min"), *q, F.max("v").alias("max"))
    std = df.groupBy(*by).agg(r6(F.stddev_samp(value)).alias("std"))
    on = [out[b].eqNullSafe(std[b]) for b in by]
    return out.join(std, on).select(*(out[c] for c in out.columns), "std")


def marker_presence(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (kind, name, docs): documents with each label, with each number of different labels (0 to 5), and with all five."""
    has = spans.groupBy(key).agg(*(F.max((F.col("label") == x).cast("int")).alias(x) for x in LABELS))
    j = docs.select(key).join(has, key, "left").select(key, *(F.coalesce(x, F.lit(0)).alias(x) for x in LABELS))
    n = sum((F.col(x) for x in LABELS[1:]), F.col(LABELS[0]))
    sums = j.groupBy(n.alias("n")).agg(F.count("*").alias("docs"), *(F.sum(x).alias(x) for x in LABELS))
    label = sums.select(F.inline(F.array(*(F.struct(F.lit("label").alias("kind"), F.lit(x).alias("name"), F.col(x).alias("docs")) for x in LABELS)))).groupBy("kind", "name").agg(F.sum("docs").alias("docs"))
    types = sums.select(F.lit("types").alias("kind"), F.col("n").cast("string").alias("name"), "docs")
    every = sums.agg(F.coalesce(F.sum(F.when(F.col("n") == len(LABELS), F.col("docs"))), F.lit(0)).alias("docs")).select(F.lit("all").alias("kind"), F.lit("five").alias("name"), "docs")
    return label.unionByName(types).unionByName(every)


def fold_pivot(df: DataFrame, labels: tuple[str, ...], fold: str = "fold", label: str = "doc_label") -> DataFrame:
    """Rows of each fold by label, in columns."""
    return df.groupBy(fold).pivot(label, list(labels)).count().select(fold, *(F.coalesce(x, F.lit(0)).alias(x) for x in labels))


def priors_with_rates(spans: DataFrame, lengths: DataFrame, key: str = "doc_id") -> DataFrame:
    """By label, over spans that are not empty in texts that are not: the logarithmic length's mean and deviation, the start's beta
    parameters, the 90 % length cut to a whole number, spans per document of the table, and per document with spans."""
    j = spans.join(lengths, key).where((F.col("end") > F.col("start")) & (F.col("n_text") > 0))
    n, x = F.col("end") - F.col("start"), F.col("start") / F.col("n_text")
    docs = lengths.agg(F.greatest(F.lit(1), F.count("*")).alias("docs"))
    counts = j.groupBy("label", n.alias("len")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("label").orderBy("len")
    counts = counts.withColumns({"upto": F.sum("n").over(up), "next": F.lead("len").over(up)}).withColumn("all", F.sum("n").over(Window.partitionBy("label")))
    at = 0.9 * (F.col("all") - 1)
    low = F.floor(at)
    after = F.when(F.col("upto") > low + 1, F.col("len")).otherwise(F.coalesce("next", "len"))
    q90 = counts.where((F.col("upto") > low) & (F.col("upto") - F.col("n") <= low)).select("label", F.floor(F.col("len") + (at - low) * (after - F.col("len")) + 1e-9).cast("long").alias("q90"))
    m, v = F.avg(x), F.greatest(F.var_samp(x), F.lit(1e-6))
    sd = F.stddev_samp(F.ln(n))
    stats = j.groupBy("label").agg(r6(F.avg(F.ln(n))).alias("mu"), r6(F.when(sd == 0, 1.0).otherwise(sd)).alias("sigma"), m.alias("m"), v.alias("v"), F.count("*").alias("n"), F.countDistinct(key).alias("with"))
    k = F.col("m") * (1 - F.col("m")) / F.col("v") - 1
    out = stats.join(F.broadcast(docs)).join(q90, "label")
    return out.select("label", "mu", "sigma", r6(F.greatest(F.lit(0.5), F.col("m") * k)).alias("alpha"), r6(F.greatest(F.lit(0.5), (1 - F.col("m")) * k)).alias("beta"), "q90", r6(F.col("n") / F.col("docs")).alias("spans_per_doc"), r6(F.col("n") / F.col("with")).alias("spans_per_doc_with"))


def document_groups(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document from annotators' rows (key, annotator, text, source, label, spans: array of label, start, end).

    label is the commonest; documents whose commonest label is DROP_ME, or that have two equally common, go. Text and
    source are the first annotator's. spans are those that at least half of the annotators marked alike, in order;
    has_conflict tells that there were spans and none stayed.
    """
    votes = rows.groupBy(key, "label").agg(F.count("*").alias("n"))
    best = votes.groupBy(key).agg(F.max(F.struct("n", "label")).alias("top"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    won = best.where((F.size("ns") == 1) | (F.col("ns")[0] > F.col("ns")[1])).select(key, F.col("top.label").alias("label")).where("label <> 'DROP_ME'")
    base = rows.groupBy(key).agg(F.min_by("text", "annotator").alias("text"), F.min_by("source", "annotator").alias("source"), F.count("*").alias("raters"), F.sum(F.size("spans")).alias("raw"))
    marks = rows.select(key, "annotator", F.explode("spans").alias("s")).groupBy(key, "s").agg(F.countDistinct("annotator").alias("votes"))
    kept = marks.join(base.select(key, "raters"), key).where(F.col("votes") * 2 >= F.col("raters")).groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("spans"))
    out = won.join(base, key).join(kept, key, "left").withColumn("spans", F.coalesce("spans", F.expr("array()").cast(rows.schema["spans"].dataType)))
    return out.select(key, "text", "source", "label", "spans", ((F.col("raw") > 0) & (F.size("spans") == 0)).alias("has_conflict"))


def token_runs(tokens: DataFrame, wanted: Column, score: Column, key: str = "doc_id") -> DataFrame:
    """Runs of neighbouring tokens (key, i, tok, s) that are wanted, as spans: start of the first to end of the last, how many, and their
    mean score."""
    kept = tokens.where(wanted).withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy("i")))
    return kept.groupBy(key, "island").agg(F.min("s").alias("start"), F.max(F.col("s") + F.length("tok")).alias("end"), F.count("*").cast("int").alias("n"), r6(F.avg(score)).alias("score")).drop("island")


def context_windows(spans: DataFrame, tokens: DataFrame, docs: DataFrame, width: int = 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds window: the tokens up to ``width`` on either side of the one at the span's centre (the last that starts at or before it), joined
    by blanks.

    Spans and tokens of a document go by place once; a text is cut where its spans are, as one array.
    """
    centre = (F.col("start") + F.col("end")) / 2
    cols = [c for c in spans.columns if c != key]
    marks = spans.select(key, centre.alias("p"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("i"), F.struct(*cols).alias("span"))
    marks = marks.unionByName(tokens.select(key, F.col("s").cast("double").alias("p"), F.lit(0).alias("kind"), F.col("i").cast("int").alias("i"), F.lit(None).cast(marks.schema["span"].dataType).alias("span")))
    last = F.last("i", ignorenulls=True).over(Window.partitionBy(key).orderBy("p", "kind").rowsBetween(Window.unboundedPreceding, 0))
    at = marks.withColumn("at", F.coalesce(last, F.lit(0))).where("kind = 1").groupBy(key).agg(F.collect_list(F.struct("at", "span")).alias("spans"))
    j = at.join(docs.select(key, F.split(text, " ").alias("toks")), key)
    lo = lambda a: F.greatest(F.lit(0), a - width)
    cut = F.transform("spans", lambda x: F.struct(*(x["span"][c].alias(c) for c in cols), F.array_join(F.slice(F.col("toks"), lo(x["at"]) + 1, x["at"] + width + 1 - lo(x["at"])), " ").alias("window")))
    return j.select(key, F.inline(cut))


def source_prior(c: Column) -> Column:
    """What a source's name says beforehand: hub, and its zone."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("Unknown")), "^r/", "")
    hub = F.when(F.lower(plain).isin(*HUBS), "Conspiracy Hub").otherwise("Mainstream/Neutral")
    zone = F.when(plain.isin(*LIKELY_SOURCES), "conspiracy").when(plain.isin(*REPORTING_SOURCES), "reporting").otherwise("unknown")
    return F.struct(hub.alias("hub"), zone.alias("zone"))


def on_domain(c: Column, cues: tuple[str, ...], short: int = 220) -> Column:
    """Whether a text has any of the cues, or is short."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hit = F.length(low) <= short
    for cue in cues:
        hit = hit | F.contains(low, F.lit(cue))
    return hit


def forensic_profile(df: DataFrame, lists: dict[str, tuple[str, ...]] | None = None, text: str = "text") -> DataFrame:
    """Adds uncertainty_ratio, question_density, is_jaqing, agency_gap, epistemic_intensity and shouting_score, to two digits.

    Words are what is between ASCII white space. A leading question is a part before, between or behind question marks that has a leading phrase.
    """
    lists = PROFILE_2 | (lists or {})
    c = F.coalesce(text, F.lit(""))
    low = F.lower(c)
    words = lambda x: F.filter(F.split(x, r"[ \t\r\n\f\x0B]+"), lambda w: w != "")
    df = df.withColumns({"raw_": words(c), "low_": words(low)})
    n = F.greatest(F.size("raw_"), F.lit(1))
    count = lambda k: F.size(F.filter("low_", lambda w: w.isin(*lists[k])))
    marks = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    leading = F.lit(False)
    for m in lists["leading"]:
        leading = leading | F.contains(low, F.lit(m))
    caps = F.size(F.filter("raw_", lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)))
    r2 = lambda x: F.round(x, 2)
    return df.withColumns({
        "uncertainty_ratio": r2(count("hedges") / F.greatest(F.lit(1.0), n * 0.05)), "question_density": r2(marks("?") / F.greatest(F.lit(1), marks(".") + marks("!") + marks("?"))),
        "is_jaqing": leading, "agency_gap": r2(count("vague") / (count("named") + 1)), "epistemic_intensity": r2(count("epistemic") / n * 100), "shouting_score": r2(caps / n * 100),
    }).drop("raw_", "low_")


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each combination of ``by``."""
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("nth_ = 1").drop("nth_")


def dedup_by_id_then_text(df: DataFrame, norm: Column, order: list[Column], key: str = "doc_id") -> DataFrame:
    """The first row of each id and normalised text, and of these the first of each normalised text."""
    own = df.withColumn("norm_", norm)
    return first_of(first_of(own, [key, "norm_"], order), ["norm_"], order).drop("norm_")


def hard_score(df: DataFrame, reasons: Column, pairs: Column, n_spans: Column, n_labels: Column, label: str = "doc_label", text: str = "text") -> DataFrame:
    """Adds score: 10 for each reason, 15 for each kind of high overlap, 10 for a clear label, 2 for each span up to five, 3 for each label,
    5 for a length of 201 to 599, less 10 outside 160 to 800."""
    n = F.length(text)
    fit = F.when((n > 200) & (n < 600), 5).when((n < 160) | (n > 800), -10).otherwise(0)
    clear = F.when(F.col(label).isin("conspiracy", "non"), 10).otherwise(0)
    return df.withColumn("score", (10 * reasons + 15 * pairs + clear + 2 * F.least(n_spans, F.lit(5)) + 3 * n_labels + fit).cast("int"))
