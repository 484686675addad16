"""Corpus statistics over documents and spans."""

from __future__ import annotations

import bisect
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import LABELS
from ..functions.text import cue_words, lexicon_count, ngrams
from .ranks import quantiles, sums_before, value_counts
from .spans import overlap_join, self_overlaps, with_pieces
from .staging import small_batches


def r6(c: Column) -> Column:
    return F.round(c, 6)


def label_shares(df: DataFrame, label: str = "doc_label") -> DataFrame:
    """Rows and share of each label, null as a label."""
    return df.groupBy(label).agg(F.count("*").alias("n")).withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))


def drift(before: DataFrame, after: DataFrame, label: str = "doc_label") -> DataFrame:
    """Label shares before and after a step."""
    return label_shares(before, label).withColumn("phase", F.lit("before")).unionByName(label_shares(after, label).withColumn("phase", F.lit("after")))


def length_profile(docs: DataFrame, low: int, high: int, text: str = "text") -> DataFrame:
    n = F.length(text)
    q = quantiles(value_counts(docs, [], n), [], {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90)})
    means = docs.agg(F.count("*").alias("n"), r6(F.avg(n)).alias("mean"), r6(F.avg((n < low).cast("double"))).alias("below"), r6(F.avg((n > high).cast("double"))).alias("above"))
    both = means.join(F.broadcast(q))  # one row each
    return both.select("n", "mean", *(F.floor(f"p{p}").cast("long").alias(f"p{p}") for p in (10, 25, 50, 75, 90)), "below", "above")


def length_bucket(text: str = "text") -> Column:
    n = F.length(text)
    return F.when(n < 500, "short").when(n < 2000, "medium").otherwise("long")


def bucket_crosstab(df: DataFrame, labels: tuple[str, ...], text: str = "text", label: str = "doc_label") -> DataFrame:
    """Rows are length buckets, columns the share of each label in them."""
    wide = df.groupBy(length_bucket(text).alias("bucket")).pivot(label, list(labels)).count()
    total = sum((F.coalesce(c, F.lit(0)) for c in labels[1:]), F.coalesce(labels[0], F.lit(0)))
    return wide.select("bucket", *(r6(F.coalesce(c, F.lit(0)) / total).alias(c) for c in labels))


def source_crosstab(df: DataFrame, k: int, labels: tuple[str, ...], source: str = "source", label: str = "doc_label") -> DataFrame:
    """Counts by label of the k commonest sources (of equals the lesser name)."""
    wide = df.groupBy(source).pivot(label, list(labels)).count().na.fill(0, list(labels))
    total = sum((F.col(c) for c in labels[1:]), F.col(labels[0]))
    return wide.withColumn("n", total).orderBy(F.desc("n"), source).limit(k)


def marker_counts(spans: DataFrame) -> DataFrame:
    """Spans per label, 0 for labels without any, and the weight 1/sqrt(n)."""
    dim = spans.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    n = F.coalesce("n", F.lit(0))
    return dim.join(spans.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", n.alias("n"), r6(F.when(n > 0, 1 / F.sqrt(n)).otherwise(0.0)).alias("weight"))


def span_quantile(spans: DataFrame, p: float = 0.9) -> DataFrame:
    """The p-quantile of span lengths by label, rounded half to even."""
    q = quantiles(value_counts(spans, ["label"], F.col("end") - F.col("start")), ["label"], {"q": p})
    return q.select("label", F.bround("q", 0).cast("long").alias("q"))


def length_priors(spans: DataFrame) -> DataFrame:
    """mu and sigma of the logarithm of span lengths by label; (0, 1) for fewer than 5 spans, sigma 1 where it is 0."""
    x = F.ln(F.col("end") - F.col("start"))
    s = F.stddev_samp(x)
    few = F.count(x) < 5
    return spans.where("end > start").groupBy("label").agg(r6(F.when(few, 0.0).otherwise(F.avg(x))).alias("mu"), r6(F.when(few | (s == 0), 1.0).otherwise(s)).alias("sigma"), F.count("*").alias("n"))


def position_priors(spans: DataFrame, lengths: DataFrame, key: str = "doc_id") -> DataFrame:
    """Beta distribution of the relative start by label, by moments; (1, 1) for fewer than 5 spans, parameters at least 0.5."""
    x = F.col("start") / F.col("n_text")
    got = spans.join(lengths, key).where("n_text > 0").withColumn("x", x).where("x between 0 and 1").groupBy("label").agg(F.avg("x").alias("m"), F.greatest(F.var_samp("x"), F.lit(1e-6)).alias("v"), F.count("*").alias("n"))
    common = F.col("m") * (1 - F.col("m")) / F.col("v") - 1
    few = F.col("n") < 5
    return got.select("label", *(r6(F.when(few, 1.0).otherwise(F.greatest(F.lit(0.5), p * common))).alias(k) for k, p in (("alpha", F.col("m")), ("beta", 1 - F.col("m")))))


def label_coverage(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """By label: the share of documents with any span that have one of it, and the mean spans of those that have."""
    per = spans.groupBy(key, "label").agg(F.count("*").alias("n"))
    total = spans.agg(F.countDistinct(key).alias("docs"))
    return per.groupBy("label").agg(F.count("*").alias("with_label"), r6(F.avg("n")).alias("spans_per_doc")).join(F.broadcast(total)).select("label", r6(F.col("with_label") / F.col("docs")).alias("coverage"), "spans_per_doc")


def first_occurrence(spans: DataFrame, lengths: DataFrame, key: str = "doc_id") -> DataFrame:
    """Quantiles by label of the relative place of a document's first span."""
    first = spans.groupBy(key, "label").agg(F.min("start").alias("s")).join(lengths, key).where("n_text > 0")
    q = (0.1, 0.25, 0.5, 0.75, 0.9)
    got = quantiles(value_counts(first, ["label"], F.col("s") / F.col("n_text")), ["label"], {f"q{int(p * 100)}": p for p in q})
    return got.select("label", *(r6(F.col(c)).alias(c) for c in got.columns if c != "label"))


def offset_integrity(spans: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans in all, inside their text, and with more than white space."""
    body = lambda t, s: F.trim(t.cut(s["start"], s["end"] - s["start"])) != ""
    j = with_pieces(spans, docs, {"n_text": lambda t, s: t.length, "filled": body}, key)
    ok = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("n_text"))
    return j.agg(F.count("*").alias("total"), F.count_if(ok).alias("in_bounds"), F.count_if(ok & F.col("filled")).alias("with_text"))


def offset_rates(spans: DataFrame, docs: DataFrame, said: str = "span_text", key: str = "doc_id") -> DataFrame:
    """One row: how many spans there are, lie within their text, and read there what they say; and the shares (0 without spans)."""
    body = lambda t, s: t.cut(s["start"], s["end"] - s["start"])
    j = with_pieces(spans.select(key, "start", "end", said), docs, {"n_text": lambda t, s: t.length, "there": body}, key)
    ok = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("n_text"))
    n = j.agg(F.count("*").alias("total"), F.count_if(ok).alias("in_bounds"), F.count_if(ok & (F.col("there") == F.col(said))).alias("exact"))
    rate = lambda c: F.round(F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0), 6)
    return n.select("total", "in_bounds", "exact", rate("in_bounds").alias("in_bounds_rate"), rate("exact").alias("exact_rate"))


def overlap_pairs(spans: DataFrame) -> DataFrame:
    """Overlapping pairs of different labels with the pair's name, iou and order."""
    p = self_overlaps(spans).where("label_a <> label_b")
    return p.select("doc_id", F.concat_ws("/", F.least("label_a", "label_b"), F.greatest("label_a", "label_b")).alias("pair"), "iou", (F.col("start_a") < F.col("start_b")).alias("starts_first"),
                    (((F.col("start_a") <= F.col("start_b")) & (F.col("end_b") <= F.col("end_a"))) | ((F.col("start_b") <= F.col("start_a")) & (F.col("end_a") <= F.col("end_b")))).alias("contain"))


def overlap_pair_stats(pairs: DataFrame) -> DataFrame:
    """By pair of labels: how many, mean and median IoU, shares of high ones, and how often the first label starts first or one span holds
    the other. All come from counts of each IoU."""
    counts = value_counts(pairs, ["pair"], F.col("iou"), first=F.col("starts_first").cast("long"), held=F.col("contain").cast("long"))
    n = F.sum("n")
    share = lambda c: r6(F.sum(c) / n)
    over = lambda least: F.when(F.col("value") >= least, F.col("n")).otherwise(0)
    stats = counts.groupBy("pair").agg(n.alias("n"), share(F.col("value") * F.col("n")).alias("mean_iou"), share(over(0.1)).alias("iou_10"), share(over(0.5)).alias("iou_50"), share(F.col("first")).alias("starts_first_rate"), share(F.col("held")).alias("contain_rate"))
    return stats.join(quantiles(counts, ["pair"], {"median": 0.5}), "pair").select("pair", "n", "mean_iou", r6(F.col("median")).alias("median_iou"), "iou_10", "iou_50", "starts_first_rate", "contain_rate")


def overlap_doc_level(pairs: DataFrame) -> DataFrame:
    """Means over documents of each document's mean."""
    per = pairs.groupBy("doc_id", "pair").agg(F.avg("iou").alias("m"), F.avg(F.col("contain").cast("double")).alias("c"))
    return per.groupBy("pair").agg(F.count("*").alias("docs"), r6(F.avg("m")).alias("mean_iou"), r6(F.avg("c")).alias("contain_rate"))


def doc_overlap_profile(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """For every document: spans, overlapping pairs, nested ones and those of one label."""
    p = self_overlaps(spans)
    nested = ((F.col("start_a") <= F.col("start_b")) & (F.col("end_b") <= F.col("end_a"))) | ((F.col("start_b") <= F.col("start_a")) & (F.col("end_a") <= F.col("end_b")))
    per = p.groupBy("doc_id").agg(F.count("*").alias("n_overlap"), F.count_if(nested).alias("n_nested"), F.count_if(F.col("label_a") == F.col("label_b")).alias("n_same"))
    n = spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return docs.select("doc_id").join(n, "doc_id", "left").join(per, "doc_id", "left").select("doc_id", *map(zero, ("n_spans", "n_overlap", "n_nested", "n_same")))


def max_pair_iou(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """The highest IoU of a span of left and one of right in each document that has overlapping ones."""
    from ..functions.spans import iou

    p = overlap_join(left, right, [key])
    return p.groupBy(key).agg(r6(F.max(iou(F.col("start_a"), F.col("end_a"), F.col("start_b"), F.col("end_b")))).alias("max_iou"))


_BESIDE_KINDS = ("char_before", "char_after", "word_before", "word_after", "words_before", "words_after")


def _beside(text: str, places: list[tuple[str, int, int]], reach: int | None) -> Counter:
    """How often each (label, kind, value) stands beside the places (label, start, end) of a text. Its words are found once, by one scan."""
    low = text.replace("\u0130", "i").lower()  # the one letter that lower() makes two of
    begins, ends = [], []
    for m in re.finditer("[a-z0-9_]+", low):
        begins.append(m.start())
        ends.append(m.end())
    counts: Counter = Counter()
    for label, s, e in places:
        s, e = min(max(s, 0), len(low)), max(e, 0)
        lo, hi = (0, len(low)) if reach is None else (max(0, s - reach), e + reach)
        k = bisect.bisect_left(begins, s) - 1
        back = [low[max(begins[j], lo) : min(ends[j], s)] for j in (k - 1, k) if j >= 0 and ends[j] > lo]
        k = bisect.bisect_right(ends, e)
        ahead = [low[max(begins[j], e) : min(ends[j], hi)] for j in (k, k + 1) if j < len(ends) and begins[j] < hi]
        pair = lambda w: " ".join(w) if len(w) == 2 else ""
        values = (text[max(0, s - 5) : s], text[e : e + 5], back[-1] if back else "", ahead[0] if ahead else "", pair(back), pair(ahead))
        counts.update((label, kind, v) for kind, v in zip(_BESIDE_KINDS, values, strict=True) if v)
    return counts


def boundary_context(spans: DataFrame, docs: DataFrame, k: int = 25, key: str = "doc_id", text: str = "text", reach: int | None = None) -> DataFrame:
    """By label: the k commonest five characters, single words and pairs of words before and after spans (of equals the lesser).

    Words are those of the whole text cut at the span, or with ``reach`` of so many characters beside it. A text is scanned once for all of
    its spans; what a task counts of it leaves as counts.
    """
    small_batches(docs.sparkSession)

    def told(found: Counter) -> pa.RecordBatch:
        labels, kinds, values = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(found.values(), pa.int64())], names=["label", "kind", "value", "n"])

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found.update(_beside(row["text_"], [(p["label"], p["start"], p["end"]) for p in row["places_"] if p["start"] is not None and p["end"] is not None], reach))
                if len(found) > 50_000:
                    yield told(found)
                    found = Counter()
        yield told(found)

    places = spans.groupBy(key).agg(F.collect_list(F.struct("label", "start", "end")).alias("places_"))
    beside = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text_")).join(places, key).select("text_", "places_")
    counts = beside.mapInArrow(run, "label string, kind string, value string, n long").groupBy("label", "kind", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("label", "kind").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lexicon_rates(df: DataFrame, terms: dict[str, tuple[str, ...]], by: str = "doc_label", text: str = "text") -> DataFrame:
    """Occurrences of each list's terms per 1000 characters: mean, median and deviation by label."""
    rate = [F.struct(F.lit(k).alias("metric"), (lexicon_count(F.col(text), t) * 1000.0 / F.greatest(F.length(text), F.lit(1))).alias("rate")) for k, t in terms.items()]
    counts = value_counts(df.select(by, F.inline(F.array(*rate))), ["metric", by], F.col("rate"))
    total = counts.groupBy("metric", by).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("all"))
    medians = quantiles(counts, ["metric", by], {"median": 0.5})
    named = lambda right, *names: right.toDF("metric_", "by_", *names)
    on = (F.col("metric") == F.col("metric_")) & F.col(by).eqNullSafe(F.col("by_"))
    around = counts.join(named(total, "mean", "all"), on).select("metric", by, "mean", "all", (F.col("n") * (F.col("value") - F.col("mean")) ** 2).alias("away"))
    stats = around.groupBy("metric", by, "mean", "all").agg(F.when(F.col("all") > 1, F.sqrt(F.sum("away") / (F.col("all") - 1))).alias("std"))
    both = stats.join(named(medians, "median"), on)
    return both.select("metric", by, F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("std", 4).alias("std"), F.col("all").alias("n"))


def group_means(df: DataFrame, value: Column, by: list[str], least: int, key: str = "doc_id") -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(key).alias("docs"), F.round(F.avg(value), 4).alias("mean")).where(F.col("docs") >= least)


def label_entropy(df: DataFrame, by: str = "source", label: str = "doc_label") -> DataFrame:
    """Entropy in bits of the labels of each group."""
    n = df.groupBy(by, label).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(by))
    return n.withColumn("p", p).groupBy(by).agg(F.sum("n").alias("n"), r6(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def mann_whitney(df: DataFrame, value: str, group: str, a: str, b: str, key: str = "metric") -> DataFrame:
    """By metric: U of group a against b by mid-ranks, Cliff's delta, and the sizes.

    Values are counted first, so ranks need one row per different value and not an order of all rows.
    """
    per = _rank_sums(df, value, group, a, b, key)
    return per.select(key, r6(F.col("u")).alias("u"), r6(2 * F.col("u") / (F.col("na") * F.col("nb")) - 1).alias("cliffs_delta"), "na", "nb")


def _rank_sums(df: DataFrame, value: str, group: str, a: str, b: str, key: str) -> DataFrame:
    """By metric: u, the sizes, and ties, the sum of t**3 - t over the values, each met t times."""
    n = df.where(F.col(group).isin(a, b)).groupBy(key, value).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    t = (F.col("na") + F.col("nb")).cast("double")
    return sums_before(n, [key], value, {"below": F.col("nb")}).groupBy(key).agg(F.sum(F.col("na") * (F.col("below") + F.col("nb") / 2)).alias("u"), F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum(t * t * t - t).alias("ties"))


def mann_whitney_p(df: DataFrame, value: str, group: str, a: str, b: str, key: str = "metric") -> DataFrame:
    """mann_whitney() with p: two-sided, by the normal approximation with corrections for ties and continuity; 1 where all values are equal.
    The error function is a rational approximation (Abramowitz and Stegun 7.1.26, within 1.5e-7)."""
    per = _rank_sums(df, value, group, a, b, key)
    na, nb, n = F.col("na"), F.col("nb"), F.col("na") + F.col("nb")
    spread = F.sqrt(na * nb / 12 * ((n + 1) - F.col("ties") / F.greatest(n * (n - 1), F.lit(1))))
    far = F.greatest(F.abs(F.col("u") - na * nb / 2) - 0.5, F.lit(0.0))
    x = F.when(spread > 0, far / spread / F.sqrt(F.lit(2.0))).otherwise(0.0)
    t = 1 / (1 + 0.3275911 * x)
    tail = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return per.select(key, r6(F.col("u")).alias("u"), r6(2 * F.col("u") / (na * nb) - 1).alias("cliffs_delta"), "na", "nb", F.round(F.least(tail, F.lit(1.0)), 6).alias("p"))


def benjamini_hochberg(df: DataFrame, p: str = "p") -> DataFrame:
    """Adjusted p values of a table of tests (small: one row per test)."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(p))
    ranked = df.withColumns({"_n": n, "_rank": rank})
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("p_bh", r6(F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(w)))).drop("_n", "_rank")


def ngram_log_odds(df: DataFrame, n: int, k: int, a: str, b: str, alpha: float = 0.01, text: str = "text", label: str = "doc_label") -> DataFrame:
    """Smoothed log-odds of word n-grams between two classes: the k highest and the k lowest."""
    tokens = df.where(F.col(label).isin(a, b)).select(label, cue_words(F.col(text)).alias("_tokens"))
    grams = tokens.select(label, F.explode(ngrams(F.col("_tokens"), n)).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count_if(F.col(label) == a).alias("na"), F.count_if(F.col(label) == b).alias("nb"))
    totals = counts.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.count("*").alias("v"))
    odds = lambda c, t: F.log((F.col(c) + alpha) / (F.col(t) + alpha * F.col("v") - F.col(c) - alpha))
    scored = counts.join(F.broadcast(totals)).select("gram", "na", "nb", r6(odds("na", "ta") - odds("nb", "tb")).alias("log_odds"))
    top = scored.orderBy(F.desc("log_odds"), "gram").limit(k).withColumn("side", F.lit(a))
    return top.unionByName(scored.orderBy("log_odds", "gram").limit(k).withColumn("side", F.lit(b)))


def tfidf(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """TF-IDF weights, ln((1+n)/(1+df))+1, of length 1 per document, for words of at least ``least`` documents."""
    tf = docs.select(key, F.explode(cue_words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    n = docs.agg(F.count("*").alias("n"))
    raw = tf.join(df, "term").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", r6(F.col("w") / F.col("norm")).alias("weight"))
