"""Projections and filters that bring annotation records into one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.lexicons import DOC_LABELS, ID_KEYS, LABEL_KEYS, LABELS, MARKER_ALIASES, SOURCE_KEYS, STRICT_LABELS, TEXT_KEYS
from .ranks import sums_before
from .staging import staged


def _have(df: DataFrame, keys: tuple[str, ...]) -> list[Column]:
    return [F.col(k) for k in keys if k in df.columns]


def harmonise(records: DataFrame) -> DataFrame:
    """doc_id, subreddit, text and doc_label from whichever of the known keys a record has; other columns go.

    Of several keys the first that is not null counts (for text: not blank). Labels outside the table are null.
    """
    cols = {k: _have(records, keys) or [F.lit(None).cast("string")] for k, keys in (("doc_id", ID_KEYS), ("subreddit", SOURCE_KEYS), ("text", TEXT_KEYS), ("doc_label", LABEL_KEYS))}
    return records.select(
        F.coalesce(*(c.cast("string") for c in cols["doc_id"])).alias("doc_id"), F.coalesce(*cols["subreddit"]).alias("subreddit"),
        tx.first_filled(*cols["text"]).alias("text"), tx.doc_label(F.coalesce(*(c.cast("string") for c in cols["doc_label"])), DOC_LABELS).alias("doc_label"))


def label_value(records: DataFrame) -> Column:
    """The document label of the first of the known keys that a record has; of a struct its label, or else its value. Labels outside the
    table are null."""
    found = []
    for k in LABEL_KEYS:
        if k in records.columns:
            kind = records.schema[k].dataType
            if isinstance(kind, T.StructType):
                # An empty label counts as none, as a null does.
                parts = [F.nullif(F.col(k)[f].cast("string"), F.lit("")) for f in ("label", "value") if f in kind.fieldNames()]
                found.append(F.coalesce(*parts) if parts else F.lit(None).cast("string"))
            else:
                found.append(F.col(k).cast("string"))
    return tx.doc_label(F.coalesce(*found) if found else F.lit(None).cast("string"), DOC_LABELS)


def strict_label(c: Column) -> Column:
    return tx.lookup(c, STRICT_LABELS, "DROP_ME")


def unique_by_id(df: DataFrame, key: str = "doc_id", *order: Column) -> DataFrame:
    """One row per id, the first by the given order."""
    (n,) = ("_nth",)
    by = Window.partitionBy(key).orderBy(*(order or [F.col(c) for c in df.columns if c != key]))
    return df.withColumn(n, F.row_number().over(by)).where(f"{n} = 1").drop(n)


def fill_ids(df: DataFrame, name: str, order: list[Column], key: str = "doc_id") -> DataFrame:
    """Ids '<name>_doc_<7 digits>' by row number in the given order for rows without one.

    Rows are sorted in ranges and numbered within theirs, so that no task has all; the driver adds up a number for each range.
    """
    at, part, first = "_at", "_part", "_first"
    fixed = staged(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    parted = fixed.withColumn(part, F.shiftrightunsigned(at, 33))
    counts = sorted((r[part], r["count"]) for r in parted.groupBy(part).count().collect())  # a row for each range
    sums, total = [], 0
    for p, n in counts:
        sums.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(sums, f"{part} long, {first} long")
    nth = F.col(first) + F.col(at).bitwiseAND((1 << 33) - 1)
    out = parted.join(F.broadcast(starts), part).withColumn(key, F.coalesce(F.col(key).cast("string"), F.concat(F.lit(f"{name}_doc_"), F.lpad(nth.cast("string"), 7, "0"))))
    return out.select(*df.columns)


def markers(c: Column, drop_bad: bool = True) -> Column:
    """An array of spans of any spelling as (label, start, end, text): labels brought to the five, offsets cast; spans with an unknown label
    go, and those with bad offsets if drop_bad."""
    norm = F.transform(c, lambda m: F.struct(tx.lookup(F.lower(F.trim(m["type"])), MARKER_ALIASES).alias("label"), m["startIndex"].try_cast("int").alias("start"), m["endIndex"].try_cast("int").alias("end"), m["text"].alias("text")))
    keep = lambda m: m["label"].isin(*LABELS) & (m["start"].isNotNull() & m["end"].isNotNull() if drop_bad else F.lit(True))
    return F.filter(norm, keep)


def span_records(markers: Column, prediction_spans: Column, prediction: Column) -> Column:
    """The spans of a record, whichever of the three arrays (label, type, start, startIndex, end, endIndex, text, score) it has first, as
    (label, start, end, text, score); spans without a label or an offset go. An offset of 0 is one."""
    norm = F.transform(F.coalesce(markers, prediction_spans, prediction), lambda m: F.struct(
        F.coalesce(m["label"], m["type"]).alias("label"), F.coalesce(m["start"], m["startIndex"]).alias("start"), F.coalesce(m["end"], m["endIndex"]).alias("end"), m["text"].alias("text"), m["score"].alias("score")))
    return F.filter(norm, lambda m: m["label"].isNotNull() & m["start"].isNotNull() & m["end"].isNotNull())


def few_shot_entries(docs: DataFrame, text: str = "text", spans: str = "spans", label: str = "doc_label") -> DataFrame:
    """Examples for both tasks, with kind: s1 for texts that are not blank, whatever their spans; s2 for those of the two classes. Texts are
    trimmed, and spans (label, start, end) cut to them; those under three characters go."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    low = lambda x: F.least(F.greatest(x, F.lit(0)), F.length(t))
    cut = F.filter(F.transform(F.col(spans), lambda m: F.struct(m["label"].alias("label"), low(m["start"]).alias("start"), F.greatest(low(m["start"]), low(m["end"])).alias("end"))), lambda m: m["label"].isin(*LABELS) & (m["end"] - m["start"] >= 3))
    good = docs.withColumn(text, t).where(F.col(text) != "").withColumn(spans, F.coalesce(cut, F.col(spans)))
    both = good.withColumn("kind", F.explode(F.array(F.lit("s1"), F.lit("s2"))))
    return both.where((F.col("kind") == "s1") | F.col(label).isin("conspiracy", "non"))


def explode_markers(df: DataFrame, column: str = "markers", key: str = "doc_id") -> DataFrame:
    return df.select(key, F.inline(column)).withColumn("text_len", F.length("text"))


def docclf_view(df: DataFrame) -> DataFrame:
    """Without documents that annotators could not tell; labels as Yes and No."""
    return df.where(F.col("doc_label").isin("conspiracy", "non")).withColumn("verdict", tx.yes_no(F.col("doc_label")))


def resume(df: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose id is not done yet."""
    return df.join(done.select(key), key, "left_anti")


def gate_by_probability(df: DataFrame, probs: DataFrame, threshold: float, key: str = "doc_id") -> DataFrame:
    """Rows whose probability is above the threshold, or unknown."""
    return df.join(probs.select(key, "prob"), key, "left").where(F.coalesce(F.col("prob") > threshold, F.lit(True)))


def safe_list_gate(df: DataFrame, words: tuple[str, ...], unless: str, text: str = "text") -> DataFrame:
    """Without rows that have one of the words and lack ``unless``."""
    low = F.lower(text)
    has = F.lit(False)
    for w in words:
        has = has | F.contains(low, F.lit(w))
    return df.where(~has | F.contains(low, F.lit(unless)))


def assert_lengths(df: DataFrame, low: int, high: int, share: float, text: str = "text") -> DataFrame:
    """One row: rows, the share with low <= length <= high, and whether it reaches ``share``."""
    inside = F.length(text).between(low, high).cast("double")
    return df.agg(F.count("*").alias("n"), F.round(F.avg(inside), 6).alias("share")).withColumn("ok", F.col("share") >= share)


def submission(df: DataFrame, column: str = "markers") -> Column:
    """Spans renamed to type, startIndex, endIndex and text; those outside the text go."""
    ok = lambda m: (m["start"] >= 0) & (m["end"] > m["start"]) & (m["end"] <= F.length("text"))
    return F.transform(F.filter(F.col(column), ok), lambda m: F.struct(m["label"].alias("type"), m["start"].alias("startIndex"), m["end"].alias("endIndex"), m["text"].alias("text")))


def crop_parts(around: int = 120) -> dict:
    """For spans.with_pieces: the text within ``around`` characters of the span, without outer white space, and the span's bounds in it."""
    lo = lambda s: F.greatest(F.lit(0), s["start"] - around)
    raw = lambda t, s: t.cut(lo(s), F.least(t.length, s["end"] + around) - lo(s))
    lead = lambda t, s: F.length(raw(t, s)) - F.length(F.regexp_replace(raw(t, s), r"^[ \t\r\n\f\x0B]+", ""))
    return {
        "snippet": lambda t, s: F.regexp_replace(raw(t, s), r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", ""),
        "new_start": lambda t, s: s["start"] - lo(s) - lead(t, s),
        "new_end": lambda t, s: s["end"] - lo(s) - lead(t, s),
    }


def attach_fallback(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """left with ``column`` from right where right has it, else its own."""
    other = right.select(key, F.col(column).alias("_other"))
    return left.join(other, key, "left").withColumn(column, F.coalesce("_other", column)).drop("_other")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df, if key is unique in it; else an error when it is used."""
    n, d = df.agg(F.count(key), F.countDistinct(key)).first()
    if n != d:
        raise ValueError(f"{key} is not unique: {n} rows, {d} values")
    return df


def merge_banks(spans: DataFrame, labels: DataFrame, order: str = "position", text: str = "text") -> DataFrame:
    """Two banks of examples as one by equal texts: text, markers, doc_label, rationale and place (from 1).

    spans (text, markers, order): of equal texts the first counts. labels (text, doc_label, rationale, order): of equal texts the last
    counts, doc_label is non and the rationale empty where they are null. Texts of the first bank come first, in its order, then those that
    only the second has. Rows without a text go. Places are counted in ranges of the order.
    """
    some = lambda df: df.where(F.coalesce(F.col(text), F.lit("")) != "")
    a = some(spans).groupBy(text).agg(F.min(order).alias("a_"), F.min_by("markers", order).alias("markers"))
    told = F.struct(F.coalesce("doc_label", F.lit("non")).alias("l"), F.coalesce("rationale", F.lit("")).alias("r"))
    b = some(labels).groupBy(F.col(text).alias("text_")).agg(F.min(order).alias("b_"), F.max_by(told, order).alias("told_"))
    both = a.join(b, F.col(text) == F.col("text_"), "full")
    at = F.struct(F.col("a_").isNull().alias("late"), F.coalesce("a_", "b_").alias("nth"), F.md5(F.coalesce(text, "text_")).alias("h"))
    rows = both.select(F.coalesce(text, "text_").alias(text), "markers", F.col("told_.l").alias("doc_label"), F.col("told_.r").alias("rationale"), at.alias("at_"))
    ranked = sums_before(rows, [], "at_", {"before_": F.lit(1)})
    return ranked.select(text, "markers", "doc_label", "rationale", (F.col("before_") + 1).alias("place"))
