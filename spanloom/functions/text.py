"""Text clean-up and label normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import VERDICT_NO, VERDICT_YES

SMART, PLAIN = "‘’‚“”„–—", "'''\"\"\"--"


def lookup(c: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """The table's value for c; default where it has none."""
    keys = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(keys, c), F.lit(default)) if default is not None else F.element_at(keys, c)


def first_present(*cols: Column) -> Column:
    return F.coalesce(*cols)


def first_filled(*cols: Column) -> Column:
    """The first column that is more than white space."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in cols))


def doc_label(c: Column, table: Mapping[str, str]) -> Column:
    """Trims, lowers and looks up; unknown labels are null."""
    return lookup(F.lower(F.trim(c)), table)


def verdict_label(c: Column) -> Column:
    """conspiracy, non or ambiguous, for a free-form verdict."""
    x = F.replace(F.trim(F.lower(c)), F.lit("."), F.lit(""))
    return F.when(x.isin(*VERDICT_YES), "conspiracy").when(x.isin(*VERDICT_NO), "non").otherwise("ambiguous")


def span_label(c: Column) -> Column:
    """The last dotted part, trimmed and lowered."""
    return F.lower(F.trim(F.element_at(F.split(c, r"\."), -1)))


def yes_no(c: Column) -> Column:
    return F.when(c == "conspiracy", "Yes").when(c == "non", "No")


def normal_space(c: Column) -> Column:
    """Lowered, runs of ASCII white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\r\n\f\x0B]+", " "))


def fold_quotes(c: Column) -> Column:
    return F.translate(c, SMART, PLAIN)


def url_tokens(c: Column) -> Column:
    return F.replace(c, F.lit("[URL]"), F.lit("<URL>"))


def replace_urls(c: Column) -> Column:
    """From 'http' to the last non-word character of its line, or the line's end, becomes <URL>."""
    return F.regexp_replace(c, r"(?d)(?U)http(.+)?(\W|$)", "<URL>")


def strip_statement(c: Column) -> Column:
    """Without a leading 'submission statement', 'summary statement' or 'ss', and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?iU)^\W*(summary statement|submission statement|ss)[^a-zA-Z]*", ""))


def html_text(c: Column) -> Column:
    """Text nodes of HTML joined by blanks: without scripts, styles, code blocks and tags; basic entities resolved."""
    x = F.regexp_replace(c, r"(?is)<(script|style|pre|code)\b[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[ \t\r\n\f\x0B]+", " "))


def clean_comment(c: Column) -> Column:
    """Markdown as text, without addresses and without a leading statement prefix."""
    return strip_statement(replace_urls(markdown_text(c)))


def words(c: Column) -> Column:
    """Lowered runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def ascii_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))


def cue_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+|<url>"), F.lit(0))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(F.lower(c)), r"[ \t\r\n\f\x0B]+"), lambda w: w != ""))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by blanks. tokens is best a column: an expression would be evaluated 2n times."""
    m = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    parts = [F.slice(tokens, k + 1, m) for k in range(n)]
    return F.transform(F.arrays_zip(*(x.alias(f"g{k}") for k, x in enumerate(parts))), lambda g: F.concat_ws(" ", *(g[f"g{k}"] for k in range(n))))


def lexicon_count(c: Column, terms: Sequence[str]) -> Column:
    """Occurrences of whole terms, which may be phrases, whatever their case."""
    alternatives = "|".join(r"\Q" + t + r"\E" for t in sorted(terms, key=len, reverse=True))
    return F.regexp_count(F.lower(c), F.lit(rf"(?<![a-z0-9_])(?:{alternatives})(?![a-z0-9_])"))


def lexicon_share(tokens: Column, terms: Sequence[str]) -> Column:
    """Share of tokens in the list; phrases never match a token."""
    return F.size(F.filter(tokens, lambda t: t.isin(*terms))) / F.greatest(F.size(tokens), F.lit(1))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def clip_to_sentence(c: Column, n: int) -> Column:
    """The first n characters, cut back to the last sentence end among them if there is one."""
    head = F.substring(c, 1, n)
    return F.when(F.length(c) <= n, c).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.*[.!?])", 1), F.lit("")), head))


def template(pattern: str, **values: Column) -> Column:
    out = F.lit(pattern)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def json_block(c: Column) -> Column:
    """The outermost JSON object of a reply: without code fences, trailing commas dropped; null if there is none."""
    x = F.regexp_replace(c, r"```[a-zA-Z]*", "")
    x = F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.regexp_replace(x, r",(\s*[}\]])", "$1")


def json_value(c: Column) -> Column:
    """The JSON of a reply, without code fences: a struct of text and kind (array, if there is one, or object). As it is if it parses, else
    with straight quotes and without trailing commas, if that does; else null."""
    x = F.regexp_replace(c, r"```(json)?", "")
    part = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    array, one = part(r"(?s)(\[.*\])"), part(r"(?s)(\{.*\})")
    block = F.coalesce(array, one)
    mended = F.regexp_replace(F.translate(block, "“”’", "\"\"'"), r",(\s*[}\]])", "$1")
    parses = lambda t: F.try_parse_json(t).isNotNull()
    return F.when(parses(block) | parses(mended), F.struct(F.when(parses(block), block).otherwise(mended).alias("text"), F.when(array.isNotNull(), "array").otherwise("object").alias("kind")))


def position_phrase(mean: Column) -> Column:
    return F.when(mean < 0.33, "early").when(mean < 0.66, "middle").otherwise("late")


def time_anchor(c: Column) -> Column:
    """Whether a short phrase is about time: at most six words with a year, a date, a unit with a number or a time word."""
    few = F.size(F.split(F.trim(c), r"[ \t\r\n\f\x0B]+")) <= 6
    dated = c.rlike(r"(?i)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b(19|20)\d{2}\b|\b\d+ (seconds|minutes|hours|days|weeks|months|years)\b|\b(today|yesterday|tomorrow|recently|now|ago)\b")
    return few & dated


def evidence_kinds(c: Column) -> Column:
    kinds = {"url": r"(?i)https?://|<url>|www\.", "quote": "[\"“”]", "numeric": r"\d", "named": r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"}
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(k)) for k, p in kinds.items())))


def nfkc(c: Column) -> Column:
    """Unicode's compatibility composition, in Arrow batches: Spark has no function for it."""

    def compose(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in values.to_pylist()], pa.string())

    return F.arrow_udf(compose, "string")(c)


def nfkc_key(c: Column) -> Column:
    """NFKC, straight quotes, lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(fold_quotes(nfkc(F.coalesce(c, F.lit(""))))), r"[ \t\r\n\f\x0B]+", " "))


def markdown_text(c: Column) -> Column:
    """Text of markdown: code, images and tags go, links keep their words, marks of headings, quotes, lists and emphasis go; text nodes
    joined by blanks."""
    x = F.regexp_replace(c, r"(?s)```.*?```", " ")
    for pattern, by in ((r"`[^`\n]*`", " "), (r"!\[[^\]\n]*\]\([^)\n]*\)", " "), (r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"), (r"(?m)^ {0,3}(#{1,6} +|> ?|[-*+] +|[0-9]+[.] +)", ""), (r"\*\*([^*\n]+)\*\*", "$1"), (r"\*([^*\n]+)\*", "$1"), (r"__([^_\n]+)__", "$1")):
        x = F.regexp_replace(x, pattern, by)
    return html_text(x)


# What a purpose clause begins with, and what tells that a span names its source.
PURPOSES = ("to ", "in order to ", "so that ", "so as to ", "for the purpose of ")
ATTRIBUTION = r"(?i)(^|[^a-z0-9_])(according to|said|reported|per|study|report)([^a-z0-9_]|$)"
NUMBERS = r"(^|[^A-Za-z0-9_])[0-9][0-9,]*([.][0-9]+)? *(%|million|billion|cases|people|USD|dollars|€)"
DOMAIN = r"(?i)https?://|www[.]|[a-z0-9-]+[.](com|org|net|gov|edu)([^a-z0-9_]|$)"


def starts_purpose(c: Column, purposes: Sequence[str] = PURPOSES) -> Column:
    low = F.ltrim(F.lower(c))
    out = F.lit(False)
    for p in purposes:
        out = out | low.startswith(p)
    return out


def looks_cited(c: Column) -> Column:
    """Whether a span has an address, names a source or has double or curly quotes."""
    low = F.lower(c)
    out = F.contains(low, F.lit("http")) | F.contains(low, F.lit("www.")) | F.contains(low, F.lit("according to"))
    for q in ('"', "\u2018", "\u2019", "\u201c", "\u201d"):
        out = out | F.contains(c, F.lit(q))
    return out


def is_evidence(c: Column, attribution: str = ATTRIBUTION, numbers: str = NUMBERS) -> Column:
    """Whether a span has an address, or a quote or a number with a unit together with an attribution."""
    t = F.trim(F.coalesce(c, F.lit("")))
    quote = F.contains(t, F.lit('"')) | F.contains(t, F.lit("'")) | F.contains(t, F.lit("\u201c")) | F.contains(t, F.lit("\u201d"))
    return (t != "") & (t.rlike(DOMAIN) | ((quote | t.rlike(numbers)) & t.rlike(attribution)))
