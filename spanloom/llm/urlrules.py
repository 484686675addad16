"""URL filter: pattern rules indexed by their rarest literal token (DataFrame functions only)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small

#: Up to so many rules the token index is a literal in the plan; beyond, it is a joined table.
INDEX_ROWS = 2_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and for text without '://'."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_tokens(host: str, path: str) -> list[str]:
    """The literal tokens that every URL fitting the rule has: labels of the host, and whole segments of the path."""
    return [f"h:{x}" for x in host.split(".") if x] + [f"p:{x}" for x in path.split("/")[1:-1] if x]


def _pattern(host: str, path: str) -> str:
    h = rf"(?:[^\n]*\.)?{re.escape(host)}" if host else r"[^\n]*"
    return rf"(?s)^{h}\n{re.escape(path)}".replace("\n", r"\n")


def _values(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A table of literal rows, as an array in the plan, so that no Python worker has a part in it."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(row, names, strict=True))) for row in rows))))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """Judges every URL by the longest fitting rule.

    rules: (verdict, host, path). A rule fits its host and all subdomains if the URL's path starts with its path.
    Of the fitting rules the longest wins (host and path together; of equals the one with the longer host, then
    block before allow). A URL that no rule fits gets ``default``. Each rule is filed under that of its literal
    tokens which the fewest URLs of the whole table have; a URL's tokens fetch candidates, and only these run
    their regular expression.

    Returns key, host, path, rule (host and path, null if none fits) and verdict, one row per input row. A null
    URL, or one without '://', has an empty host and path and fits only rules whose host and path are empty.
    Repeated rows stay; other columns do not matter and are not returned.
    """
    host, path = url_parts(F.col(url))
    base = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    tokens = F.array_union(
        F.transform(F.filter(F.split("host", r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x)),
    )
    empty = base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    if not rules:
        return empty
    literal = sorted({t for _, h, p in rules for t in rule_tokens(h, p)})
    spark = pages.sparkSession
    known = _values(spark, [(t,) for t in literal], ("token",)) if literal else None
    counts = {}
    if known is not None:
        seen = base.select(F.explode(tokens).alias("token")).join(small(known), "token")
        counts = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}  # at most one row per token of the rules
    filed = [(min(rule_tokens(h, p), key=lambda t: (counts.get(t, 0), t), default="*"), len(h + p) * 1_000_000 + len(h) * 10 + (v == "block"), h + p, v, _pattern(h, p)) for v, h, p in rules]
    fits = F.concat_ws("\n", "host", "path")
    tokens = F.concat(tokens, F.array(F.lit("*")))
    if len(filed) <= INDEX_ROWS:
        index: dict[str, list] = {}
        for t, *rule in filed:
            index.setdefault(t, []).append(F.struct(*(F.lit(x).alias(n) for x, n in zip(rule, ("rank", "rule", "verdict", "pattern"), strict=True))))
        lookup = F.create_map(*(c for t, r in sorted(index.items()) for c in (F.lit(t), F.array(*r))))
        found = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.element_at(lookup, t), F.filter(F.element_at(lookup, F.lit(filed[0][0])), lambda _: F.lit(False)))))
        best = F.array_max(F.filter(found, lambda r: F.regexp_like(fits, r["pattern"])))
        return base.withColumn("b", best).select(key, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
    table = _values(spark, filed, ("token", "rank", "rule", "verdict", "pattern"))
    (row,) = fresh(base, "row")
    # The candidates of a row meet again by the row's own values: equal URLs have equal verdicts.
    hit = base.select("host", "path").distinct().withColumn("token", F.explode(tokens)).join(small(table), "token").where(F.expr("regexp_like(concat_ws('\n', host, path), pattern)"))
    best = hit.groupBy("host", "path").agg(F.max(F.struct("rank", "rule", "verdict")).alias(row))
    return base.join(best, ["host", "path"], "left").select(key, "host", "path", F.col(f"{row}.rule").alias("rule"), F.coalesce(f"{row}.verdict", F.lit(default)).alias("verdict"))
