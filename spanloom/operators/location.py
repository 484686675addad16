"""Finding quoted text in documents: exact, ignoring case, normalised, and by edit distance."""

from __future__ import annotations

import difflib
import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def locate_plain(text: Column, quote: Column) -> Column:
    """Start of the first occurrence, exact or else ignoring case; -1 if there is none."""
    exact = F.instr(text, quote)
    folded = F.instr(F.lower(text), F.lower(quote))
    return F.when(F.length(quote) == 0, -1).when(exact > 0, exact - 1).when(folded > 0, folded - 1).otherwise(-1)


def all_positions(text: str, quote: str) -> list[int]:
    """Starts of all occurrences, overlapping ones too."""
    out, at = [], text.find(quote) if quote else -1
    while at >= 0:
        out.append(at)
        at = text.find(quote, at + 1)
    return out


def _nth_position(text: str, quote: str, nth: int) -> int:
    """Start of the nth occurrence, or of the last one where there are fewer; -1 if there is none."""
    last = at = text.find(quote)
    while at >= 0 and nth != 1:
        nth, last = nth - 1, at
        at = text.find(quote, at + 1)
    return max(at, last)


_FOLD = str.maketrans("‘’‚“”„–—", "'''\"\"\"--")


def _normal(text: str) -> tuple[str, list[int]]:
    """text with quotes folded, lowered and white space collapsed, and for each character where it came from."""
    out, at, blank = [], [], False
    for i, c in enumerate(text.translate(_FOLD)):
        if c.isspace():
            blank = bool(out)
            continue
        if blank:
            out.append(" ")
            at.append(i - 1)
            blank = False
        low = c.lower()
        out.append(low if len(low) == 1 else c)
        at.append(i)
    return "".join(out), at


#: A document's quotes come one behind the other, so its text is lowered and folded once for all.
_lowered = functools.lru_cache(1)(str.lower)
_normal_text = functools.lru_cache(1)(_normal)


def _near_end(text: str, quote: str, most: int) -> int | None:
    """The first end of a substring with the fewest edits to quote, if they are at most ``most``.

    Of most + 1 pieces of quote one occurs unchanged in each such substring, so only the places around pieces are
    searched, by bit-parallel columns (Myers).
    """
    n = len(quote)
    cuts = [n * k // (most + 1) for k in range(most + 2)]
    near = sorted({(max(0, p - a - most), p - a + n + most) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for p in all_positions(text, quote[a:b])})
    runs: list[list[int]] = []
    for lo, hi in near:
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    equal: dict[str, int] = {}
    for i, q in enumerate(quote):
        equal[q] = equal.get(q, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    best, end = most + 1, None
    for lo, hi in runs:
        up, down, score = full, 0, n
        for j, c in enumerate(text[lo:hi], lo + 1):
            eq = equal.get(c, 0)
            x = (((eq & up) + up) ^ up) | eq | down
            rise, fall = down | (full & ~(x | up)), up & x
            score += bool(rise & top) - bool(fall & top)
            rise, fall = rise << 1, fall << 1
            v = eq | down
            up, down = full & (fall | ~(v | rise)), full & rise & v
            if score < best:
                best, end = score, j
    return end


def _near(text: str, quote: str, share: float) -> tuple[int, int] | None:
    """The substring with the fewest edits to quote, if they are at most ``share`` of its length (Sellers' algorithm)."""
    most = int(len(quote) * share)
    end = _near_end(text, quote, most)
    if end is None:
        return None
    # An alignment of a cell before this window costs more than ``most``.
    first = max(0, end - 2 * (len(quote) + most) - 2)
    row, begin = list(range(len(quote) + 1)), [first] * (len(quote) + 1)
    for j, c in enumerate(text[first:end], first + 1):
        new, start = [0], [j]
        for i, q in enumerate(quote, 1):
            cost, at = row[i - 1] + (q != c), begin[i - 1]
            if row[i] + 1 < cost:
                cost, at = row[i] + 1, begin[i]
            if new[i - 1] + 1 < cost:
                cost, at = new[i - 1] + 1, start[i - 1]
            new.append(cost)
            start.append(at)
        row, begin = new, start
    return begin[-1], end


def locate(text: str | None, quote: str | None, nth: int = 1) -> tuple[int, int, str]:
    """Bounds of the nth occurrence of quote in text and how it was found: exact, folded, normal, near or blocks; (-1, -1, miss) otherwise."""
    if not text or not quote or not quote.strip():
        return -1, -1, "miss"
    if (s := _nth_position(text, quote, nth)) >= 0:
        return s, s + len(quote), "exact"
    low, q = _lowered(text), quote.lower()
    if len(low) == len(text) and (s := _nth_position(low, q, nth)) >= 0:
        return s, s + len(q), "folded"
    (t, at), (q, _) = _normal_text(text), _normal(quote)
    if q and (s := _nth_position(t, q, nth)) >= 0:
        return at[s], at[s + len(q) - 1] + 1, "normal"
    if len(q) >= 4 and (hit := _near(t, q, 0.15)):
        return at[hit[0]], at[hit[1] - 1] + 1, "near"
    blocks = [b for b in difflib.SequenceMatcher(None, t, q, autojunk=False).get_matching_blocks() if b.size]
    if blocks and sum(b.size for b in blocks) > 0.6 * len(q) and blocks[-1].a + blocks[-1].size - blocks[0].a <= 1.5 * len(q):
        return at[blocks[0].a], at[blocks[-1].a + blocks[-1].size - 1] + 1, "blocks"
    return -1, -1, "miss"


def locate_context(text: str | None, before: str, quote: str, after: str) -> tuple[int, int]:
    """Bounds of quote between its neighbours, whatever the white space; without neighbours where these do not occur."""
    flexible = lambda s: r"\s+".join(map(re.escape, s.split()))
    if not text or not quote.split():
        return -1, -1
    for b, a in ((before, after), (before, ""), ("", after), ("", "")):
        parts = [flexible(b) + r"\s*" if b.split() else "", f"({flexible(quote)})", r"\s*" + flexible(a) if a.split() else ""]
        if m := re.search("".join(parts), text):
            return m.span(1)
    return -1, -1


def locate_spans(quotes: DataFrame, text: str = "text", quote: str = "quote") -> DataFrame:
    """Adds start, end and how to rows (text, quote, and nth if there is one)."""
    nth = F.col("nth") if "nth" in quotes.columns else F.lit(1)

    @F.pandas_udf("start long, end long, how string")
    def find(t: pd.Series, q: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([locate(a, b, int(c)) for a, b, c in zip(t, q, n, strict=True)], columns=["start", "end", "how"])

    return quotes.withColumn("_at", find(F.col(text), F.col(quote), nth)).select(*quotes.columns, "_at.start", "_at.end", "_at.how")


def locate_in_context(quotes: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds start and end to rows (key, before, quote, after): see locate_context(). A document meets its quotes as one array, and its text
    crosses to Python once."""
    cols = [c for c in quotes.columns if c != key]
    grouped = quotes.groupBy(key).agg(F.collect_list(F.struct(*cols)).alias("quotes_"))
    j = grouped.join(docs.select(key, F.col(text).alias("text_")), key)

    @F.pandas_udf("array<struct<start: long, end: long>>")
    def find(texts: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "end"), locate_context(t, r["before"] or "", r["quote"] or "", r["after"] or ""), strict=True)) for r in q] for t, q in zip(texts, rows, strict=True)])

    asked = F.transform("quotes_", lambda q: F.struct(*(q[c].alias(c) for c in ("before", "quote", "after"))))
    both = j.withColumn("found_", find("text_", asked)).select(key, F.inline(F.arrays_zip("quotes_", "found_")))
    return both.select(key, *(F.col(f"quotes_.{c}").alias(c) for c in cols), "found_.start", "found_.end")


def similarity(a: str, b: str) -> float:
    """How alike two labels' texts are: 1 for equal ones whatever the case, .9 and .8 for a part of a compound, else the better of matching
    blocks and word overlap."""
    x, y = a.strip().lower(), b.strip().lower()
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    parts = lambda s: [p.strip() for p in re.split(r"\band\b|[,/&]", s) if p.strip()]
    if x in parts(y) or y in parts(x):
        return 0.9
    if any(p in y for p in parts(x) if len(parts(x)) > 1) or any(p in x for p in parts(y) if len(parts(y)) > 1):
        return 0.8
    if x in y or y in x:
        return min(len(x), len(y)) / max(len(x), len(y))
    u, v = set(x.split()), set(y.split())
    return max(difflib.SequenceMatcher(None, x, y).ratio(), len(u & v) / len(u | v))
