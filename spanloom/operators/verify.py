"""Verifying quoted spans against their documents: repeated quotes take successive places, and what cannot be placed is told and counted."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .folds import ROWS, columns, documents
from .location import locate
from .staging import small_batches

# Characters that count as their plain forms, what counts as white space besides Python's, and Victims that are no span
# inside an Action.
PLAIN = {"“": '"', "”": '"', "‘": "'", "’": "'", "‚": "'", "‛": "'", "«": '"', "»": '"', "–": "-", "—": "-", "−": "-", "…": "."}
BLANKS = r"[\s  -​ ]+"
BARE_VICTIMS = ("child", "person", "people", "man", "woman")

_PLAIN = str.maketrans(PLAIN)
_BLANKS = re.compile(BLANKS)


def plain(text: str) -> str:
    """text with plain quotes and dashes, runs of white space as one space."""
    return _BLANKS.sub(" ", text.translate(_PLAIN))


def plain_with_map(text: str) -> tuple[str, list[int]]:
    """plain(text), and where each of its characters stands in text (a run of white space: where it begins)."""
    text, at, last = text.translate(_PLAIN), [], 0  # one character for one
    for m in _BLANKS.finditer(text):
        at.extend(range(last, m.start() + 1))
        last = m.end()
    at.extend(range(last, len(text)))
    return _BLANKS.sub(" ", text), at


def places(text: str, wanted: dict[str, int]) -> dict[str, list[int]]:
    """The first so many starts of each wanted string in text, overlapping ones too: one scan of the text for all."""
    out: dict[str, list[int]] = {q: [] for q in wanted}
    found = ahocorasick.Automaton()
    for q in wanted:
        if q:
            found.add_word(q, q)
    if not len(found):
        return out
    found.make_automaton()
    for end, q in found.iter(text):
        if len(out[q]) < wanted[q]:
            out[q].append(end - len(q) + 1)
    return out


class _Finder:
    """The places of a document's quotes: as they are, whatever the case, and in plain form. A quote is looked for in the next form only if
    the forms before have too few places."""

    def __init__(self, text: str, quotes: list[str]):
        self.text = text
        self.plain = {q: plain(q) for q in set(quotes)}
        same = Counter(self.plain[q] for q in quotes)  # a quote can be asked for as often as its plain form occurs
        need = {q: same[self.plain[q]] for q in self.plain if q}
        self.exact = places(text, need)
        short = {q: n for q, n in need.items() if len(self.exact[q]) < n}
        low = text.lower()
        self.folded = places(low, {q.lower(): n for q, n in short.items() if len(q.lower()) == len(q)}) if len(low) == len(text) else {}
        self.normal, self.at = {}, []
        if short:
            body, self.at = plain_with_map(text)
            self.normal = places(body, {self.plain[q]: n for q, n in short.items()})

    def nth(self, quote: str, n: int) -> tuple[int, int, str] | None:
        """Bounds of the place number n (from 0) of the first form that has so many, and that form."""
        if not quote:
            return None
        if len(found := self.exact[quote]) > n:
            return found[n], found[n] + len(quote), "exact"
        if len(found := self.folded.get(quote.lower(), ())) > n:
            return found[n], found[n] + len(quote), "folded"
        q = self.plain[quote]
        if len(found := self.normal.get(q, ())) > n:
            s, e = self.at[found[n]], self.at[found[n] + len(q) - 1] + 1
            return (s, e, "normal") if plain(self.text[s:e]) == q else None
        return None


_word = re.compile(r"\w").match


def grown(text: str, s: int, e: int) -> tuple[int, int]:
    """Bounds moved out to those of the words that they cut."""
    if 0 < s < len(text) and _word(text[s]):
        while s > 0 and _word(text[s - 1]):
            s -= 1
    if 0 < e < len(text) and _word(text[e - 1]):
        while e < len(text) and _word(text[e]):
            e += 1
    return s, e


Row = tuple[int, int, str, str]  # start, end, how, status
MISSING = (-1, -1, "none", "missing")


def _ordinal(text: str, rows: list[dict], bare: tuple[str, ...]) -> Iterator[Row]:
    find = _Finder(text, [r["quote"] or "" for r in rows])
    used: Counter = Counter()
    out: list[Row] = []
    seen = set()
    for r in rows:
        quote = r["quote"] or ""
        key = (r["label"], find.plain[quote])
        hit = find.nth(quote, used[key])
        if hit:
            used[key] += 1
        elif first := find.nth(quote, 0):  # the next one tries that place again
            hit = (*first[:2], "first")
        if not hit:
            out.append(MISSING)
            continue
        s, e, how = hit
        wide = grown(text, s, e)
        if plain(text[slice(*wide)]) == find.plain[quote]:
            s, e = wide
        if plain(text[s:e]) != find.plain[quote]:
            out.append((s, e, how, "unequal"))
        elif (r["label"], s, e) in seen:
            out.append((s, e, how, "repeated"))
        else:
            seen.add((r["label"], s, e))
            out.append((s, e, how, "kept"))
    actions = sorted((o[0], o[1]) for r, o in zip(rows, out, strict=True) if r["label"] == "Action" and o[3] == "kept")
    reach, far = [], 0  # the furthest end among the actions up to each
    for _, e in actions:
        far = max(far, e)
        reach.append(far)
    for r, (s, e, how, status) in zip(rows, out, strict=True):
        if status == "kept" and r["label"] == "Victim" and text[s:e].strip().lower() in bare:
            i = bisect.bisect_right(actions, (s, len(text) + 1))
            if i and reach[i - 1] >= e:
                status = "embedded"
        yield s, e, how, status


def _first(text: str, rows: list[dict]) -> Iterator[Row]:
    find = _Finder(text, [r["quote"] or "" for r in rows])
    seen = set()
    for r in rows:
        hit = find.nth(r["quote"] or "", 0)
        if not hit:
            yield MISSING
            continue
        repeated = (r["label"], *hit[:2]) in seen
        seen.add((r["label"], *hit[:2]))
        yield *hit, "repeated" if repeated else "kept"


class _Folded(dict):
    """For each character one that stands for all that a regular expression takes for it where case does not count."""

    same: dict[str, str] = {}

    def __missing__(self, c: int) -> str:
        low = chr(c).lower()[0]
        up = low.upper()
        self[c] = up if len(up) == 1 else self.same.setdefault(up, low)
        return self[c]


_FOLDED = _Folded()
_GAPS = re.compile(r"\s\s+")


class _Contexts:
    """First places of quotes between their neighbours, whatever the white space and case: one scan of the text for all."""

    def __init__(self, text: str, asked: list[tuple[str, str, str]]):
        """asked: words before, quote and words after, each with single blanks; what is empty does not count."""
        self.text = re.sub(r"\s+", " ", text).translate(_FOLDED)
        self.cuts, self.shifts, gone = [], [0], 0  # from which character on how many were left out
        for m in _GAPS.finditer(text):
            self.cuts.append(m.start() - gone + 1)
            gone += m.end() - m.start() - 1
            self.shifts.append(gone)
        self.forms = {a: list(self._forms(*a)) for a in asked}
        self.found = places(self.text, {p: 1 for forms in self.forms.values() for p, _ in forms})

    @staticmethod
    def _forms(before: str, quote: str, after: str) -> Iterator[tuple[str, int]]:
        """What may stand in the text, and where the quote begins in it."""
        before, quote, after = (x.translate(_FOLDED) for x in (before, quote, after))
        for left in (before, f"{before} ") if before else ("",):
            for right in (after, f" {after}") if after else ("",):
                yield left + quote + right, len(left)

    def first(self, before: str, quote: str, after: str) -> tuple[int, int] | None:
        hits = [(self.found[p][0], at) for p, at in self.forms[before, quote, after] if self.found[p]]
        if not hits:
            return None
        s = sum(min(hits))
        return self._place(s), self._place(s + len(quote) - 1) + 1

    def _place(self, i: int) -> int:
        return i + self.shifts[bisect.bisect_right(self.cuts, i)]


def _in_context(text: str, rows: list[dict]) -> Iterator[Row]:
    out: list[Row] = []
    asked = [tuple(" ".join((r[c] or "").split()) for c in ("before", "quote", "after")) for r in rows]
    near = _Contexts(text, [a for a in asked if a[1] and (a[0] or a[2])])
    for before, quote, after in asked:
        hit = None
        if quote and (before or after):
            m = near.first(before, quote, after)
            hit = (*m, "context") if m else None
        if not hit:
            s, e, how = locate(text, quote)
            hit = (s, e, "fallback") if s >= 0 else None
        if not hit:
            out.append(MISSING)
            continue
        s, e, how = hit
        body = text[s:e]
        s, e = s + len(body) - len(body.lstrip()), e - len(body) + len(body.rstrip())
        out.append((s, e, how, "kept") if s < e else MISSING)
    # Inside another of any label: by start, longer first, the spans before reach furthest.
    reach = -1
    for i in sorted((i for i, o in enumerate(out) if o[3] == "kept"), key=lambda i: (out[i][0], -out[i][1])):
        if out[i][1] <= reach:
            out[i] = (*out[i][:3], "inside")
        reach = max(reach, out[i][1])
    yield from out


def _verified(quotes: DataFrame, docs: DataFrame, fold: Callable, fields: tuple[str, ...], key: str, order: str, text: str, observation: Observation | None) -> DataFrame:
    """quotes with start, end, how and status: a document's quotes, in order, meet its text as one array, which is read once."""
    small_batches(docs.sparkSession)  # spans as objects take many times their bytes
    grouped = quotes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in quotes.columns if c not in (key, order))))).alias("quotes_"))
    both = grouped.join(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text_")), key)

    kinds = [("start", pa.int64()), ("end", pa.int64()), ("how", pa.string()), ("status", pa.string())]
    mine = [c for c in quotes.columns if c != key]

    def run(batches):
        for batch in batches:
            flat = batch.column(2).flatten()
            ids, out, first = [], [], 0
            for i, t, rows in documents(batch, fields):
                ids += [i] * len(rows)
                out += fold(t, rows)
                if len(out) >= ROWS or i == batch.num_rows - 1:
                    cols = [flat.field(c).slice(first, len(out)) for c in mine]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), *cols, *columns(out, kinds)], names=[key, *mine, *(k for k, _ in kinds)])
                    ids, out, first = [], [], first + len(out)

    schema = ", ".join(f"`{c}` {quotes.schema[c].dataType.simpleString()}" for c in (key, *mine))
    out = both.select(key, "text_", "quotes_").mapInArrow(run, f"{schema}, start long, end long, how string, status string")
    if observation is not None:
        count = lambda c: F.count_if(c)
        out = out.observe(observation, F.count("*").alias("candidates"), *(count(F.col("status") == s).alias(s) for s in ("kept", "missing", "unequal", "repeated", "embedded", "inside")), *(count(F.col("how") == h).alias(f"how_{h}") for h in ("exact", "folded", "normal", "first", "context", "fallback")))
    return out


def verify_ordinal(quotes: DataFrame, docs: DataFrame, bare: tuple[str, ...] = BARE_VICTIMS, key: str = "doc_id", order: str = "nr", text: str = "text", observation: Observation | None = None) -> DataFrame:
    """Adds start, end, how and status to quotes (key, nr, label, quote); nr orders a document's quotes.

    The n-th use of a label and quote (in plain form) takes the quote's n-th place: as it is (exact), whatever the case (folded) or in plain
    form (normal); where no form has so many, the first place (first). Bounds grow to whole words if the text stays equal in plain form.

    status: kept; missing; unequal (the place reads otherwise in plain form, as for another case); repeated (same label and
    place as an earlier one); embedded (a Victim of one bare word inside a kept Action). ``observation`` counts them. Null quotes are missing; quotes
    of documents that are not there go.
    """
    return _verified(quotes, docs, lambda t, rows: _ordinal(t, rows, bare), ("label", "quote"), key, order, text, observation)


def verify_first(quotes: DataFrame, docs: DataFrame, key: str = "doc_id", order: str = "nr", text: str = "text", observation: Observation | None = None) -> DataFrame:
    """As verify_ordinal, but every quote takes its first place, and neither equality nor embedding is asked for: what a review's merged spans get."""
    return _verified(quotes, docs, _first, ("label", "quote"), key, order, text, observation)


def verify_in_context(quotes: DataFrame, docs: DataFrame, key: str = "doc_id", order: str = "nr", text: str = "text", observation: Observation | None = None) -> DataFrame:
    """As verify_ordinal for quotes with before and after: between these neighbours, whatever the white space and case (context), or else wherever
    ``locate`` finds the quote (fallback). Bounds lose outer white space; status inside is for spans within another kept one of any label."""
    return _verified(quotes, docs, _in_context, ("quote", "before", "after"), key, order, text, observation)
