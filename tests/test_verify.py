"""Verifiers against plain loops over whole strings."""

import random
import re

import pytest
from pyspark.sql import Observation

from spanloom.operators import verify as vf


def slow_plain(s):
    """Plain form and map, character by character."""
    out, at, i = [], [], 0
    while i < len(s):
        c = vf.PLAIN.get(s[i], s[i])
        if re.fullmatch(vf.BLANKS, c):
            out.append(" ")
            at.append(i)
            while i < len(s) and re.fullmatch(vf.BLANKS, vf.PLAIN.get(s[i], s[i])):
                i += 1
            continue
        out.append(c)
        at.append(i)
        i += 1
    return "".join(out), at


def slow_nth(text, quote, n):
    """Every form's places by trying all starts."""
    if not quote:
        return None
    starts = lambda t, q: [i for i in range(len(t) - len(q) + 1) if t[i : i + len(q)] == q]
    if len(found := starts(text, quote)) > n:
        return found[n], found[n] + len(quote), "exact"
    if len(text.lower()) == len(text) and len(quote.lower()) == len(quote) and len(found := starts(text.lower(), quote.lower())) > n:
        return found[n], found[n] + len(quote), "folded"
    (t, at), (q, _) = slow_plain(text), slow_plain(quote)
    if len(found := starts(t, q)) > n:
        s, e = at[found[n]], at[found[n] + len(q) - 1] + 1
        return (s, e, "normal") if slow_plain(text[s:e])[0] == q else None
    return None


def slow_ordinal(text, rows, bare):
    used, out, seen = {}, [], set()
    for label, quote in rows:
        quote = quote or ""
        key = (label, slow_plain(quote)[0])
        hit = slow_nth(text, quote, used.get(key, 0))
        if hit:
            used[key] = used.get(key, 0) + 1
        elif slow_nth(text, quote, 0):
            hit = (*slow_nth(text, quote, 0)[:2], "first")
        if not hit:
            out.append((-1, -1, "none", "missing"))
            continue
        s, e, how = hit
        if slow_plain(text[s:e])[0] != key[1]:
            out.append((s, e, how, "unequal"))
        elif (label, s, e) in seen:
            out.append((s, e, how, "repeated"))
        else:
            seen.add((label, s, e))
            out.append((s, e, how, "kept"))
    actions = [o[:2] for (label, _), o in zip(rows, out, strict=True) if label == "Action" and o[3] == "kept"]
    return [(*o[:3], "embedded") if label == "Victim" and o[3] == "kept" and text[o[0] : o[1]].strip().lower() in bare and any(a <= o[0] and o[1] <= b for a, b in actions) else o for (label, _), o in zip(rows, out, strict=True)]


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    pieces = ["NASA", "the", "people", "“so”", "\"so\"", "a–b", "a-b", "  ", " ", "\n", "…", "ünder", "İ", "man", "aa", "aaa"]
    texts = {i: "".join(rng.choice(pieces) + rng.choice(["", " ", "  "]) for _ in range(rng.choice([0, 5, 60]))) for i in range(40)} | {40: None, 41: "aa" * 30_000}
    quotes = []
    for i, t in texts.items():
        for nr in range(25):
            t_ = (t or "xx")[:400]
            a = rng.randrange(max(len(t_), 1))
            q = t_[a : a + rng.choice([1, 2, 4, 9, 20])]
            q = rng.choice([q, q, q, q.upper(), q.replace(" ", "  ").replace('"', "“").replace("-", "–"), q + "?", None, "", "people", "man", "aa"])
            quotes.append((i, nr, rng.choice(["Action", "Victim", "Actor"]), q))
    return texts, quotes


def test_ordinal_is_brute_force(spark, case):
    texts, quotes = case
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    frame = spark.createDataFrame(quotes, "doc_id long, nr int, label string, quote string").repartition(5)
    seen = Observation("verifier")
    got = {(r.doc_id, r.nr): (r.start, r.end, r.how, r.status) for r in vf.verify_ordinal(frame, docs, observation=seen).collect()}
    kinds = set()
    for i, t in texts.items():
        rows = [(label, q) for d, _, label, q in quotes if d == i]
        for nr, want in enumerate(slow_ordinal((t or "")[:3000], rows, vf.BARE_VICTIMS)):
            assert got[i, nr] == want, (i, nr, rows[nr])
            kinds |= {want[2], want[3]}
    assert kinds >= {"exact", "folded", "normal", "first", "none", "kept", "missing", "unequal", "repeated", "embedded"}
    counts = seen.get
    assert counts["candidates"] == len(quotes)
    for s in ("kept", "missing", "unequal", "repeated", "embedded"):
        assert counts[s] == sum(v[3] == s for v in got.values())
    assert counts["how_first"] == sum(v[2] == "first" for v in got.values())


def test_first_place_only(spark, case):
    texts, quotes = case
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.nr): (r.start, r.end, r.how, r.status) for r in vf.verify_first(spark.createDataFrame(quotes, "doc_id long, nr int, label string, quote string"), docs).collect()}
    for i, t in texts.items():
        seen = set()
        for d, nr, label, q in quotes:
            if d == i:
                hit = slow_nth((t or "")[:3000], q or "", 0)
                assert got[i, nr][:3] == (hit or (-1, -1, "none"))
                assert got[i, nr][3] == ("missing" if not hit else "repeated" if (label, *hit[:2]) in seen else "kept")
                seen.add((label, *hit[:2]) if hit else None)


def test_known_places(spark):
    """What a user of the verifier expects of repeated and missing quotes."""
    text = "The government and NASA are hiding aliens. NASA knows the truth."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = [("Actor", "NASA"), ("Actor", "NASA"), ("Actor", "NASA"), ("Victim", "NASA"), ("Actor", "aliens from Mars"), ("Actor", "the government")]
    quotes = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id long, nr int, label string, quote string")
    got = [(r.start, r.how, r.status) for r in vf.verify_ordinal(quotes, docs).orderBy("nr").collect()]
    assert got == [(19, "exact", "kept"), (43, "exact", "kept"), (19, "first", "repeated"), (19, "exact", "kept"), (-1, "none", "missing"), (0, "folded", "unequal")]


def test_context_decides_between_places(spark):
    text = "They  lie and they spy. Then THEY lie to us, and they   spy again. "
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = [("they", "", "spy again"), ("they", "then", "lie"), ("they spy", "", ""), ("they", "and", "spy."), ("nothing here at all", "x", "y"), (" lie  ", "they", "to us"), (None, "", ""), ("they", "zzz", "")]
    quotes = spark.createDataFrame([(1, i, "Actor", *r) for i, r in enumerate(rows)] + [(2, 0, "Actor", "they", "", "")], "doc_id long, nr int, label string, quote string, before string, after string")
    seen = Observation("context")
    got = {(r.doc_id, r.nr): (text[r.start : r.end] if r.start >= 0 else None, r.start, r.how, r.status) for r in vf.verify_in_context(quotes, docs, observation=seen).collect()}
    assert got[1, 0] == ("they", 49, "context", "kept")
    assert got[1, 1] == ("THEY", 29, "context", "kept")
    assert got[1, 2] == ("they spy", 14, "fallback", "kept")
    assert got[1, 3] == ("they", 14, "context", "inside")  # of the one before
    assert got[1, 4][3] == "missing"
    assert got[1, 5] == ("lie", 34, "context", "kept")
    assert got[1, 6][3] == "missing" and got[2, 0][3] == "missing"
    assert got[1, 7] == ("they", 14, "fallback", "inside")
    assert (seen.get["how_context"], seen.get["how_fallback"], seen.get["missing"]) == (4, 2, 3)


def test_bounds_grow_to_words():
    assert vf.grown("unhappy people", 2, 9) == (0, 14)
    assert vf.grown("unhappy people", 0, 7) == (0, 7)
    assert vf.grown("a b", 1, 2) == (1, 2)
    assert vf.plain_with_map("“a”  b…") == ('"a" b.', [0, 1, 2, 3, 5, 6])
