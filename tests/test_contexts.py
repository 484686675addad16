"""Quotes between their neighbours, against a search for each by a regular expression."""

import random
import re
import time

from spanloom.operators import location, verify


def _searched(text, before, quote, after):
    flexible = lambda s: r"\s+".join(map(re.escape, s.split()))
    pattern = (f"(?:{flexible(before)})\\s*" if before.split() else "") + f"({flexible(quote)})" + (f"\\s*(?:{flexible(after)})" if after.split() else "")
    m = re.search(pattern, text, re.IGNORECASE)
    return m and m.span(1)


def test_contexts_equal_a_search_for_each():
    rng = random.Random(5)
    words = ["a", "A", "ab", "Straße", "ſo", "SO", "İi", "ıI", "K", "k", "ς", "Σ", "x.y", "ΐ", "ΐ"]
    met = 0
    for _ in range(400):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", "\n\t ", " "]) for _ in range(rng.randrange(1, 40)))
        asked = []
        for _ in range(10):
            cuts = sorted(rng.randrange(len(text) + 1) for _ in range(4))
            parts = [" ".join(rng.choice([str, str.upper, str.lower])(text[a:b]).split()) for a, b in zip(cuts, cuts[1:], strict=False)]
            if parts[1] and (parts[0] or parts[2]):
                asked.append(tuple(parts))
        found = verify._Contexts(text, asked)
        for a in asked:
            want = _searched(text, *a)
            assert found.first(*a) == want, (text, a)
            met += want is not None
    assert met > 1000


def test_case_counts_as_in_regular_expressions():
    some = [chr(c) for c in [*range(0x20, 0x590), *range(0x1E00, 0x2000), 0x212A, 0x212B, 0x2126, *range(0xFB00, 0xFB07)]]
    for c in some:
        for other in {c.lower()[0], c.upper()[0], c.swapcase()[0], *(x for x in "sSſiIİıKkKßẞ")}:
            assert (c.translate(verify._FOLDED) == other.translate(verify._FOLDED)) == bool(re.fullmatch(re.escape(c), other, re.IGNORECASE))


def test_many_quotes_of_a_long_text():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(60_000)]
    text = " ".join(words)
    rows = [{"before": words[i - 1], "quote": words[i].upper(), "after": words[i + 1]} for i in range(1, 59_000, 5)]
    began = time.time()
    assert all(o[2] == "context" for o in verify._in_context(text, rows)) and time.time() - began < 20


def test_a_text_is_folded_once_for_all_its_quotes():
    text = "word ‘said’  here " * 40_000
    began = time.time()
    assert {location.locate(text, "'said' here" + " word" * (i % 2))[2] for i in range(300)} == {"normal"} and time.time() - began < 20
    assert location.locate("a b a", "a", 2) == (4, 5, "exact") and location.locate("a b A", "A b", 5) == (0, 3, "folded") and location.locate("a b a", "a", 9) == (4, 5, "exact")
