"""Subtypes, richness and the profile of a document's wording, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .text import ascii_words, lexicon_share


def has_cue(text: Column, cues: Sequence[str]) -> Column:
    """Whether one of the cues stands in the text as whole words, whatever its case."""
    return text.rlike(r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(cues) + r")(?![A-Za-z0-9_])")


def subtype(text: Column, label: Column) -> Column:
    non = F.when(has_cue(text, lx.CUES_DEBUNK), "non_debunking").when(has_cue(text, lx.CUES_MUNDANE), "non_mundane").otherwise("non_reporting")
    con = F.when(has_cue(text, lx.CUES_EVANGELIST), "con_evangelist").when(has_cue(text, lx.CUES_INSIDER), "con_insider").otherwise("con_general")
    return F.when(label == "non", non).when(label == "conspiracy", con).when(label == "cant_tell", "ambiguous").otherwise("unknown")


def richness(text: Column, label: Column, kind: Column, tokens: Column, n_spans: Column, confusing: Column) -> tuple[Column, Column]:
    """Score of a document as an example, and whether it is a hard negative. kind: its subtype; confusing: an Action overlaps an Effect."""
    hard = ((label == "non") & (n_spans > 0)) | (kind == "non_debunking")
    one = lambda c, v: F.when(c, v).otherwise(0.0)
    intense = F.when(label == "conspiracy", lexicon_share(tokens, lx.ABSOLUTIST) > 0.015).when(label == "non", lexicon_share(tokens, lx.HEDGES) > 0.015).otherwise(F.lit(False))
    score = one((F.length(text) > 200) & (F.length(text) < 2000), 1.0) + one(kind != "unknown", 1.0) - one(confusing, 5.0) + one(intense, 2.0) + one(hard, 3.0)
    return F.round(score, 3), hard


def profile(text: Column) -> dict[str, Column]:
    """Shares of attributing, hedging, intense and passive words, of capitals, and questions per sentence; rounded half to even."""
    words = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z]+(?![A-Za-z0-9_])"), F.lit(0))
    low = ascii_words(text)
    n = F.greatest(F.size(words), F.lit(1))
    share = lambda terms: F.size(F.filter(low, lambda w: w.isin(*terms))) / n
    questions = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    density = questions / (F.regexp_count(text, F.lit("[.!?]+")) + 1)
    hedged = share(lx.UNCERTAINTY)
    shouted = F.size(F.filter(words, lambda w: (F.length(w) > 1) & (w == F.upper(w)))) / n
    return {
        "attribution_density": F.bround(share(lx.ATTRIBUTION) * 100, 2), "uncertainty_ratio": F.bround(hedged, 3), "epistemic_intensity": F.bround(share(lx.INTENSITY), 3), "agency_gap": F.bround(share(lx.PASSIVE), 3),
        "question_density": F.bround(density, 2), "shouting_score": F.bround(shouted, 3), "is_jaqing": (density > 0.35) & (hedged > 0.05),
    }


def warnings(attribution: Column, jaqing: Column, shouting: Column, agency: Column) -> Column:
    """Names of what stands out in a profile."""
    return F.array_compact(F.array(F.when(attribution > 3.5, F.lit("attribution")), F.when(jaqing, F.lit("jaq")), F.when(shouting > 0.10, F.lit("emotion")), F.when(agency > 0.06, F.lit("passive"))))
