"""Spans as half-open code-point ranges: predicates and measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common length over joint length, 0 for disjoint spans."""
    common = intersection(s1, e1, s2, e2)
    return F.when(common > 0, common / (F.greatest(e1, e2) - F.least(s1, s2))).otherwise(F.lit(0.0))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(s1, s2) < F.least(e1, e2)


def contains(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= s2) & (e2 <= e1)


def span_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def clipped(start: Column, end: Column, n: Column) -> tuple[Column, Column]:
    """Bounds moved into [0, n]."""
    return F.greatest(F.lit(0), F.least(start, n)), F.greatest(F.lit(0), F.least(end, n))


def trimmed(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds without white space at either end of the span."""
    body = span_text(text, start, end)
    left = F.length(body) - F.length(F.regexp_replace(body, r"^[ \t\r\n\f\x0B]+", ""))
    right = F.length(body) - F.length(F.regexp_replace(body, r"[ \t\r\n\f\x0B]+$", ""))
    return start + left, end - right


def length_penalty(length: Column, mu: Column, sigma: Column, position: Column, mode: Column, w_length: float = 0.4, w_position: float = 0.6) -> Column:
    """How far a span is from the usual length (in deviations of its logarithm) and place."""
    return w_length * F.abs((F.ln(F.greatest(length, F.lit(1))) - mu) / sigma) + w_position * F.abs(position - mode)
