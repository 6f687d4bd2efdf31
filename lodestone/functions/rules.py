"""Scores, verdicts and other ordered rules as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
STRENGTH_RANK = {"strong": 3, "moderate": 2, "weak": 1}
VERDICT_HEALTH = {"Verified Artist": 100, "Likely Authentic": 85, "Inconclusive": 50, "Insufficient Data": 50, "Conflicting Signals": 50, "Suspicious": 25, "Likely Artificial": 0}
VERDICT_RANGE = {"Verified Artist": (82, 100), "Likely Authentic": (58, 81), "Inconclusive": (38, 57), "Insufficient Data": (38, 57), "Conflicting Signals": (38, 57), "Suspicious": (18, 37), "Likely Artificial": (0, 17)}
CONFIDENCE = {"high": 0.85, "medium": 0.55, "low": 0.25}
REVIEW_AT = {"songwriter": 3, "label": 5, "publisher": 2, "distributor": 5}


def lookup(values: dict, key: Column) -> Column:
    """The value of a literal map, null for other keys."""
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))[key]


def score_label(score: Column) -> Column:
    return F.when(score >= 82, "Verified Artist").when(score >= 58, "Likely Authentic").when(score >= 38, "Inconclusive").when(score >= 18, "Suspicious").otherwise("Likely Artificial")


def clamp(x: Column, low: int = 0, high: int = 100) -> Column:
    """Truncated to a whole number within the bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x.cast("int")))


def is_flagged(verdict: Column) -> Column:
    return verdict.isin("Suspicious", "Likely Artificial")
