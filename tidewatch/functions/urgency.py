"""Urgency of an incident, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col


def keyword_weight(flag) -> Column:
    """Share of posts that carry an urgent word (an aggregate)."""
    return F.avg(_col(flag).cast("double"))


def seconds_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(1e6)


def recency_weight(last_seen, as_of, minutes: float = 30) -> Column:
    """1 for a post of this moment, 0 from ``minutes`` on; a later post exceeds 1."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - seconds_between(last_seen, as_of) / F.lit(minutes * 60.0))


def urgency_score(keyword, density, recency) -> Column:
    """Weighted sum in [0, 1]; the order of the additions matters at the label bounds."""
    total = F.lit(0.4) * _col(keyword) + F.lit(0.4) * _col(density) + F.lit(0.2) * _col(recency)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def urgency_label(score, critical: float = 0.7, high: float = 0.4) -> Column:
    score = _col(score)
    return F.when(score >= critical, "CRITICAL").when(score >= high, "HIGH").otherwise("MODERATE")
