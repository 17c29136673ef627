"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.settings import Scoring


def recency_bonus(last: Column, now: Column, s: Scoring = Scoring()) -> Column:
    """0 for what was never accessed, else a bonus that decays by day; the future counts as now."""
    days = F.timestamp_diff("SECOND", last, now) / 86400.0
    return F.when(last.isNull(), 0.0).otherwise(s.recency_max * F.exp(-s.recency_decay * F.greatest(F.lit(0.0), days)))


def effective_score(relevance: Column, useful: Column, stale: Column, last: Column, now: Column, is_note: Column | None = None, note_bonus: float = 0.0, s: Scoring = Scoring()) -> Column:
    out = relevance + s.usefulness_weight * useful - s.staleness_weight * stale + recency_bonus(last, now, s)
    return out + F.when(is_note, note_bonus).otherwise(0.0) if is_note is not None else out


def raised(score: Column, by: Column, cap: float = 10.0) -> Column:
    return F.least(F.lit(cap), score + by)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for vectors of different lengths, of length 0 or of norm 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
