"""Scores: recency, use, retention, blends, retry times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE, EXEMPT, PRUNE_DAYS, FLOOR = 30.0, 0.75, 30.0, 0.05
#: Weights of fused rank, importance, confidence, recency, use.
WEIGHTS = (0.5, 0.2, 0.1, 0.1, 0.1)


def recency(days: Column, half_life: float = HALF_LIFE) -> Column:
    return F.pow(F.lit(0.5), days / F.lit(half_life))


def use(count: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(count.cast("double")) / F.log(F.lit(11.0)))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def derived_importance(recent: Column, used: Column, explicit: Column) -> Column:
    return clamp(0.4 * recent + 0.3 * used + 0.3 * explicit)


def retention(days: Column, count: Column, importance: Column) -> Column:
    """The forgetting curve: slower with use and importance."""
    return F.exp(-days / ((1 + 2 * count) * (1 + 4 * importance)))


def should_prune(days: Column, count: Column, importance: Column) -> Column:
    return (importance < EXEMPT) & (days >= PRUNE_DAYS) & (retention(days, count, importance) < FLOOR)


def fact_blend(fused: Column, importance: Column, confidence: Column, recent: Column, used: Column) -> Column:
    return sum((w * c for w, c in zip(WEIGHTS, (fused, importance, confidence, recent, used))), F.lit(0.0))


def preference_blend(fused: Column, confidence: Column, recent: Column) -> Column:
    return (WEIGHTS[0] + WEIGHTS[1] + WEIGHTS[4]) * fused + WEIGHTS[2] * confidence + WEIGHTS[3] * recent


def procedure_blend(fused: Column, success: Column, recent: Column) -> Column:
    """How often a procedure works stands in for importance."""
    return (WEIGHTS[0] + WEIGHTS[2] + WEIGHTS[4]) * fused + WEIGHTS[1] * success + WEIGHTS[3] * recent


def plain_blend(fused: Column, recent: Column) -> Column:
    return (1 - WEIGHTS[3]) * fused + WEIGHTS[3] * recent


def next_retry(attempts: Column, now: Column, most: int, base_s: int = 60, longest_s: int = 21_600) -> Column:
    """Null once attempts are used up, else now and base * 2^attempts seconds, six hours at most."""
    wait = F.least(F.lit(float(longest_s)), base_s * F.pow(F.lit(2.0), attempts.cast("double")))
    return F.when(attempts < most, F.timestamp_micros((F.unix_micros(now) + wait * 1_000_000).cast("long")))
