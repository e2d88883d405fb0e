"""Numeric column builders: signals, priors and the linear score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unbrev.settings import (
    COST_UNIT,
    MAX_PMI,
    RECENCY_HALF_LIFE,
    REGISTER_MIN_MASS,
    REGISTER_THRESHOLD,
    Weights,
)

# Signals of one candidate, in the order in which they are summed.
SIGNALS = (
    "skeleton", "suffix", "prefix", "edit", "freq",
    "context", "user", "morph", "recency",
)
# Scores are compared at this precision, so that equal sums stay equal.
SCORE_DIGITS = 9


def log_frequency(freq: Column) -> Column:
    usable = (freq > 0) & ~F.isnan(freq.cast("double"))
    return F.log1p(F.when(usable, freq.cast("double")).otherwise(0.0))


def linear_score(
    weights: Weights | dict[str, Column], signals: dict[str, Column] | None = None
) -> Column:
    """Weighted sum of the signals; the edit distance counts against."""
    if isinstance(weights, Weights):
        weights = {k: F.lit(v) for k, v in weights.as_dict().items()}
    signals = signals or {s: F.col(f"s_{s}") for s in SIGNALS}
    total = weights["skeleton"] * signals["skeleton"]
    for name in SIGNALS[1:]:
        term = weights[name] * signals[name]
        total = total - term if name == "edit" else total + term
    return F.round(total, SCORE_DIGITS)


def edit_signal(distance: Column) -> Column:
    return distance / F.lit(float(COST_UNIT))


def positive_pmi(pair: Column, total: Column, prev: Column, word: Column) -> Column:
    """Log association of an adjacent pair, between 0 and the ceiling."""
    ratio = pair.cast("double") * total.cast("double") / (
        prev.cast("double") * word.cast("double")
    )
    usable = (prev > 0) & (word > 0) & (total > 0) & (pair > 0)
    value = F.least(F.lit(MAX_PMI), F.greatest(F.lit(0.0), F.ln(ratio)))
    return F.coalesce(F.when(usable, value), F.lit(0.0))


def history_prior(confirmed: Column, reverted: Column, form_count: Column) -> Column:
    conf, rev, seen = (
        F.coalesce(c, F.lit(0)).cast("double") for c in (confirmed, reverted, form_count)
    )
    return 2.0 * (F.log1p(conf) - F.log1p(rev)) + 0.5 * F.log1p(seen)


def recency_prior(
    now: Column, seen: Column, half_life: float = RECENCY_HALF_LIFE
) -> Column:
    decayed = F.pow(F.lit(0.5), (now - seen).cast("double") / half_life)
    return F.coalesce(decayed, F.lit(0.0))


def register(score: Column, mass: Column) -> Column:
    """Polite, neutral or crude, from decayed marker sums.

    Compared at the precision of scores, so that a mass that has decayed to
    exactly the limit counts as reaching it.
    """
    weight = F.round(F.coalesce(mass, F.lit(0.0)), SCORE_DIGITS)
    tone = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score / mass)), SCORE_DIGITS)
    return (
        F.when(weight < REGISTER_MIN_MASS, "neutral")
        .when(tone > REGISTER_THRESHOLD, "polite")
        .when(tone < -REGISTER_THRESHOLD, "crude")
        .otherwise("neutral")
    )


def keystroke_savings(typed: Column, expected: Column) -> Column:
    full = F.length(expected)
    saved = 1.0 - F.length(typed) / full
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), saved))
    return F.when(full > 0, clamped).otherwise(0.0)
