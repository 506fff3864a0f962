"""Numeric and label rules on atoms: importance, activation, states, latent scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thoughtloom.functions.rounding import round_half_even

# State thresholds (at least -> focus, at most -> latent).
GRAPH_STATE = (0.55, 0.35)
NOTE_STATE = (0.65, 0.25)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def score_importance(role: Column, text: Column, kind: Column, tags: Column) -> Column:
    score = (
        F.lit(0.2)
        + F.when(role == "user", F.lit(0.15)).otherwise(F.lit(0.0))
        + F.when(kind.isin("idea", "decision", "question"), F.lit(0.2))
        .when(kind.isin("objection", "analogy"), F.lit(0.15))
        .otherwise(F.lit(0.0))
        + F.least(F.lit(0.15), F.size(tags) * F.lit(0.03))
        + F.when(F.length(text) > 120, F.lit(0.08)).otherwise(F.lit(0.0))
    )
    # A sum of two-decimal constants is never near a tie of the third decimal.
    return F.floor(clamp(score, 0.05, 0.95) * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)


def initial_activation(importance: Column, factor: float = 0.65, floor: float = 0.1) -> Column:
    return clamp(importance * F.lit(factor), floor, 0.65)


def model_importance(confidence: Column) -> Column:
    return round_half_even(clamp(F.lit(0.25) + confidence * F.lit(0.55), 0.05, 0.95), 3)


def activation_state(activation: Column, thresholds: tuple[float, float] = GRAPH_STATE) -> Column:
    focus, latent = thresholds
    return (
        F.when(activation >= focus, F.lit("focus"))
        .when(activation <= latent, F.lit("latent"))
        .otherwise(F.lit("active"))
    )


def edge_type(relation: Column) -> Column:
    return (
        F.when(relation == "inspire_feedback", F.lit("inspire_feedback"))
        .when(F.startswith(relation, F.lit("shared_tags:")), F.lit("shared_tags"))
        .otherwise(F.lit("other"))
    )


def novelty(activation: Column) -> Column:
    return F.lit(1.0) - F.least(F.lit(1.0), activation)


def reliable_score(importance: Column, activation: Column, tag_hits: Column) -> Column:
    return importance * F.lit(0.55) + novelty(activation) * F.lit(0.35) + tag_hits * F.lit(0.1)


def weird_score(importance: Column, activation: Column, overlap: Column) -> Column:
    rarity = F.lit(1.0) - F.least(F.lit(1.0), importance)
    return novelty(activation) * F.lit(0.55) + overlap * F.lit(0.3) + rarity * F.lit(0.15)
