"""Hazard classes and the status vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Class names, most severe first, and ledger states.
HAZARD_CLASSES = ("Critical", "High", "Medium", "Low")
ETL_STATES = ("running", "completed", "failed")

# Class limits. All comparisons are strict.
CRITICAL_MISS_AU = 0.05
HIGH_DIAMETER_KM = 0.5
HIGH_SPEED_KM_S = 20.0
HIGH_MISS_AU = 0.1
MEDIUM_DIAMETER_KM = 0.1
MEDIUM_SPEED_KM_S = 10.0


def _above(value: Column, limit: float) -> Column:
    # Spark orders NaN above every number; a missing measurement must not raise the class.
    return (value > F.lit(limit)) & ~F.isnan(value)


def _below(value: Column, limit: float) -> Column:
    return value < F.lit(limit)


def classify_hazard(
    diameter_max_km: Column, speed_km_s: Column, miss_au: Column, is_pha: Column
) -> Column:
    """First matching class, from most to least severe."""
    fast_and_close = _above(speed_km_s, HIGH_SPEED_KM_S) & _below(miss_au, HIGH_MISS_AU)
    return (
        F.when(is_pha & _below(miss_au, CRITICAL_MISS_AU), F.lit("Critical"))
        .when(_above(diameter_max_km, HIGH_DIAMETER_KM) | fast_and_close, F.lit("High"))
        .when(
            _above(diameter_max_km, MEDIUM_DIAMETER_KM) | _above(speed_km_s, MEDIUM_SPEED_KM_S),
            F.lit("Medium"),
        )
        .otherwise(F.lit("Low"))
    )


def severity_rank(hazard: Column) -> Column:
    """0 for the most severe class; unknown names rank with the mildest."""
    rank = F.lit(len(HAZARD_CLASSES) - 1)
    for position, name in enumerate(HAZARD_CLASSES[:-1]):
        rank = F.when(hazard == name, F.lit(position)).otherwise(rank)
    return rank


def normalise_hazard(text: Column) -> Column:
    """Case-sensitive; anything unknown becomes the mildest class."""
    return F.when(text.isin(*HAZARD_CLASSES), text).otherwise(F.lit("Low"))


def normalise_status(text: Column) -> Column:
    """Case-insensitive; anything unknown counts as still running."""
    lowered = F.lower(text)
    return F.when(lowered.isin(*ETL_STATES), lowered).otherwise(F.lit("running"))


def has_status(text: Column, state: str) -> Column:
    if state not in ETL_STATES:
        raise ValueError(f"unknown state {state!r}")
    return normalise_status(text) == state
