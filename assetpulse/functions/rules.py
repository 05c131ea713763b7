"""Predicates and band rules shared by the queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from ..params import (
    ASSET_BANDS,
    RISK_LEVELS,
    SEVERITIES,
    SEVERITY_MIN_SCORE,
    SEVERITY_WEIGHTS,
)
from .rounding import round_even


def moment(as_of: Column | datetime) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def visible(as_of, started="started_at") -> Column:
    return F.col(started) <= moment(as_of)


def active(as_of, started="started_at", ended="ended_at") -> Column:
    """Closed at both ends."""
    return (F.col(started) <= moment(as_of)) & (F.col(ended) >= moment(as_of))


def anomaly_status(as_of, started="started_at", ended="ended_at") -> Column:
    """``active``, ``resolved``, or null while the anomaly has not started."""
    return F.when(F.col(started) > moment(as_of), None).otherwise(
        F.when(F.col(ended) >= moment(as_of), "active").otherwise("resolved")
    )


def bands(value: Column, table: tuple) -> Column:
    """First name whose lower bound the value reaches; the last name catches the rest."""
    out = F.lit(table[-1][0])
    for name, minimum in reversed(table[:-1]):
        out = F.when(value >= minimum, name).otherwise(out)
    return out


def severity_of(score: Column) -> Column:
    return bands(score, (*SEVERITY_MIN_SCORE, ("low", 0.0)))


def asset_status(score: Column) -> Column:
    return bands(score, ASSET_BANDS)


def risk_level(score: Column) -> Column:
    return bands(score, RISK_LEVELS)


def severity_weight(severity: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, weight in SEVERITY_WEIGHTS.items():
        out = F.when(severity == name, F.lit(weight)).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    """1 for low up to 4 for critical, 0 for anything else."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def severity_of_rank(rank: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int"))


def outside(value: Column, low: Column, high: Column) -> Column:
    """Beyond a limit; a null limit is no limit and equality is allowed."""
    return F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))


def sensor_status(reporting: Column, in_anomaly: Column, warned: Column) -> Column:
    return (
        F.when(~reporting, "offline").when(in_anomaly, "anomaly").when(warned, "warning").otherwise("normal")
    )


def recency_weight(age_hours: Column, half_life_hours: float, max_age_hours: float) -> Column:
    """1 while active (age <= 0), then halved every half-life, 0 beyond the largest age."""
    return (
        F.when(age_hours <= 0, F.lit(1.0))
        .when(age_hours <= max_age_hours, F.pow(F.lit(0.5), age_hours / half_life_hours))
        .otherwise(F.lit(0.0))
    )


def status_chars(table: dict[str, str], status: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, char in table.items():
        out = F.when(status == name, char).otherwise(out)
    return out


def shown(kind: str, value: Column) -> Column:
    """Rounding of published numbers; non-finite values become null."""
    digits = {"value": 3, "z": 2, "score": 3, "coord": 6, "distance": 1}[kind]
    return F.when(F.abs(value) < float("inf"), round_even(value, digits))
