"""Rounding as plain double arithmetic, which stays in generated code (no per-row decimal objects)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_even(value: Column, digits: int = 0) -> Column:
    """Scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def round_up(value: Column, digits: int = 0) -> Column:
    """Scale, round halves up, scale back."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def finite_or_null(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.abs(value) < float("inf"), value)
