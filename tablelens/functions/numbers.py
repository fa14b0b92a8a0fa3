"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def half_up(value: Column, digits: int) -> Column:
    """Round with ties towards +infinity, the rule of the interactive statistics.

    A double of 2**52 / 10**digits or more has no such digits and stays as it is.
    """
    scale = float(10**digits)
    number = value.cast("double")
    shifted = number * scale + 0.5
    rounded = (shifted - F.pmod(shifted, F.lit(1.0))) / F.lit(scale)
    return F.when(F.abs(number) >= 2.0**52 / scale, number).otherwise(rounded)


def half_even(value: Column, digits: int) -> Column:
    """Round with ties to the even digit, the rule of the forecasting and modelling results."""
    return F.bround(value, digits)


def finite(value: Column) -> Column:
    """NaN and the infinities become null."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def safe_numeric(value: Column, dtype: T.DataType | None = None) -> Column:
    """Coerce to double; unreadable text, NaN and the infinities become null."""
    if dtype is not None and isinstance(dtype, (T.NumericType, T.BooleanType)):
        return finite(value)
    text = value.cast("string")
    return finite(F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double")))


def two_sided_normal_p(z: Column) -> Column:
    """Two-sided tail probability of a standard normal, by the Abramowitz-Stegun 7.1.26 error function."""
    # fixed values: published polynomial coefficients of formula 7.1.26
    p, coefficients = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + p * x)
    polynomial = F.lit(0.0)
    for coefficient in reversed(coefficients):
        polynomial = (polynomial + coefficient) * t
    return polynomial * F.exp(-x * x)
