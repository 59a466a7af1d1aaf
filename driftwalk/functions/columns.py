"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def col_of(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def known(value: str | Column) -> Column:
    """The value with NaN turned into null, so that aggregates skip both."""
    value = col_of(value)
    return F.when(~F.isnan(value), value)


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """Clamp to [low, high]; null and NaN stay as they are."""
    low, high = (F.lit(b) if not isinstance(b, Column) else b for b in (low, high))
    return (
        F.when(F.isnan(value), value)
        .when(value < low, low)
        .when(value > high, high)
        .otherwise(value)
    )


def whole_div(value: Column, by: int) -> Column:
    """Integer quotient, cut towards zero; exact for any bigint."""
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def total(columns: list[Column]) -> Column:
    """The sum of one or more columns."""
    return reduce(add, columns)


def decay_weights(length: int, rate: float) -> list[float]:
    """Geometric weights that sum to one, the last position weighing most."""
    if length <= 0:
        raise ValueError("length must be positive")
    raw = [rate ** (length - 1 - i) for i in range(length)]
    return [w / sum(raw) for w in raw]
