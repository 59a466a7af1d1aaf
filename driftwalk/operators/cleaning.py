"""Null dropping, casts and column selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from driftwalk.operators.ordering import ROW

LABEL = "normalized_l_value"
INTERMEDIATE = (ROW, "index", "l_value", "filtered_price", "future_filtered_price")


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Keep rows without a null in any (chosen) column; NaN is a value."""
    names = list(subset) if subset is not None else df.columns
    return df.filter(" AND ".join(f"`{n}` IS NOT NULL" for n in names))


def cast_to_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def select_features(
    columns: Sequence[str],
    price: str,
    features: Sequence[str] | None = None,
    reserved: Sequence[str] = (),
    label: str = LABEL,
) -> list[str]:
    """The feature columns: those asked for, or all that are not reserved.

    Asking for a missing column is no error, selecting none is.
    """
    taken = {*INTERMEDIATE, price, label, *reserved}
    wanted = columns if features is None else [f for f in features if f in columns]
    chosen = [c for c in wanted if c not in taken]
    if not chosen:
        raise ValueError("none of the columns can serve as a feature")
    return chosen


def slice_rows(df: DataFrame, start: int, length: int, index_col: str = ROW) -> DataFrame:
    """Rows ``start`` to ``start + length - 1`` of each series, by index."""
    if start < 0 or length < 0:
        raise ValueError("slice bounds must not be negative")
    return df.filter(F.col(index_col).between(start, start + length - 1))


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    """Raise when ``df`` has no rows; runs a job that stops at the first row."""
    if df.isEmpty():
        raise ValueError(f"{what}: no row without nulls is left")
    return df
