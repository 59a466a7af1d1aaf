"""Trend labels and their scaling to [-1, 1]."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftwalk.functions.columns import known
from driftwalk.operators.cleaning import LABEL
from driftwalk.operators.ordering import (
    PART_ROWS,
    ROW,
    attach_by_part,
    own_rows,
    with_halo,
)
from driftwalk.operators.recurrence import (
    BLOCK,
    HighPass,
    add_high_pass,
    block_window,
    part_rows_for,
)

# Below this spread or deviation a label stays 0.
SMALL = 1e-9

MEAN, SPREAD, LOW, HIGH = "__mean", "__spread", "__low", "__high"


def trend_labels(
    df: DataFrame,
    price: str = "mid_price",
    filter_length: float = 10.0,
    shift_length: int = 10,
    series: Sequence[str] = (),
    index_col: str = ROW,
    part_rows: int = PART_ROWS,
    keep_part: bool = False,
) -> DataFrame:
    """Relative distance from the raw price to the filtered price ahead.

    Adds ``filtered_price``, ``future_filtered_price`` and ``l_value``. The
    filter's warm-up rows and the look-ahead rows share one halo, so filter and
    shift cost one shuffle. A zero price gives a null label. ``keep_part``
    leaves the part of each row, for what else runs on that layout.
    """
    if shift_length < 0:
        raise ValueError("shift length must not be negative")
    shape = HighPass(filter_length)
    part_rows = part_rows_for(max(shape.warm_up, shift_length), part_rows)
    frame = with_halo(df, shape.warm_up, shift_length, part_rows, index_col)
    frame = add_high_pass(frame, price, shape, series, index_col, "__residual")
    frame = frame.withColumn("filtered_price", F.col(price) - F.col("__residual")).drop("__residual")
    frame = frame.withColumn(
        "future_filtered_price",
        F.lead("filtered_price", shift_length).over(block_window(series, index_col)),
    )
    change = f"try_divide(future_filtered_price - `{price}`, `{price}`)"
    frame = frame.withColumn("l_value", F.expr(change))
    return own_rows(frame, part_rows, index_col, keep_part).drop(BLOCK)


def label_statistics(label: str) -> list[Column]:
    """Mean, population spread and extremes; enough for clipping and scaling.

    Clipping keeps order, so the largest clipped label is the clipped largest
    label: one pass gives the extremes after clipping too.
    """
    return [
        F.avg(label).alias(MEAN),
        F.stddev_pop(label).alias(SPREAD),
        F.min(label).alias(LOW),
        F.max(label).alias(HIGH),
    ]


def scaled_label(label: str, num_std: float) -> Column:
    """Scale a label by the statistics columns next to it; null and NaN stay."""
    reach = f"{float(num_std)!r}D * {SPREAD}"

    def deviation(value: str) -> str:
        clipped = f"least(greatest({value}, {MEAN} - {reach}), {MEAN} + {reach})"
        return f"({clipped} - {MEAN})"

    own, up, down = deviation(f"`{label}`"), deviation(HIGH), deviation(LOW)
    return F.expr(
        f"""CASE WHEN `{label}` IS NULL OR isnan(`{label}`) THEN `{label}`
                 WHEN {SPREAD} <= {SMALL}D THEN 0D
                 WHEN {own} > 0 AND {up} > {SMALL}D THEN {own} / {up}
                 WHEN {own} < 0 AND {down} < -{SMALL}D THEN -{own} / {down}
                 ELSE 0D END"""
    )


def normalize_labels(
    df: DataFrame,
    label: str = "l_value",
    series: Sequence[str] = (),
    num_std: float = 5.0,
    output: str = LABEL,
    fit_rows: Column | None = None,
    index_col: str = ROW,
    bounded: bool = False,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Clip to mean +- ``num_std`` spreads, then scale each side by its extreme.

    Statistics are those of the series, over all rows or over ``fit_rows``.
    With bounded series they are window aggregates on the partitioning the rows
    already have; else one aggregate, attached again part by part.
    """
    fitted = known(label) if fit_rows is None else F.when(fit_rows, known(label))
    frame = df.withColumn("__fitted", fitted)
    statistics = label_statistics("__fitted")
    names = [MEAN, SPREAD, LOW, HIGH]
    if bounded and series:
        whole = Window.partitionBy(*series)
        frame = frame.withColumns(
            {
                MEAN: F.avg("__fitted").over(whole),
                SPREAD: F.stddev_pop("__fitted").over(whole),
                LOW: F.min("__fitted").over(whole),
                HIGH: F.max("__fitted").over(whole),
            }
        )
    else:
        per_series = frame.groupBy(*series).agg(
            *statistics, (F.max(index_col) + 1).alias("num_rows")
        )
        frame = attach_by_part(frame, per_series, series, index_col, part_rows)
    return frame.withColumn(output, scaled_label(label, num_std)).drop("__fitted", *names)
