"""Sliding row windows of fixed length, their labels and weighted means."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from driftwalk.functions.columns import decay_weights, whole_div
from driftwalk.operators.ordering import (
    BOUNDED_ROWS,
    PART_ROWS,
    ROW,
    own_rows,
    part_window,
    series_lengths,
    with_halo,
)
from driftwalk.operators.recurrence import part_rows_for


def _windows_in(rows: Column, length: int, stride: int) -> Column:
    """Windows that fit in a run of rows."""
    fits = whole_div(rows - length, stride) + 1
    return F.when(rows >= length, fits).otherwise(F.lit(0).cast("bigint"))


def _check(length: int, stride: int) -> None:
    if length <= 0 or stride <= 0:
        raise ValueError("window length and stride must be positive")


def _per_chunk(chunk_rows: int, length: int, stride: int) -> int:
    return (chunk_rows - length) // stride + 1 if chunk_rows >= length else 0


def _frames(
    df: DataFrame,
    columns: dict[str, Column],
    length: int,
    stride: int,
    series: Sequence[str],
    chunk_rows: int,
    index_col: str,
    part_rows: int,
    keep: Sequence[str],
    ahead: Callable,
) -> DataFrame:
    """Rows that start a complete window, with window expressions over it.

    With chunks (``chunk_rows > 0``) windows stay inside a chunk and the stride
    grid restarts in each; a chunk of modest size is then the part, without a
    halo.
    """
    _check(length, stride)
    i = F.col(index_col)
    if chunk_rows > 0:
        local = i % chunk_rows
        number = F.expr(f"`{index_col}` div {chunk_rows}L") * _per_chunk(chunk_rows, length, stride)
        inside = local + (length - 1) < chunk_rows
    else:
        local, number, inside = i, F.lit(0), F.lit(True)
    if 0 < chunk_rows <= BOUNDED_ROWS:
        part_rows, reach = chunk_rows, 0
    else:
        part_rows, reach = part_rows_for(length - 1, part_rows), length - 1
    frame = with_halo(df, after=reach, part_rows=part_rows, index_col=index_col)
    window = part_window(series, index_col)
    frame = frame.withColumns(ahead(window))
    frame = frame.withColumn("window_end", F.lead(index_col, length - 1).over(window))
    frame = own_rows(frame, part_rows, index_col)
    frame = frame.filter(F.col("window_end").isNotNull() & (local % stride == 0) & inside)
    return frame.select(
        *series,
        (number + whole_div(local, stride)).alias("window_id"),
        i.alias("window_start"),
        "window_end",
        *keep,
        *[c.alias(n) for n, c in columns.items()],
    )


def sliding_windows(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    length: int = 60,
    stride: int = 1,
    series: Sequence[str] = (),
    chunk_rows: int = 0,
    index_col: str = ROW,
    part_rows: int = PART_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """All windows as arrays of feature rows, with the last row's label.

    ``keep`` names columns taken from a window's first row.

    An array repeats each row ``length`` times; use ``window_means`` when a
    summary of the window is enough.
    """

    def ahead(window):
        step = F.struct(*[F.col(f).cast("double").alias(f) for f in features])
        frame = window.rowsBetween(0, length - 1)
        return {
            "__features": F.collect_list(step).over(frame),
            "__window_label": F.lead(label, length - 1).over(window),
        }

    columns = {"features": F.col("__features"), label: F.col("__window_label")}
    return _frames(
        df, columns, length, stride, series, chunk_rows, index_col, part_rows, keep, ahead
    )


def window_means(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    length: int,
    stride: int = 1,
    series: Sequence[str] = (),
    chunk_rows: int = 0,
    decay: float | None = None,
    index_col: str = ROW,
    part_rows: int = PART_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Mean of each feature per window, plain or weighted by geometric decay.

    ``keep`` names columns taken from a window's first row.
    """

    columns = {label: F.col("__window_label")}

    def ahead(window):
        frame = window.rowsBetween(0, length - 1)
        found = {"__window_label": F.lead(label, length - 1).over(window)}
        if decay is None:
            return found | {f"__mean_{f}": F.avg(f).over(frame) for f in features}
        step = F.array(*[F.col(f).cast("double") for f in features])
        return found | {"__steps": F.collect_list(step).over(frame)}

    if decay is None:
        columns = {f: F.col(f"__mean_{f}") for f in features} | columns
    else:
        columns = {"__decayed": _weighted(F.col("__steps"), decay_weights(length, decay))} | columns
    found = _frames(
        df, columns, length, stride, series, chunk_rows, index_col, part_rows, keep, ahead
    )
    if decay is None:
        return found
    # One frame and one sum of vectors per window, however many features there are.
    kept = [c for c in found.columns if c not in ("__decayed", label)]
    means = [F.col("__decayed")[i].alias(f) for i, f in enumerate(features)]
    return found.select(*kept, *means, label)


def _weighted(steps: Column, weights: Sequence[float]) -> Column:
    """Sum of vectors times weights, from the first on; null where a value is missing."""
    scaled = F.zip_with(
        steps, F.array(*map(F.lit, weights)), lambda v, w: F.transform(v, lambda x: x * w)
    )
    return F.reduce(
        F.slice(scaled, 2, max(len(weights) - 1, 1)),
        scaled[0],
        lambda a, v: F.zip_with(a, v, lambda x, y: x + y),
    )


def count_windows(
    df: DataFrame,
    length: int,
    stride: int = 1,
    series: Sequence[str] = (),
    chunk_rows: int = 0,
    index_col: str = ROW,
) -> DataFrame:
    """Windows per series from its length alone."""
    _check(length, stride)
    lengths = series_lengths(df, series, index_col)
    rows = F.col("num_rows")
    if chunk_rows > 0:
        full = F.expr(f"num_rows div {chunk_rows}L") * _per_chunk(chunk_rows, length, stride)
        count = full + _windows_in(rows % chunk_rows, length, stride)
    else:
        count = _windows_in(rows, length, stride)
    return lengths.select(*series, count.alias("num_windows"))


def chunk_statistics(
    chunks: DataFrame, length: int, stride: int = 1
) -> DataFrame:
    """Rows and windows of each chunk of ``chunk_infos``."""
    _check(length, stride)
    return chunks.withColumn("num_windows", _windows_in(F.col("num_rows"), length, stride))


def window_at(
    df: DataFrame,
    ordinal: int,
    features: Sequence[str],
    label: str,
    length: int,
    stride: int = 1,
    series: Sequence[str] = (),
    chunk_rows: int = 0,
    index_col: str = ROW,
) -> DataFrame:
    """The window with the given number in every series that has it.

    The number gives the first row, so only the rows of that window are read.
    Raises ``IndexError`` when no series has so many windows.
    """
    _check(length, stride)
    if ordinal < 0:
        raise IndexError("window number must not be negative")
    if chunk_rows > 0:
        per_chunk = _per_chunk(chunk_rows, length, stride)
        if per_chunk == 0:
            raise IndexError("chunks are shorter than a window")
        start = ordinal // per_chunk * chunk_rows + ordinal % per_chunk * stride
    else:
        start = ordinal * stride
    rows = df.filter(F.col(index_col).between(start, start + length - 1))
    # A window is short and has one group per series, so it is collected whole.
    step = F.struct(index_col, *[F.col(f).cast("double").alias(f) for f in features])
    found = rows.groupBy(*series).agg(
        F.count(F.lit(1)).alias("rows"),
        F.array_sort(F.collect_list(step)).alias("steps"),
        F.max_by(label, index_col).alias(label),
    )
    found = found.filter(F.col("rows") == length)
    if found.isEmpty():
        raise IndexError(f"no window number {ordinal}")
    return found.select(
        *series,
        F.lit(ordinal).cast("bigint").alias("window_id"),
        F.lit(start).cast("bigint").alias("window_start"),
        F.lit(start + length - 1).cast("bigint").alias("window_end"),
        F.transform("steps", lambda s: s.dropFields(index_col)).alias("features"),
        label,
    )


def score_windows(
    windows: DataFrame,
    predict: Callable[[pd.DataFrame], pd.Series],
    output: str = "prediction",
) -> DataFrame:
    """Apply a predictor to batches of windows; it gets a pandas frame per batch."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="features").assign(**{output: predict(batch)})

    kept = windows.drop("features").schema
    return windows.mapInPandas(score, kept.add(output, "double"))


def score_arrays(
    windows: DataFrame,
    predict: Callable[[np.ndarray], np.ndarray],
    output: str = "prediction",
) -> DataFrame:
    """Apply a predictor to dense batches: windows x rows x features, doubles.

    Windows of one table are equally long; null values are NaN. Features stand in the
    order of the ``features`` column.
    """
    kept = windows.drop("features").schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = batch.column("features")
            width = pc.list_value_length(steps)
            if len(width.unique()) > 1:
                raise ValueError("windows of different lengths in one table")
            inner = steps.flatten()
            fields = [inner.field(i).to_numpy(zero_copy_only=False) for i in range(inner.type.num_fields)]
            dense = np.stack([f.astype(float) for f in fields], axis=-1)
            dense = dense.reshape(len(steps), -1, len(fields))
            found = pa.array(np.asarray(predict(dense), float), from_pandas=True)
            columns = [batch.column(n) for n in kept.names]
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*kept.names, output])

    # ``add`` changes a schema in place.
    schema = StructType([*kept.fields, StructField(output, DoubleType())])
    return windows.mapInArrow(score, schema)
