"""Rolling tasks: support rows followed by query rows, stepped along a series.

Task ``k`` starts at row ``k * interval`` of its split, so membership of a row
or window in tasks is arithmetic; no task table is joined to the rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from driftwalk.functions.columns import whole_div
from driftwalk.operators.splits import SPLIT

TASK = "task_id"
SUPPORT, QUERY = "support", "query"
_FAN = 4096


@dataclass(frozen=True)
class TaskShape:
    """Lengths of a rolling task, in rows."""

    support: int = 7200
    query: int = 3600
    interval: int = 3600
    seq_length: int = 10

    def __post_init__(self) -> None:
        if min(self.support, self.query, self.interval, self.seq_length) <= 0:
            raise ValueError("all task lengths must be positive")

    @property
    def total(self) -> int:
        return self.support + self.query

    def count(self, rows: Column) -> Column:
        """Tasks in a split of ``rows`` rows; none when it is too short."""
        room = rows - (self.total + self.seq_length + 1)
        fits = whole_div(room, self.interval) + 1
        return F.when(room >= 0, fits).otherwise(F.lit(0).cast("bigint"))

    @property
    def unit(self) -> int:
        """Longest run of rows that all tasks contain whole or not at all."""
        return math.gcd(self.support, self.query, self.interval)


def rolling_tasks(bounds: DataFrame, shape: TaskShape, series: Sequence[str] = ()) -> DataFrame:
    """The tasks of every split, with inclusive bounds in rows of the series.

    A long split is fanned out in two steps, so no row holds all its tasks.
    """
    counted = bounds.withColumn("__tasks", shape.count(F.col("split_rows")))
    counted = counted.filter("__tasks > 0")
    fans = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__tasks - 1L) div {_FAN}L"))
    fanned = counted.withColumn("__fan", F.explode(fans))
    first = F.col("__fan") * _FAN
    last = F.least(first + (_FAN - 1), F.col("__tasks") - 1)
    start = F.col("split_start") + F.col(TASK) * shape.interval
    return fanned.withColumn(TASK, F.explode(F.sequence(first, last))).select(
        *series,
        SPLIT,
        TASK,
        start.alias("support_start"),
        (start + (shape.support - 1)).alias("support_end"),
        (start + shape.support).alias("query_start"),
        (start + (shape.total - 1)).alias("query_end"),
    )


def require_tasks(tasks: DataFrame) -> DataFrame:
    """Raise without train or valid tasks, warn without test tasks."""
    found = {row[SPLIT] for row in tasks.select(SPLIT).distinct().collect()}
    if not {"train", "valid"} <= found:
        raise ValueError("training and validation need at least one task each")
    if "test" not in found:
        warnings.warn("no test tasks: the online pass has nothing to test", stacklevel=2)
    return tasks


def task_chunks(tasks: DataFrame, chunk_rows: int) -> DataFrame:
    """Chunks a task reads and its bounds as offsets in the outer ones."""
    if chunk_rows <= 0:
        raise ValueError("chunk size must be positive")

    def chunk(name: str) -> Column:
        return F.expr(f"{name} div {chunk_rows}L")

    columns = {}
    for part in (SUPPORT, QUERY):
        columns[f"{part}_chunks"] = F.sequence(chunk(f"{part}_start"), chunk(f"{part}_end"))
        columns[f"{part}_start_offset"] = F.col(f"{part}_start") % chunk_rows
        columns[f"{part}_end_offset"] = F.col(f"{part}_end") % chunk_rows
    return tasks.withColumns(columns)


def assign_tasks(
    rows: DataFrame,
    shape: TaskShape,
    length: int | None = None,
) -> DataFrame:
    """Repeat each row (or window start) for every task whose range holds it.

    Adds ``task_id`` and ``part``. ``length`` rows from ``split_row`` on must
    lie in the range: 1 for rows, the window length for windows. Both range
    ends are inclusive; a window that runs over the end of its range, or over
    the border of support and query, belongs to neither.
    """
    length = shape.seq_length if length is None else length
    r = F.col("split_row")
    # The quotient rounds up where it is positive; else the first task is 0.
    first = whole_div(r + (length - shape.total + shape.interval - 1), shape.interval)
    first = F.greatest(first, F.lit(0).cast("bigint"))
    last = F.least(whole_div(r, shape.interval), shape.count(F.col("split_rows")) - 1)
    covered = F.when(first <= last, F.sequence(first, last))
    found = rows.withColumn(TASK, F.explode(covered))
    offset = r - F.col(TASK) * shape.interval
    part = F.when(offset <= shape.support - length, SUPPORT).when(
        (offset >= shape.support) & (offset <= shape.total - length), QUERY
    )
    return found.withColumn("part", part).filter(F.col("part").isNotNull())
