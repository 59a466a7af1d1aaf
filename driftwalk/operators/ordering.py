"""Order made explicit: row indices, running sums, and parts with halos.

Long series never meet in one task. Where a whole series is known to be short
its rows are ordered by one window; otherwise the table is range-partitioned by
(series, order), and per-slice totals carry the running values across slices.
Ordered frames later run on *parts*: runs of ``part_rows`` rows of one series,
each extended by copies of the neighbouring rows (the halo) that a frame needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from driftwalk.operators.joins import attach, broadcast_if_small
from driftwalk.staging import stage

ROW = "row_idx"
PART = "__part"
PART_ROWS = 65_536
BOUNDED_ROWS = 1_000_000
# Bytes from which a table is cut into more slices than the session shuffles to, and
# slices whose totals one window sums up.
SLICE_BYTES = 256 << 20
BLOCK_SLICES = 1024

_SLICE = "__slice"
_POSITION = "__position"
_LOCAL = "__local"


def groups_are_bounded(
    df: DataFrame, group: Sequence[str], row_limit: int = BOUNDED_ROWS
) -> bool:
    """Whether every group has at most ``row_limit`` rows (one counting job)."""
    if not group:
        return False
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"))
    largest = sizes.agg(F.max("rows")).first()[0]
    return (largest or 0) <= row_limit


def _plain_bytes(df: DataFrame) -> int | None:
    """Estimated size of a table that is read and filtered; None where joins or the like
    make the estimate a guess, and where rows come from elsewhere than storage, whose size
    counts as the largest number there is."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(word in plan.toString() for word in ("Join", "Generate", "Aggregate", "Expand", "LogicalRDD")):
        return None
    return int(str(plan.stats().sizeInBytes()))


def _slice_count(df: DataFrame, slices: int | None) -> tuple[int | None, int]:
    """Slices to ask for (None: as many as the session shuffles to), and their number."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if slices is None and (size := _plain_bytes(df)) and size > usual * SLICE_BYTES:
        slices = -(-size // SLICE_BYTES)
    return slices, slices or usual


def _sliced(df: DataFrame, keys: Sequence[str], slices: int | None) -> DataFrame:
    """Range-partition by ``keys``, sort, and store slice number and position."""
    spread = (
        df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    )
    return stage(
        spread.sortWithinPartitions(*keys).select(
            "*",
            F.spark_partition_id().alias(_SLICE),
            F.monotonically_increasing_id().alias(_POSITION),
        ),
        "sliced",
    )


def _totals_before(
    rows: DataFrame,
    group: Sequence[str],
    names: list[str],
    count: int,
    block: int,
    at: str = _SLICE,
) -> DataFrame:
    """Totals of all earlier rows of the group, one small row per place ``at``.

    Up to ``block`` places of a group are one window. More are summed up in blocks of
    that many, whose own totals before are found in the same way, so that no task ever
    orders more than a block, however many slices a table has.
    """
    kept = [c for c in rows.columns if c not in names]
    if count <= block:
        earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy(at)
    else:
        rows = rows.withColumn(f"{at}_block", F.expr(f"{at} div {block}"))
        earlier = Window.partitionBy(*group, f"{at}_block").orderBy(at)
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    inside = [F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}__before") for n in names]
    if count <= block:
        return rows.select(*kept, *inside)
    keys = [*group, f"{at}_block"]
    blocks = rows.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    blocks = _totals_before(blocks, group, names, -(-count // block), block, f"{at}_block")
    blocks = blocks.withColumnsRenamed({f"{n}__before": f"{n}__ahead" for n in names})
    both = attach(rows.select(*kept, f"{at}_block", *inside), blocks, keys)
    return both.select(
        *kept, *[(F.col(f"{n}__before") + F.col(f"{n}__ahead")).alias(f"{n}__before") for n in names]
    )


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    bounded: bool | None = None,
    slices: int | None = None,
    block_slices: int = BLOCK_SLICES,
) -> DataFrame:
    """Inclusive running sums in order within each group.

    ``order`` must be unique within a group. ``bounded=True`` states that every
    group is short; left out, the group sizes are counted.
    """
    group, order = list(group), list(order)
    if bounded is None:
        bounded = groups_are_bounded(df, group)
    if bounded and group:
        upto = (
            Window.partitionBy(*group)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        return df.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()})
    names = list(sums)
    slices, count = _slice_count(df, slices)
    laid = _sliced(df.withColumns(sums), [*group, *order], slices)
    per_slice = laid.groupBy(*group, _SLICE).agg(*[F.sum(n).alias(n) for n in names])
    before = broadcast_if_small(_totals_before(per_slice, group, names, count, block_slices))
    inside = (
        Window.partitionBy(*group, _SLICE)
        .orderBy(_POSITION)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = laid.withColumns({n: F.sum(n).over(inside) for n in names})
    return (
        attach(local, before, [*group, _SLICE])
        .withColumns({n: F.col(n) + F.col(f"{n}__before") for n in names})
        .drop(_SLICE, _POSITION, *[f"{n}__before" for n in names])
    )


def index_rows(
    df: DataFrame,
    order: Sequence[str],
    series: Sequence[str] = (),
    index_col: str = ROW,
    bounded: bool | None = None,
    slices: int | None = None,
    block_slices: int = BLOCK_SLICES,
) -> DataFrame:
    """Add a contiguous 0-based row index per series; keep an existing one.

    ``order`` must break all ties. Without series columns the table is one long
    series.
    """
    if index_col in df.columns:
        return df.withColumn(index_col, F.col(index_col).cast("bigint"))
    series, order = list(series), list(order)
    if bounded is None:
        bounded = groups_are_bounded(df, series)
    if bounded and series:
        ordered = Window.partitionBy(*series).orderBy(*order)
        return df.withColumn(index_col, F.row_number().over(ordered).cast("bigint") - 1)
    slices, count = _slice_count(df, slices)
    laid = _sliced(df, [*series, *order], slices)
    per_slice = laid.groupBy(*series, _SLICE).agg(
        F.min(_POSITION).alias("__first_position"),
        F.count(F.lit(1)).alias("__rows"),
    )
    before = broadcast_if_small(
        _totals_before(per_slice, series, ["__rows"], count, block_slices)
    )
    return (
        attach(laid, before, [*series, _SLICE])
        .withColumn(
            index_col, F.col(_POSITION) - F.col("__first_position") + F.col("__rows__before")
        )
        .drop(_SLICE, _POSITION, "__first_position", "__rows__before")
    )


def part_of(index_col: str = ROW, part_rows: int = PART_ROWS) -> Column:
    return F.expr(f"`{index_col}` div {part_rows}L")


def with_halo(
    df: DataFrame,
    before: int = 0,
    after: int = 0,
    part_rows: int = PART_ROWS,
    index_col: str = ROW,
) -> DataFrame:
    """Copy each row into every part whose frames may touch it.

    A part then holds its own rows, the ``before`` rows ahead of them and the
    ``after`` rows behind them, so frames of that reach are complete for the
    part's own rows.
    """
    if before < 0 or after < 0 or part_rows <= 0:
        raise ValueError("halo lengths must not be negative and parts not empty")
    if before == 0 and after == 0:
        return df.withColumn(PART, part_of(index_col, part_rows))
    first = F.expr(f"greatest(`{index_col}` - {after}L, 0L) div {part_rows}L")
    last = F.expr(f"(`{index_col}` + {before}L) div {part_rows}L")
    return df.withColumn(PART, F.explode(F.sequence(first, last)))


def own_rows(
    df: DataFrame,
    part_rows: int = PART_ROWS,
    index_col: str = ROW,
    keep_part: bool = False,
) -> DataFrame:
    """Drop the halo copies after the frames are computed."""
    own = df.filter(part_of(index_col, part_rows) == F.col(PART))
    return own if keep_part else own.drop(PART)


def part_window(series: Sequence[str], index_col: str = ROW) -> WindowSpec:
    return Window.partitionBy(*series, PART).orderBy(index_col)


def number_in_parts(
    df: DataFrame, series: Sequence[str] = (), index_col: str = ROW
) -> DataFrame:
    """Number the rows inside each part; on a frame still laid out in parts no shuffle."""
    inside = Window.partitionBy(*series, PART).orderBy(index_col)
    return df.withColumn(_LOCAL, F.row_number().over(inside).cast("bigint") - 1)


def number_across_parts(
    df: DataFrame, series: Sequence[str] = (), index_col: str = ROW
) -> DataFrame:
    """Replace the index by the number in the part plus the rows of earlier parts.

    Reads ``df`` twice: stage it first.
    """
    series = list(series)
    per_part = df.groupBy(*series, PART).agg(F.count(F.lit(1)).alias("__rows"))
    per_part = per_part.withColumnRenamed(PART, _SLICE)
    # A bound on the parts that the rows can have, at eight rows to a byte.
    parts = (_plain_bytes(df) or BLOCK_SLICES * PART_ROWS) * 8 // PART_ROWS
    before = _totals_before(per_part, series, ["__rows"], parts, BLOCK_SLICES)
    before = before.withColumnRenamed(_SLICE, PART)
    return (
        attach(df, broadcast_if_small(before), [*series, PART])
        .withColumn(index_col, F.col(_LOCAL) + F.col("__rows__before"))
        .drop(PART, _LOCAL, "__rows__before")
    )


def compact_index(
    df: DataFrame,
    series: Sequence[str] = (),
    index_col: str = ROW,
    bounded: bool = False,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Renumber rows without gaps after some were dropped, keeping their order."""
    series = list(series)
    if bounded and series:
        ordered = Window.partitionBy(*series).orderBy(index_col)
        return df.withColumn(index_col, F.row_number().over(ordered).cast("bigint") - 1)
    parts = df.withColumn(PART, part_of(index_col, part_rows))
    numbered = stage(number_in_parts(parts, series, index_col), "numbered")
    return number_across_parts(numbered, series, index_col)


def series_lengths(
    df: DataFrame, series: Sequence[str] = (), index_col: str = ROW
) -> DataFrame:
    """Rows per series, read off the largest index (partial max, tiny shuffle)."""
    return df.groupBy(*series).agg((F.max(index_col) + 1).alias("num_rows"))


def attach_by_part(
    df: DataFrame,
    per_series: DataFrame,
    series: Sequence[str],
    index_col: str = ROW,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Attach one row per series to all rows of the series.

    The row of a single series becomes literals, a small table is broadcast. A large one is repeated once per part of its
    series (it must carry ``num_rows``) and joined on (series, part), so a long
    series spreads over as many join keys as it has parts.
    """
    series = list(series)
    if not series:
        fields = [f for f in per_series.schema if f.name != "num_rows"]
        row = per_series.first()
        return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in fields})
    small = broadcast_if_small(per_series)
    if small is not per_series:
        return attach(df, small.drop("num_rows"), series)
    last = F.expr(f"greatest(num_rows - 1L, 0L) div {part_rows}L")
    spread = per_series.withColumn(PART, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    keyed = df.withColumn(PART, part_of(index_col, part_rows))
    return attach(keyed, spread.drop("num_rows"), [*series, PART]).drop(PART)
