"""Linear recurrences as running sums.

A recurrence with constant coefficients has a closed form: its value at row t
is a sum over earlier rows weighted by a decaying response. Split at a block
start, the weights factor into a part of t and a part of the earlier row, so
plain running sums give every value. Blocks are long enough for whatever lies
two blocks back to have decayed below double precision; the block just before
is added from its totals. No row loop and no carried state is needed, and long
series run in parallel parts whose halo is one block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from driftwalk.operators.ordering import (
    PART,
    PART_ROWS,
    ROW,
    own_rows,
    part_window,
    with_halo,
)

# exp(-80) is about 2e-35, far below the 1e-16 relative step of a double.
FORGOTTEN = 80.0
BLOCK = "__block"


@dataclass(frozen=True)
class HighPass:
    """Second-order high-pass filter of a given length.

    ``hp_t = c1 (x_t - 2 x_{t-1} + x_{t-2}) + c2 hp_{t-1} + c3 hp_{t-2}``
    from a zero state, with poles ``exp(-w +- iw)``.
    """

    length: float

    # Fixed value: the constant of the filter's angular rate.
    ROOT = 1.414

    def __post_init__(self) -> None:
        if not self.length > 0:
            raise ValueError("filter length must be positive")

    @property
    def rate(self) -> float:
        return self.ROOT * math.pi / self.length

    @property
    def coefficients(self) -> tuple[float, float, float]:
        radius = math.exp(-self.rate)
        c2, c3 = 2 * radius * math.cos(self.rate), -(radius**2)
        return (1 + c2 - c3) / 4, c2, c3

    @property
    def block_rows(self) -> int:
        return math.ceil(FORGOTTEN / self.rate)

    @property
    def warm_up(self) -> int:
        """Rows ahead of a part that its values depend on.

        These are the rest of a block, the block before, and two inputs. Numbers are
        forgotten after one block already; a NaN reaches as far as the sums do.
        """
        return 2 * self.block_rows + 2


def part_rows_for(reach: int, part_rows: int) -> int:
    """Parts at least four times the halo, so copies stay a small share.

    The halo grows with the filter length (18 rows per unit of length), hence so
    do the parts once the length passes some hundreds.
    """
    return max(part_rows, 4 * reach)


def _block_sums(
    frame: DataFrame, series: Sequence[str], index_col: str, names: list[str]
) -> DataFrame:
    """Replace each column by its running sum in the block; add the sum of the block before."""
    inside = (
        Window.partitionBy(*series, PART, BLOCK)
        .orderBy(index_col)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    previous = Window.partitionBy(*series, PART).orderBy(BLOCK).rangeBetween(-1, -1)
    sums = {f"{n}_now": F.sum(n).over(inside) for n in names}
    sums |= {f"{n}_prev": F.coalesce(F.sum(n).over(previous), F.lit(0.0)) for n in names}
    return frame.withColumns(sums)


def block_window(series: Sequence[str], index_col: str) -> WindowSpec:
    """Rows of a part in order, sorted as the block sums need it: one sort for all."""
    return Window.partitionBy(*series, PART).orderBy(BLOCK, index_col)


def add_high_pass(
    frame: DataFrame,
    price: str,
    shape: HighPass,
    series: Sequence[str],
    index_col: str,
    residual: str,
) -> DataFrame:
    """Add the residual to a frame laid out in parts with a warm-up halo.

    The frame stays sorted as ``block_window`` orders it and keeps its block.
    """
    w, rows = shape.rate, shape.block_rows
    c1, _, _ = shape.coefficients
    ordered = block_window(series, index_col)
    frame = frame.withColumn(BLOCK, F.expr(f"`{index_col}` div {rows}L"))
    frame = frame.withColumns(
        {
            "__x1": F.lag(price, 1).over(ordered),
            "__x2": F.lag(price, 2).over(ordered),
            "__step": F.expr(f"CAST(`{index_col}` - {BLOCK} * {rows}L AS DOUBLE)"),
        }
    )
    bend = f"(`{price}` - 2 * coalesce(__x1, 0D) + coalesce(__x2, 0D))"
    frame = frame.withColumns(
        {
            "__even": F.expr(f"exp(__step * {w!r}D) * cos(__step * {w!r}D) * {bend}"),
            "__odd": F.expr(f"exp(__step * {w!r}D) * sin(__step * {w!r}D) * {bend}"),
        }
    )
    frame = _block_sums(frame, series, index_col, ["__even", "__odd"])

    def response(step: str, which: str) -> str:
        turn = f"({step} + 1) * {w!r}D"
        mixed = f"sin({turn}) * __even_{which} - cos({turn}) * __odd_{which}"
        return f"exp(-{step} * {w!r}D) * ({mixed})"

    both = f"{response('__step', 'now')} + {response(f'(__step + {rows})', 'prev')}"
    helpers = ["__x1", "__x2", "__step", "__even", "__odd"]
    helpers += [f"{n}_{s}" for n in ("__even", "__odd") for s in ("now", "prev")]
    value = f"if(`{price}` IS NULL, NULL, ({both}) * {c1 / math.sin(w)!r}D)"
    return frame.withColumn(residual, F.expr(value)).drop(*helpers)


def high_pass_filter(
    df: DataFrame,
    price: str,
    length: float = 10.0,
    series: Sequence[str] = (),
    index_col: str = ROW,
    filtered: str = "filtered_price",
    residual: str | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Price minus its high-pass residual; the residual itself on request.

    A null price has null results, is a zero to the two rows after it and adds nothing
    itself. A NaN price makes the results of its block and of the next one NaN from its row
    on (blocks of 18 rows per unit of length, counted by the index); one in the last two
    rows of a block reaches one block further. Neither depends on the layout in parts.
    """
    shape = HighPass(length)
    part_rows = part_rows_for(shape.warm_up, part_rows)
    frame = with_halo(df, before=shape.warm_up, part_rows=part_rows, index_col=index_col)
    name = residual or "__residual"
    frame = add_high_pass(frame, price, shape, series, index_col, name)
    frame = own_rows(frame, part_rows, index_col).drop(BLOCK)
    frame = frame.withColumn(filtered, F.col(price) - F.col(name))
    return frame if residual else frame.drop(name)


def decayed_sums(
    df: DataFrame,
    columns: Sequence[str],
    keep: float,
    series: Sequence[str] = (),
    index_col: str = ROW,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Replace each column by ``s_t = keep * s_{t-1} + x_t`` along the index."""
    if not 0 < keep < 1:
        raise ValueError("keep must lie between 0 and 1")
    rate = -math.log(keep)
    rows = math.ceil(FORGOTTEN / rate)
    part_rows = part_rows_for(rows, part_rows)
    frame = with_halo(df, before=rows, part_rows=part_rows, index_col=index_col)
    frame = frame.withColumn(BLOCK, F.expr(f"`{index_col}` div {rows}L"))
    step = (F.col(index_col) - F.col(BLOCK) * rows).cast("double")
    frame = frame.withColumns({c: F.col(c) * F.exp(step * rate) for c in columns})
    frame = _block_sums(frame, series, index_col, list(columns))
    merged = {
        c: F.exp(-step * rate) * (F.col(f"{c}_now") + F.exp(F.lit(-rows * rate)) * F.col(f"{c}_prev"))
        for c in columns
    }
    extra = [f"{c}_{s}" for c in columns for s in ("now", "prev")]
    frame = frame.withColumns(merged).drop(BLOCK, *extra)
    return own_rows(frame, part_rows, index_col)


def shift_ahead(
    df: DataFrame,
    value: str,
    rows: int,
    output: str,
    series: Sequence[str] = (),
    index_col: str = ROW,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The value ``rows`` rows ahead, null at the end of the series."""
    part_rows = part_rows_for(rows, part_rows)
    frame = with_halo(df, after=rows, part_rows=part_rows, index_col=index_col)
    frame = frame.withColumn(output, F.lead(value, rows).over(part_window(series, index_col)))
    return own_rows(frame, part_rows, index_col)
