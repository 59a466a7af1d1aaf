"""Exact medians of large columns without sorting them.

A built-in ``median`` keeps all distinct values of a group in one task. Here all values
are counted in buckets, at first by sign and magnitude, 16 buckets to a doubling; then
only those in the bucket that holds the wanted rank, in 65,536 buckets of equal width
between its least and its greatest value, until a bucket holds one value. The first pass
leaves values within a sixteenth of a doubling, and every other one divides this by
65,536, so four passes reach the last bit of a double whatever the number of rows and
however they are spread; two or three are usual. Ties of any size cost nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from driftwalk.functions.columns import known
from driftwalk.operators.joins import attach, broadcast_if_small
from driftwalk.operators.ordering import running_sums
from driftwalk.staging import stage

BUCKETS = 65_536
# Buckets to a doubling in the first pass, and the power below that of any double.
STEPS, LEAST_POWER = 16, 1075
# Values (rows times columns) up to which the built-in median may hold them all.
MEDIAN_CELLS = 1_000_000


@dataclass
class _Bracket:
    """Values of a column from ``low`` to ``high``, and the ranks wanted among them."""

    column: str
    low: float
    high: float
    ranks: list[int] = field(default_factory=list)

    def holds(self) -> Column:
        return F.col(self.column).between(self.low, self.high)

    def cell(self, number: int, buckets: int) -> Column:
        """Its number, the value, and the value's bucket, which grows with the value."""
        v = F.col(self.column)
        # Halves, as the width of a bracket may pass the largest double.
        share = (v / 2 - self.low / 2) / (self.high / 2 - self.low / 2)
        return _cell(number, F.when(self.holds(), v), F.floor(share * (buckets - 1)))


def _cell(number: int, value: Column, bucket: Column) -> Column:
    return F.struct(F.lit(number).alias("id"), value.alias("value"), bucket.alias("bucket"))


def _magnitude(v: Column) -> Column:
    """The first bucket of a value; zero and the infinities have their own."""
    size = F.floor((F.log2(F.abs(v)) + LEAST_POWER) * STEPS) + 1
    largest = F.lit(2 * LEAST_POWER * STEPS).cast("bigint")
    finite = F.when(F.abs(v) == float("inf"), largest).otherwise(size)
    return F.when(v == 0, F.lit(0).cast("bigint")).otherwise(F.signum(v).cast("bigint") * finite)


def _buckets_of_ranks(data: DataFrame, cells: list[Column], ranks: list[list[int]] | None) -> list[Row]:
    """The buckets with the wanted ranks: at most two rows per cell.

    Without ``ranks`` the two ranks in the middle are wanted.
    """
    long = data.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
    counts = long.groupBy("id", "bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    whole = Window.partitionBy("id")
    upto = F.sum("rows").over(whole.orderBy("bucket"))
    placed = counts.withColumns({"upto": upto, "total": F.sum("rows").over(whole)})
    placed = placed.withColumn("before", F.col("upto") - F.col("rows"))
    if ranks is None:
        wanted = [F.expr("(total - 1) div 2"), F.expr("total div 2")]
    else:
        ends = [[r[0] for r in ranks], [r[-1] for r in ranks]]
        wanted = [F.get(F.array(*[F.lit(r).cast("bigint") for r in end]), F.col("id")) for end in ends]
    here = [(F.col("before") <= r) & (F.col("upto") > r) for r in wanted]
    return placed.filter(here[0] | here[1]).collect()


def exact_medians(
    df: DataFrame, values: dict[str, Column], buckets: int = BUCKETS
) -> dict[str, float | None]:
    """Median of each column over all rows, ignoring null and NaN.

    Even counts give the mean of the two middle values; no values give None. All
    columns share each pass.
    """
    if buckets < 2:
        raise ValueError("a pass needs two buckets")
    names = list(values)
    data = df.select(*[known(values[n].cast("double")).alias(f"v{i}") for i, n in enumerate(names)])
    name_of = dict(zip(data.columns, names))
    middle: dict[str, list[float]] = {n: [] for n in names}

    def settle(column: str, row: Row, ranks: list[int]) -> list[_Bracket]:
        """Take the value of a bucket that holds but one; else look into it."""
        inside = [r - row["before"] for r in ranks if 0 <= r - row["before"] < row["rows"]]
        if row["low"] == row["high"]:
            middle[name_of[column]] += [row["low"]] * len(inside)
            return []
        return [_Bracket(column, row["low"], row["high"], inside)]

    cells = [_cell(i, F.col(c), _magnitude(F.col(c))) for i, c in enumerate(data.columns)]
    open_brackets: list[_Bracket] = []
    for row in _buckets_of_ranks(data, cells, None):
        ranks = sorted({(row["total"] - 1) // 2, row["total"] // 2})
        open_brackets += settle(data.columns[row["id"]], row, ranks)
    while open_brackets:
        held = data.filter(reduce(or_, [b.holds() for b in open_brackets]))
        cells = [b.cell(i, buckets) for i, b in enumerate(open_brackets)]
        found = _buckets_of_ranks(held, cells, [b.ranks for b in open_brackets])
        nearer = [settle(open_brackets[r["id"]].column, r, open_brackets[r["id"]].ranks) for r in found]
        open_brackets = [b for group in nearer for b in group]
    return {n: sum(m) / len(m) if m else None for n, m in middle.items()}


def medians(
    df: DataFrame, values: dict[str, Column], rows: int, cell_limit: int = MEDIAN_CELLS
) -> dict[str, float | None]:
    """The built-in median for few rows, the selection above for many."""
    if rows * len(values) > cell_limit:
        return exact_medians(df, values)
    row = df.agg(*[F.median(known(c.cast("double"))).alias(n) for n, c in values.items()]).first()
    return row.asDict()


def series_medians(
    df: DataFrame, values: dict[str, Column], series: Sequence[str], bounded: bool | None = None
) -> DataFrame:
    """Medians per series: the series columns, ``feature``, ``median``.

    Null and NaN do not count; a feature without values has no row. All features are
    counted by distinct value together, and running sums of these counts say which
    values stand in the middle, so a series may hold any share of the rows.
    """
    by = [*series, "feature"]
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), known(v.cast("double")).alias("value"))
            for n, v in values.items()
        ]
    )
    long = df.select(*series, F.inline(cells)).filter(F.col("value").isNotNull())
    counts = long.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("rows"))
    counts = stage(counts, "counts")
    upto = running_sums(counts, by, ["value"], {"upto": F.col("rows")}, bounded)
    totals = counts.groupBy(*by).agg(F.sum("rows").alias("total"))
    placed = attach(upto, broadcast_if_small(totals), by)

    def at(rank: Column) -> Column:
        here = (F.col("upto") > rank) & (F.col("upto") - F.col("rows") <= rank)
        return F.max(F.when(here, F.col("value")))

    middle = (at(F.expr("(total - 1) div 2")) + at(F.expr("total div 2"))) / 2
    return placed.groupBy(*by).agg(middle.alias("median"))
