"""Two-way normalisation of windows and summaries of weight matrices."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from driftwalk.functions.columns import total
from driftwalk.operators.ordering import PART_ROWS, ROW
from driftwalk.operators.windows import _frames

# A smaller spread counts as one; smallest blend weight.
SPREAD_FLOOR = 1e-4
WEIGHT_FLOOR = 0.01


@dataclass(frozen=True)
class TwoWay:
    """Blend weights and the affine parameters per step and per feature."""

    step_weight: float = 0.5
    feature_weight: float = 0.5
    step_scale: Sequence[float] | None = None
    step_bias: Sequence[float] | None = None
    feature_scale: Sequence[float] | None = None
    feature_bias: Sequence[float] | None = None


def _guarded(spread: Column) -> Column:
    return F.when(spread < SPREAD_FLOOR, F.lit(1.0)).otherwise(spread)


def two_way_normalize(
    df: DataFrame,
    features: Sequence[str],
    length: int,
    series: Sequence[str] = (),
    params: TwoWay = TwoWay(),
    stride: int = 1,
    chunk_rows: int = 0,
    index_col: str = ROW,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Windows normalised over time and over features, blended.

    Over features a step needs only its own row; over time the mean and spread
    are frames ahead of the window's first row. Both guard a vanishing spread.
    """
    size = len(features)
    if size < 2 or length < 2:
        raise ValueError("normalisation needs two features and two steps at least")
    values = [F.col(f).cast("double") for f in features]
    mean = total(values) / size
    spread = F.sqrt(total([(v - mean) * (v - mean) for v in values]) / (size - 1))
    across = F.array(*[(v - mean) / _guarded(spread) for v in values])
    rows = df.withColumns({"__values": F.array(*values), "__across": across})

    def ahead(window):
        frame = window.rowsBetween(0, length - 1)
        return {
            "__steps": F.collect_list(F.struct("__values", "__across")).over(frame),
            "__means": F.array(*[F.avg(f).over(frame) for f in features]),
            "__spreads": F.array(*[_guarded(F.stddev_samp(f).over(frame)) for f in features]),
        }

    y1 = max(params.step_weight, WEIGHT_FLOOR)
    y2 = max(params.feature_weight, WEIGHT_FLOOR)
    literal = lambda given, n, default: F.array(
        *[F.lit(float(v)) for v in (given if given is not None else [default] * n)]
    )
    l1, b1 = literal(params.step_scale, length, 1.0), literal(params.step_bias, length, 0.0)
    l2, b2 = literal(params.feature_scale, size, 1.0), literal(params.feature_bias, size, 0.0)

    def blended(step: Column, t: Column) -> Column:
        def at(f: int) -> Column:
            over_time = (step["__values"][f] - F.col("__means")[f]) / F.col("__spreads")[f]
            first = l1[t] * step["__across"][f] + b1[t]
            return y1 * first + y2 * (l2[f] * over_time + b2[f])

        return F.array(*[at(f) for f in range(size)])

    columns = {"normalized": F.transform("__steps", blended)}
    return _frames(
        rows, columns, length, stride, series, chunk_rows, index_col, part_rows, (), ahead
    )


def attention_distance(weights: DataFrame, head: Sequence[str]) -> DataFrame:
    """Mean over positions of the weight times the distance it reaches.

    ``weights`` has rows (head, query, key, weight) of square matrices.
    """
    reach = F.abs("weight") * F.abs(F.col("query") - F.col("key"))
    positions = F.max("key") + 1
    return weights.groupBy(*head).agg((F.sum(reach) / positions).alias("mean_distance"))


def attention_peaks(weights: DataFrame, head: Sequence[str]) -> DataFrame:
    """Largest weight of each query and the first key that has it."""
    # Order by weight, then by the smaller key.
    best = F.max(F.struct(F.col("weight"), (-F.col("key")).alias("back")))
    peaks = weights.groupBy(*head, "query").agg(best.alias("best"))
    return peaks.select(
        *head, "query", F.col("best.weight").alias("max_weight"), (-F.col("best.back")).alias("max_key")
    )
