"""Sums per task from which losses, fits and metrics follow.

All moments of the variables ``z = (x_1 .. x_d, y)``: the count, the sums, the
sums of products and ``spreads``, the sums of products about the means. Fits use
the spreads, which lose no digits where a variable's level is far above its
spread; they are gathered about the means of each group and merged by the
difference of means, never as differences of raw sums. Rows in which any variable
is null count nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from driftwalk.functions.vectors import as_lists, stacked
from driftwalk.operators.tasks import SPLIT, TASK, TaskShape, assign_tasks

# Inputs are scaled by 100, variances guarded, a smaller
# denominator counts as no correlation.
SCALE = 100.0
VARIANCE_GUARD = 1e-8
SMALLEST_DENOMINATOR = 1e-6

# The array columns of a moment row.
MOMENTS = ("sums", "products", "spreads")

# Variables up to which sums of products are single aggregate columns. Either way
# gives the same moments.
WIDE = 8

# Keys by which the rows of a whole table are merged before they become one.
FAN = 256


def correlation_loss(
    n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column
) -> Column:
    """``1 - cov / sqrt((vx + 1e-8)(vy + 1e-8))`` of values times 100; 0 without rows."""
    size = F.nullif(n, F.lit(0))
    mx, my = SCALE * sx / size, SCALE * sy / size
    square = SCALE * SCALE
    vx = F.greatest(square * sxx / size - mx * mx, F.lit(0.0))
    vy = F.greatest(square * syy / size - my * my, F.lit(0.0))
    below = F.sqrt((vx + VARIANCE_GUARD) * (vy + VARIANCE_GUARD))
    raw = (square * sxy / size - mx * my) / below
    correlation = F.when(below < SMALLEST_DENOMINATOR, F.lit(0.0)).otherwise(
        F.least(F.greatest(raw, F.lit(-1.0)), F.lit(1.0))
    )
    return F.when(n > 0, 1 - correlation).otherwise(F.lit(0.0))


def pair_sums(x: str, y: str) -> dict[str, Column]:
    """The six sums of a pair of columns, skipping rows where one is null."""
    a = F.when(F.col(y).isNotNull(), F.col(x).cast("double"))
    b = F.when(F.col(x).isNotNull(), F.col(y).cast("double"))
    return {
        "n": F.count(a + b),
        "sx": F.sum(a),
        "sy": F.sum(b),
        "sxx": F.sum(a * a),
        "syy": F.sum(b * b),
        "sxy": F.sum(a * b),
    }


def loss_of_sums() -> Column:
    return correlation_loss(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def accumulate_loss(df: DataFrame, pred: str, target: str, by: Sequence[str]) -> DataFrame:
    """Correlation loss of a prediction per group."""
    sums = df.groupBy(*by).agg(*[c.alias(n) for n, c in pair_sums(pred, target).items()])
    return sums.select(*by, "n", loss_of_sums().alias("corr_loss"))


def _sum_columns(variables: Sequence[str]) -> dict[str, Column]:
    """The count, the sums, and per pair i <= j the sum of products about the means."""
    columns = {"n": F.count(F.lit(1))}
    for i, a in enumerate(variables):
        columns[f"s_{i}"] = F.sum(a)
        for j, b in enumerate(variables[i:], i):
            columns[f"s_{i}_{j}"] = F.covar_pop(a, b) * F.count(F.lit(1))
    return columns


def packed(variables: int) -> dict[str, Column]:
    """The sums as arrays: ``sums`` by variable, the others by pair i <= j."""
    pairs = [(i, j) for i in range(variables) for j in range(i, variables)]
    spreads = [F.col(f"s_{i}_{j}") for i, j in pairs]
    raw = [F.col(f"s_{i}_{j}") + F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n") for i, j in pairs]
    return {
        "sums": F.array(*[F.col(f"s_{i}") for i in range(variables)]),
        "products": F.array(*raw),
        "spreads": F.array(*spreads),
    }


def task_moments(
    samples: DataFrame,
    features: Sequence[str],
    target: str,
    shape: TaskShape,
    series: Sequence[str] = (),
    wide: int = WIDE,
) -> DataFrame:
    """Moments of features and target per (series, split, task, part).

    ``samples`` are windows with ``split_row`` (their first row) and
    ``split_rows``. Overlapping tasks share rows; where the task lengths have a
    common divisor, rows are summed once per run of that length and only these
    sums are repeated per task. Up to ``wide`` variables the sums are built-in
    aggregates; beyond, their number grows too large for generated code and
    batches of rows are multiplied as matrices. Columns: n, sums, products, spreads.
    """
    variables = [*features, target]
    keys = [*series, SPLIT]
    inputs = samples.select(
        *keys,
        "split_row",
        "split_rows",
        *[F.col(v).cast("double").alias(f"z_{i}") for i, v in enumerate(variables)],
    )
    names = [f"z_{i}" for i in range(len(variables))]
    inputs = inputs.filter(reduce(and_, [F.col(n).isNotNull() for n in names]))
    by_units = shape.unit >= max(shape.seq_length, 2)
    summing = _summed_as_matrices if len(variables) > wide else _summed_as_columns
    summed = summing(inputs, names, keys, shape, by_units)
    return summed.select(*keys, TASK, "part", "n", *MOMENTS)


def _with_units(inputs: DataFrame, shape: TaskShape) -> DataFrame:
    """The unit of each row, and whether its window runs into the next unit."""
    unit = shape.unit
    return inputs.withColumns(
        {
            "unit": F.expr(f"split_row div {unit}L"),
            "crossing": F.col("split_row") % unit > unit - shape.seq_length,
        }
    )


def _units_in_tasks(by_unit: DataFrame, shape: TaskShape) -> DataFrame:
    """Repeat units per task, leaving out windows that cross the end of a part."""
    unit = shape.unit
    placed = assign_tasks(by_unit.withColumn("split_row", F.col("unit") * unit), shape, unit)
    offset = F.col("split_row") - F.col(TASK) * shape.interval
    last = offset.isin(shape.support - unit, shape.total - unit)
    return placed.filter(~(F.col("crossing") & last))


def _summed_as_columns(
    inputs: DataFrame, names: list[str], keys: list[str], shape: TaskShape, by_units: bool
) -> DataFrame:
    sums = [c.alias(n) for n, c in _sum_columns(names).items()]
    if by_units:
        units = (
            _with_units(inputs, shape)
            .groupBy(*keys, "unit", "crossing")
            .agg(*sums, F.max("split_rows").alias("split_rows"))
            .withColumns(packed(len(names)))
        )
        return merged_moments(_units_in_tasks(units, shape), [*keys, TASK, "part"])
    placed = assign_tasks(inputs, shape)
    return placed.groupBy(*keys, TASK, "part").agg(*sums).withColumns(packed(len(names)))


def _summed_as_matrices(
    inputs: DataFrame, names: list[str], keys: list[str], shape: TaskShape, by_units: bool
) -> DataFrame:
    """Partial sums per batch, then one small row per batch and group is merged."""
    rows = inputs.select(*keys, "split_row", "split_rows", F.array(*names).alias("z"))
    if by_units:
        group = [*keys, "unit", "crossing", "split_rows"]
        placed = _units_in_tasks(_batch_sums(_with_units(rows, shape), group), shape)
    else:
        placed = _batch_sums(assign_tasks(rows, shape), [*keys, TASK, "part"])
    return merged_moments(placed, [*keys, TASK, "part"])


def _moment_schema(df: DataFrame, group: list[str]) -> StructType:
    schema = StructType([df.schema[c] for c in group]).add("n", "long")
    for name in MOMENTS:
        schema.add(name, ArrayType(DoubleType()))
    return schema


def _grouped(batch: pa.RecordBatch, group: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """First keys, order and starts of the groups of a batch."""
    keys = pa.Table.from_batches([batch]).select(group)
    if not group:
        return keys, np.arange(batch.num_rows), np.zeros(1, int)
    ids = keys.to_pandas().groupby(group, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
    return keys.take(pa.array(order[starts])).combine_chunks(), order, starts


def _as_arrays(n: list[int], sums: np.ndarray, spreads: np.ndarray) -> list[pa.Array]:
    """Count, sums, products and spreads of a row per group; products from the rest."""
    upper = np.triu_indices(sums.shape[1])
    products = spreads + sums[:, upper[0]] * sums[:, upper[1]] / np.array(n, float)[:, None]
    return [pa.array(n, pa.int64()), as_lists(sums), as_lists(products), as_lists(spreads)]


def _batch_sums(df: DataFrame, group: list[str]) -> DataFrame:
    """Moments of the vectors ``z`` per group within each Arrow batch."""
    schema = _moment_schema(df, group)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            first, order, starts = _grouped(batch, group)
            parts = np.split(stacked(batch.column("z"))[order], starts[1:])
            upper = np.triu_indices(parts[0].shape[1])
            centred = [p - p.mean(axis=0) for p in parts]
            found = _as_arrays(
                [len(p) for p in parts],
                np.array([p.sum(axis=0) for p in parts]),
                np.array([(p.T @ p)[upper] for p in centred]),
            )
            arrays = [first.column(c).combine_chunks() for c in group] + found
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*group, "z").mapInArrow(sums, schema)


def _merge(n: np.ndarray, sums: np.ndarray, spreads: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of several groups together: spreads grow by how means differ."""
    total = n.sum()
    apart = sums / n[:, None] - sums.sum(axis=0) / total
    upper = np.triu_indices(sums.shape[1])
    between = (apart * n[:, None]).T @ apart
    return int(total), sums.sum(axis=0), spreads.sum(axis=0) + between[upper]


def _merge_groups(n: pa.Array, sums: pa.Array, spreads: pa.Array, order, starts) -> list[pa.Array]:
    columns = (n.to_numpy(zero_copy_only=False).astype(float), stacked(sums), stacked(spreads))
    parts = zip(*(np.split(c[order], starts[1:]) for c in columns))
    counts, found, between = zip(*(_merge(*part) for part in parts))
    return _as_arrays(list(counts), np.array(found), np.array(between))


def with_spreads(moments: DataFrame) -> DataFrame:
    """Moment rows of raw sums alone with ``spreads`` computed from these."""
    if "spreads" in moments.columns:
        return moments

    @F.arrow_udf("array<double>")
    def spreads(n: pa.Array, sums: pa.Array, products: pa.Array) -> pa.Array:
        count, total = n.to_numpy(zero_copy_only=False).astype(float), stacked(sums)
        upper = np.triu_indices(total.shape[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            taken = total[:, upper[0]] * total[:, upper[1]] / count[:, None]
        return as_lists(stacked(products) - taken)

    return moments.withColumn("spreads", spreads(F.col("n").cast("double"), "sums", "products"))


def merged_moments(df: DataFrame, group: list[str]) -> DataFrame:
    """One moment row per group of moment rows.

    Rows are merged within each Arrow batch before they move, so a group of very many
    rows reaches its task as one row per batch. Without a group they are merged in three
    levels: a row per task, a row per ``FAN`` of keys dealt to tasks, and these.
    """
    schema = _moment_schema(df, group)

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, order, starts = _grouped(batch, group)
        found = _merge_groups(
            batch.column("n"), batch.column("sums"), batch.column("spreads"), order, starts
        )
        arrays = [first.column(c).combine_chunks() for c in group] + found
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (merged(b) for b in batches if b.num_rows)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: the last group of a batch may go on in the next."""
        open_group = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if open_group is not None:
                both = pa.Table.from_batches([open_group, batch.cast(open_group.schema)])
                batch = both.combine_chunks().to_batches()[0]
            found = merged(batch)
            yield found.slice(0, found.num_rows - 1)
            open_group = found.slice(found.num_rows - 1)
        if open_group is not None:
            yield open_group

    rows = df.filter("n > 0").select(*group, F.col("n").cast("long").alias("n"), *MOMENTS)
    if not group:
        return _merged_as_tree(rows.mapInArrow(across, schema), schema)
    partial = rows.mapInArrow(within, schema)
    return partial.repartition(*group).sortWithinPartitions(*group).mapInArrow(across, schema)


def _merged_as_tree(rows: DataFrame, schema: StructType) -> DataFrame:
    """One row of moment rows, of which each task has made one: by key, then all keys."""
    dealt = rows.withColumn("__deal", F.spark_partition_id() % FAN)
    few = merged_moments(dealt, ["__deal"]).drop("__deal")
    # As many rows as there are keys at most.
    gathered = few.agg(*(F.collect_list(c).alias(c) for c in ("n", "sums", "spreads")))

    @F.arrow_udf(schema)
    def whole(n: pa.Array, sums: pa.Array, spreads: pa.Array) -> pa.Array:
        columns = (
            n.flatten().to_numpy().astype(float),
            stacked(sums.flatten()),
            stacked(spreads.flatten()),
        )
        total, added, between = _merge(*columns)
        return pa.StructArray.from_arrays(
            _as_arrays([total], added[None], between[None]), names=schema.names
        )

    some = gathered.where(F.size("n") > 0)
    return some.select(whole("n", "sums", "spreads").alias("of")).select("of.*")
