"""Walk-forward adaptation of a linear forecaster on task moments.

Per task: adapt on the support rows, forecast the query rows, score. Everything
after ``task_moments`` works on one small row per task part; fits, losses and
errors all follow from the sums, so the samples are read once. What is carried
from task to task is a decayed sum of moments, which parallelises along the
series like the filter does.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftwalk.functions import linear
from driftwalk.functions.vectors import as_lists, stacked
from driftwalk.operators.joins import attach, broadcast_if_small
from driftwalk.operators.moments import (
    SCALE,
    SMALLEST_DENOMINATOR,
    VARIANCE_GUARD,
    merged_moments,
    with_spreads,
)
from driftwalk.operators.ordering import index_rows
from driftwalk.operators.splits import SPLIT
from driftwalk.operators.tasks import QUERY, SUPPORT, TASK
from driftwalk.staging import stage

SCORES = ("corr_loss", "mse", "concordance", "pearson")


def _unpacked(n: pa.Array, sums: pa.Array, spreads: pa.Array):
    counts = n.to_numpy(zero_copy_only=False).astype(np.float64)
    return linear.centred(np.nan_to_num(counts), stacked(sums), stacked(spreads))


def _moment_columns(moments: Column) -> list[Column]:
    return [moments["n"].cast("double"), moments["sums"], moments["spreads"]]


def fitted(moments: Column, penalty: float = 0.0) -> Column:
    """Coefficients of the best linear forecast of the target."""

    @F.arrow_udf("array<double>")
    def fit(n: pa.Array, sums: pa.Array, spreads: pa.Array) -> pa.Array:
        return as_lists(linear.ridge(*_unpacked(n, sums, spreads), penalty))

    return fit(*_moment_columns(moments))


def stepped(base: Column, moments: Column, rate: float, level: bool = True) -> Column:
    """Base coefficients after one gradient step on the support loss.

    The loss ignores the level of a forecast, so the intercept is set to match
    the support means; with ``level=False`` the base intercept stays.
    """

    @F.arrow_udf("array<double>")
    def step(b: pa.Array, n: pa.Array, sums: pa.Array, spreads: pa.Array) -> pa.Array:
        start = stacked(b)
        means, cov = _unpacked(n, sums, spreads)
        known = np.isfinite(cov).all(axis=(1, 2))
        moved = start.copy()
        gradient = linear.correlation_gradient(start[known, :-1], cov[known])
        moved[known, :-1] -= rate * gradient
        if level:
            moved[known] = linear.with_intercept(moved[known, :-1], means[known])
        return as_lists(moved)

    return step(base, *_moment_columns(moments))


def scored(coefficients: Column, moments: Column) -> Column:
    """``SCORES`` of a linear forecast on rows known by their moments."""

    @F.arrow_udf("array<double>")
    def score(c: pa.Array, n: pa.Array, sums: pa.Array, spreads: pa.Array) -> pa.Array:
        means, cov = _unpacked(n, sums, spreads)
        size = n.to_numpy(zero_copy_only=False).astype(np.float64)
        mean, variance, shared = linear.prediction_moments(stacked(c), means, cov)
        target, spread = means[:, -1], np.maximum(cov[:, -1, -1], 0.0)
        square = SCALE * SCALE
        with np.errstate(divide="ignore", invalid="ignore"):
            below = np.sqrt((square * variance + VARIANCE_GUARD) * (square * spread + VARIANCE_GUARD))
            corr = np.where(below < SMALLEST_DENOMINATOR, 0.0, square * shared / below)
            loss = np.where(size > 0, 1 - np.clip(corr, -1, 1), 0.0)
            apart = mean - target
            mse = variance + spread - 2 * shared + apart * apart
            sample = size / (size - 1)
            ccc = 2 * shared * sample / ((variance + spread) * sample + apart * apart)
            pearson = shared / np.sqrt(variance * spread)
        return as_lists(np.column_stack([loss, -mse, ccc, pearson]))

    return score(coefficients, *_moment_columns(moments))


def _null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def score_columns(scores: Column, suffix: str = "") -> list[Column]:
    return [_null_if_nan(scores[i]).alias(f"{n}{suffix}") for i, n in enumerate(SCORES)]


def merge_moments(moments: DataFrame, variables: int, by: Sequence[str] = ()) -> DataFrame:
    """Add moment rows up per group (``variables`` counts the target)."""
    return merged_moments(with_spreads(moments), list(by))


def base_coefficients(
    moments: DataFrame,
    variables: int,
    penalty: float = 0.0,
    split: str | None = "train",
    part: str = QUERY,
    by: Sequence[str] = (),
) -> DataFrame:
    """Coefficients shared by tasks, fitted to all query rows of a split."""
    rows = moments.filter(F.col("part") == part)
    if split is not None:
        rows = rows.filter(F.col(SPLIT) == split)
    merged = merge_moments(rows, variables, by)
    return merged.select(*by, fitted(F.struct("n", "sums", "spreads"), penalty).alias("base"))


def by_task(moments: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Support and query moments of a task side by side."""
    content = F.struct("n", "sums", "products", "spreads")
    return with_spreads(moments).groupBy(*series, SPLIT, TASK).agg(
        *[
            F.any_value(F.when(F.col("part") == part, content), ignoreNulls=True).alias(part)
            for part in (SUPPORT, QUERY)
        ]
    )


def fit_and_score(
    moments: DataFrame, series: Sequence[str] = (), penalty: float = 0.0
) -> DataFrame:
    """Fit each task on its support rows and score it on its query rows."""
    tasks = by_task(moments, series).withColumn("coefficients", fitted(F.col(SUPPORT), penalty))
    tasks = tasks.withColumn("scores", scored(F.col("coefficients"), F.col(QUERY)))
    return tasks.select(
        *series, SPLIT, TASK, "coefficients", *score_columns(F.col("scores"))
    )


def _with_base(tasks: DataFrame, base: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return tasks.withColumn("base", base.select("base").scalar())
    return attach(tasks, broadcast_if_small(base), list(by))


def adapt_and_score(
    moments: DataFrame,
    base: DataFrame,
    rate: float,
    series: Sequence[str] = (),
    by: Sequence[str] = (),
    level: bool = True,
) -> DataFrame:
    """One step from the base per task; losses before and after on the query rows."""
    tasks = _with_base(by_task(moments, series), base, by)
    tasks = tasks.withColumn(
        "coefficients", stepped(F.col("base"), F.col(SUPPORT), rate, level)
    )
    tasks = tasks.withColumns(
        {
            "before": scored(F.col("base"), F.col(QUERY)),
            "after": scored(F.col("coefficients"), F.col(QUERY)),
        }
    )
    return tasks.select(
        *series,
        SPLIT,
        TASK,
        "coefficients",
        *score_columns(F.col("before"), "_before"),
        *score_columns(F.col("after")),
    )


def predict_queries(
    samples: DataFrame, features: Sequence[str], coefficients: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Forecast of each query sample by the coefficients of its task.

    A task holds a bounded number of samples, so the join has no hot key.
    """
    rows = samples.filter(F.col("part") == QUERY)
    known = coefficients.select(*keys, "coefficients")
    joined = attach(rows, known, list(keys))
    value = F.col("coefficients")[len(features)]
    for i, feature in enumerate(features):
        value = value + F.col("coefficients")[i] * F.col(feature)
    return joined.withColumn("prediction", value).drop("coefficients")


State = tuple[float, np.ndarray, np.ndarray]


def _together(a: State, b: State) -> State:
    """Moments of both: spreads grow by how the means differ."""
    if a[0] <= 0 or b[0] <= 0:
        return a if b[0] <= 0 else b
    total = a[0] + b[0]
    apart = b[1] / b[0] - a[1] / a[0]
    upper = np.triu_indices(len(apart))
    between = apart[upper[0]] * apart[upper[1]] * (a[0] * b[0] / total)
    return total, a[1] + b[1], a[2] + b[2] + between


def _faded(state: State, share: float) -> State:
    return state[0] * share, state[1] * share, state[2] * share


def _read_states(batch: pa.RecordBatch, side: str) -> list[State]:
    counts = batch.column(f"{side}_n").to_numpy(zero_copy_only=False)
    return list(zip(counts, stacked(batch.column(f"{side}_sums")), stacked(batch.column(f"{side}_spreads"))))


def _state_arrays(states: Sequence[State]) -> list[pa.Array]:
    counts, sums, spreads = zip(*states)
    return [pa.array(counts, pa.float64()), as_lists(np.array(sums)), as_lists(np.array(spreads))]


def _flat(moments: str, side: str, variables: int) -> list[Column]:
    """A moment struct as three columns, zeros where it is missing."""
    pairs = variables * (variables + 1) // 2
    n = F.coalesce(F.col(moments)["n"].cast("double"), F.lit(0.0))
    arrays = (
        F.coalesce(F.col(moments)[c], F.array_repeat(F.lit(0.0), size)).alias(f"{side}_{c}")
        for c, size in (("sums", variables), ("spreads", pairs))
    )
    return [n.alias(f"{side}_n"), *arrays]


# Tasks of a series that are folded one after the other.
PART_TASKS = 1024
_KEPT = "kept_n double, kept_sums array<double>, kept_spreads array<double>"


def _folds(
    rows: DataFrame, keys: Sequence[str], start: State, keep: float, every: bool
) -> DataFrame:
    """Fold ``own`` moments per (keys, part) in order of ``step``.

    The state after a row is ``keep`` times the state before it plus the row's own
    moments. With ``every`` each row gets the state before it, else each part the one
    after its last row. Parts begin with ``start``, or with the own moments of a row of
    step -1, which is no row of the result. Rows stream through sorted, so that a task
    holds one state and one batch however long a part is.
    """
    group = [*keys, "part"]
    given = [c for c in rows.columns if not c.startswith("own_")] if every else group
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in given)
    names = [*given, "kept_n", "kept_sums", "kept_spreads"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, kinds = None, start, []
        ended: list[tuple[tuple, State]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(c).type for c in group]
            columns = [batch.column(c).to_pylist() for c in (*group, "step")]
            shown, states = [], []
            for i, ((*key, step), own) in enumerate(zip(zip(*columns), _read_states(batch, "own"))):
                if key != current:
                    if current is not None:
                        ended.append((current, state))
                    current, state = key, start
                if step < 0:
                    state = own
                    continue
                shown.append(i)
                states.append(state)
                state = _together(_faded(state, keep), own)
            if every and shown:
                kept = batch.select(given).take(pa.array(shown))
                yield pa.RecordBatch.from_arrays([*kept.columns, *_state_arrays(states)], names)
            elif not every:
                yield from parts(ended, kinds)
            ended.clear()
        if not every and current is not None:
            yield from parts([(current, state)], kinds)

    def parts(ended: list[tuple[tuple, State]], kinds: list) -> Iterator[pa.RecordBatch]:
        if ended:
            found, states = zip(*ended)
            arrays = [pa.array(c, kind) for c, kind in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays([*arrays, *_state_arrays(states)], names)

    dealt = rows.repartition(*group).sortWithinPartitions(*group, "step")
    return dealt.mapInArrow(fold, f"{schema}, {_KEPT}")


def online_pass(
    moments: DataFrame,
    variables: int,
    keep: float = 0.9,
    series: Sequence[str] = (),
    phases: Sequence[str] = ("valid", "test"),
    penalty: float = 0.0,
    prior: DataFrame | None = None,
    bounded: bool | None = None,
    part_tasks: int = PART_TASKS,
) -> DataFrame:
    """Tasks in time order, each fitted with what earlier tasks left behind.

    The state after a task is ``keep`` times the state before plus the task's
    query moments; a task is fitted to the state before it plus its support
    moments. ``prior`` (one moment row, such as the mean train task) is the
    state at the start.

    States are whole moment rows, merged about their means. A series is folded in parts
    of ``part_tasks`` tasks side by side: first the sum of every part, then what is
    carried into each part (a fold over the sums), then the tasks from there. Where no
    series has more than one part, that is one pass.
    """
    series = list(series)
    phase = F.array_position(F.array(*[F.lit(p) for p in phases]), F.col(SPLIT))
    tasks = by_task(moments.filter(phase > 0), series).withColumn("phase", phase)
    tasks = index_rows(tasks, ["phase", TASK], series, "step", bounded=bounded)
    tasks = tasks.withColumn("part", F.expr(f"step div {part_tasks}L"))
    tasks = tasks.select(
        *series, "part", "step", SPLIT, TASK, *_flat(QUERY, "own", variables), SUPPORT, QUERY
    )
    tasks = stage(tasks, "tasks")
    pairs = variables * (variables + 1) // 2
    nothing = start = (0.0, np.zeros(variables), np.zeros(pairs))
    row = None if prior is None else with_spreads(prior).first()
    if row is not None and row["n"]:
        start = float(row["n"]), np.array(row["sums"]), np.array(row["spreads"])
    last = tasks.agg(F.max("part")).first()[0]
    if last:
        own = ["own_n", "own_sums", "own_spreads"]
        sums = _folds(tasks.select(*series, "part", "step", *own), series, nothing, keep, every=False)
        sums = sums.withColumnsRenamed({f"kept_{c}": f"own_{c}" for c in ("n", "sums", "spreads")})
        whole = F.lit(0).cast("long").alias("part")
        ahead = sums.select(*series, whole, F.col("part").alias("step"), *own)
        carried = _folds(ahead, series, start, keep**part_tasks, every=True)
        carried = carried.select(
            *series,
            F.col("step").alias("part"),
            F.lit(-1).cast("long").alias("step"),
            *(F.col(f"kept_{c}").alias(f"own_{c}") for c in ("n", "sums", "spreads")),
        )
        tasks = tasks.unionByName(carried, allowMissingColumns=True)
    fits = _folds(tasks, series, start, keep, every=True)
    fits = fits.withColumn("state", _added(*(f"kept_{c}" for c in ("n", "sums", "spreads")), variables))
    fits = fits.withColumn("coefficients", fitted(F.col("state"), penalty))
    fits = fits.withColumn("scores", scored(F.col("coefficients"), F.col(QUERY)))
    return fits.select(*series, SPLIT, TASK, "coefficients", *score_columns(F.col("scores")))


def _added(n: str, sums: str, spreads: str, variables: int) -> Column:
    """The state with a task's support moments."""

    @F.arrow_udf("n double, sums array<double>, spreads array<double>")
    def add(
        n: pa.Array, sums: pa.Array, spreads: pa.Array, m: pa.Array, more: pa.Array, wider: pa.Array
    ) -> pa.Array:
        first, second = (
            zip(c.to_numpy(zero_copy_only=False), stacked(a), stacked(b))
            for c, a, b in ((n, sums, spreads), (m, more, wider))
        )
        arrays = _state_arrays([_together(a, b) for a, b in zip(first, second)])
        return pa.StructArray.from_arrays(arrays, ["n", "sums", "spreads"])

    return add(n, sums, spreads, *_flat(SUPPORT, "support", variables))
