"""Offline training of the shared forecaster over epochs of shuffled tasks.

Every epoch deals the train tasks out in a new hashed order, cut into blocks of
``block_tasks`` neighbours. Within a block tasks follow each other: the weights adapt to
a task's support rows by one step, and the loss of the adapted weights on its query rows
moves the weights that the next task starts from. Blocks start from the epoch's weights,
run side by side and are averaged by their numbers of tasks; a block that holds all
tasks is the plain sequence. Blocks follow from the order alone, so results do not
depend on how rows are partitioned.

After each epoch the tasks of the validation split are adapted and scored. Training ends
when the score has not improved for ``patience`` epochs; the best epoch's weights are
what is kept. An epoch's state is a row on storage, from which a broken run goes on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwalk.functions import linear
from driftwalk.functions.vectors import stacked
from driftwalk.operators.joins import attach
from driftwalk.operators.metrics import early_stop, metric_summary
from driftwalk.operators.moments import SCALE, SMALLEST_DENOMINATOR, VARIANCE_GUARD, with_spreads
from driftwalk.operators.splits import SPLIT, shuffled_order
from driftwalk.operators.tasks import QUERY, SUPPORT, TASK
from driftwalk.plans.walkforward import adapt_and_score
from driftwalk.staging import new_path, stage

# Scores of which larger is better.
IMPROVING = ("mse", "concordance", "pearson")
STATE = "epoch int, train_loss double, valid_value double, weights array<double>"
MOVED = "block long, tasks long, loss double, weights array<double>"


@dataclass
class Training:
    """What training leaves: the best weights as a ``base`` row, and a row per epoch."""

    base: DataFrame
    history: DataFrame
    best_epoch: int | None
    stop_epoch: int | None


def _losses(weights: np.ndarray, cov: np.ndarray) -> float:
    """Correlation loss of weights on rows known by their covariances."""
    _, variance, shared = linear.prediction_moments(
        np.append(weights, 0.0)[None], np.zeros((1, len(weights) + 1)), cov[None]
    )
    square = SCALE * SCALE
    spread = max(float(cov[-1, -1]), 0.0)
    below = np.sqrt((square * variance[0] + VARIANCE_GUARD) * (square * spread + VARIANCE_GUARD))
    corr = 0.0 if below < SMALLEST_DENOMINATOR else square * shared[0] / below
    return 1.0 - float(np.clip(corr, -1, 1))


def block_moves(
    tasks: DataFrame, weights: Sequence[float], inner_rate: float, outer_rate: float
) -> DataFrame:
    """(block, tasks, loss, weights): every block's tasks taken in order of ``position``.

    ``tasks`` holds a row per task with ``block``, ``position`` and the count, sums and
    spreads of its support and query rows. Tasks without either move nothing and do not
    count. ``loss`` sums the losses after adapting, before the weights move.
    """
    start = np.asarray(weights, dtype=float)

    def moves(block: pa.Table) -> pa.Table:
        block = block.sort_by("position").combine_chunks()
        parts = [
            linear.centred(
                block[f"{part}_n"].to_numpy().astype(float),
                stacked(block[f"{part}_sums"].combine_chunks()),
                stacked(block[f"{part}_spreads"].combine_chunks()),
            )[1]
            for part in (SUPPORT, QUERY)
        ]
        moved, loss = start.copy(), 0.0
        for support, query in zip(*parts):
            adapted = moved - inner_rate * linear.correlation_gradient(moved[None], support[None])[0]
            loss += _losses(adapted, query)
            moved = moved - outer_rate * linear.correlation_gradient(adapted[None], query[None])[0]
        first = block["block"][0].as_py()
        row = {"block": [first], "tasks": [block.num_rows], "loss": [loss], "weights": [moved.tolist()]}
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        return pa.table([pa.array(v, k) for v, k in zip(row.values(), kinds)], list(row))

    return tasks.groupBy("block").applyInArrow(moves, MOVED)


def _averaged(moves: DataFrame) -> tuple[float, list[float]]:
    """Mean loss per task, and the mean weights; as many rows as there are weights."""
    entries = moves.select("tasks", "loss", F.posexplode("weights").alias("entry", "weight"))
    rows = (
        entries.groupBy("entry")
        .agg(
            (F.sum("loss") / F.sum("tasks")).alias("loss"),
            (F.sum(F.col("weight") * F.col("tasks")) / F.sum("tasks")).alias("weight"),
        )
        .orderBy("entry")
        .collect()
    )
    return rows[0]["loss"], [r["weight"] for r in rows]


def _sides(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row per task that has support and query rows, with both moments as columns."""
    parts = []
    for part in (SUPPORT, QUERY):
        found = with_spreads(moments).where((F.col("part") == part) & (F.col("n") > 0))
        columns = (F.col(c).alias(f"{part}_{c}") for c in ("n", "sums", "spreads"))
        parts.append(found.select(*keys, *columns))
    return attach(parts[0], parts[1], list(keys))


def _base_row(spark: SparkSession, weights: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([([*map(float, weights), 0.0],)], "base array<double>")


def offline_training(
    moments: DataFrame,
    start: Sequence[float],
    epochs: int,
    inner_rate: float,
    outer_rate: float,
    patience: int = 5,
    metric: str = "pearson",
    series: Sequence[str] = (),
    train: str = "train",
    valid: str = "valid",
    block_tasks: int = 1024,
    seed: int = 0,
    path: str | None = None,
    resume: bool = False,
) -> Training:
    """Train weights shared by all tasks, as the module says.

    ``moments`` are ``task_moments``; ``start`` holds a weight per feature. ``metric`` is
    the mean validation score that has to grow. The intercept of a forecast follows from
    support means, so it is 0 in the result. A missing score (no validation task, or one
    that is undefined) never improves. Without train tasks weights stay as they are.

    The state after each epoch is written under ``path``; with ``resume`` the epochs
    found there are taken as done, and training goes on where it broke off.
    """
    if metric not in IMPROVING:
        raise ValueError(f"metric must be one of {IMPROVING}")
    if epochs <= 0 or patience <= 0 or block_tasks <= 0:
        raise ValueError("epochs, patience and block_tasks must be positive")
    spark, keys = moments.sparkSession, [*series, SPLIT, TASK]
    path = path or new_path(spark, "training")
    tasks = stage(_sides(moments.where(F.col(SPLIT) == train), keys), "tasks")
    judged = stage(moments.where(F.col(SPLIT) == valid), "judged")
    any_task = not tasks.isEmpty()
    done = spark.read.schema(STATE).parquet(path).orderBy("epoch").collect() if resume else []
    states = [tuple(row) for row in done]
    weights = list(map(float, states[-1][3] if states else start))
    best, best_epoch, waited, stop_epoch = None, None, 0, None

    def judge(epoch: int, value: float | None) -> None:
        nonlocal best, best_epoch, waited, stop_epoch
        if value is not None and (best is None or value > best):
            best, best_epoch, waited = value, epoch, 0
        else:
            waited += 1
            if waited >= patience:
                stop_epoch = epoch

    for state in states:
        judge(state[0], state[2])
    for epoch in range(len(states) + 1, epochs + 1):
        if stop_epoch is not None:
            break
        loss = None
        if any_task:
            order = shuffled_order(tasks.select(*keys), keys, epoch, seed)
            block = F.expr(f"position div {block_tasks}L")
            dealt = attach(tasks, order.withColumn("block", block), keys)
            loss, weights = _averaged(block_moves(dealt, weights, inner_rate, outer_rate))
        scores = adapt_and_score(judged, _base_row(spark, weights), inner_rate, series)
        value = metric_summary(scores, metric, []).first()
        states.append((epoch, loss, value["mean"] if value else None, weights))
        spark.createDataFrame(states[-1:], STATE).write.mode("append").parquet(path)
        judge(*states[-1][::2])
    kept = next((s[3] for s in states if s[0] == best_epoch), weights)
    # As many rows as there were epochs.
    history = spark.createDataFrame(states, STATE)
    return Training(_base_row(spark, kept), history, best_epoch, stop_epoch)


def stopped(training: Training, patience: int) -> DataFrame:
    """Best and last epoch of the history, as ``early_stop`` sees them."""
    return early_stop(training.history, "epoch", "valid_value", patience)
