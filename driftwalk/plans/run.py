"""A whole run: from a raw table to scored tasks and a record of the run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from driftwalk.operators.metrics import metric_summary
from driftwalk.operators.moments import task_moments
from driftwalk.operators.ordering import series_lengths
from driftwalk.operators.scaling import RobustScaler, SeriesScaler, training_head
from driftwalk.operators.splits import SPLIT, with_splits
from driftwalk.operators.tasks import TaskShape
from driftwalk.operators.windows import window_means
from driftwalk.plans import walkforward
from driftwalk.plans.prepare import prepare_features_and_labels
from driftwalk.sources.chunks import write_chunks
from driftwalk.sources.tables import append_run, write_feature_names
from driftwalk.staging import stage


@dataclass
class Run:
    """What a run leaves: scores per task, the metric per split, and where things are."""

    scores: DataFrame
    summary: DataFrame
    artifacts: dict[str, str]


def walk_forward_run(
    raw: DataFrame,
    order: Sequence[str],
    price: str,
    features: Sequence[str],
    shape: TaskShape,
    path: str,
    series: Sequence[str] = (),
    ratios: tuple[float, float] | None = (0.6, 0.2),
    chunk_rows: int = 0,
    filter_length: float = 30.0,
    shift_length: int = 60,
    online: float | None = None,
    penalty: float = 0.0,
    metric: str = "mse",
    name: str = "walk-forward",
    part_rows: int = 65_536,
) -> Run:
    """Prepare, scale on the training head, chunk, split, fit tasks, score, record.

    Features are scaled robustly by what the first ``ratios[0]`` of each series shows
    (all of it without ``ratios``). Tasks are fitted on their support rows alone, or
    with ``online`` as a pass that keeps that share of what earlier tasks left. The
    scaler, the scaled chunks, the feature list and one row on the run are written
    under ``path``. Series lengths are read once and passed along.
    """
    spark, series = raw.sparkSession, list(series)
    table, chosen, label = prepare_features_and_labels(
        raw,
        order,
        series,
        price,
        features,
        filter_length=filter_length,
        shift_length=shift_length,
        part_rows=part_rows,
    )
    table = stage(table, "prepared")
    lengths = stage(series_lengths(table, series), "lengths")
    head = table
    if ratios is not None:
        head = training_head(table, ratios[0], series=series, lengths=lengths)
    artifacts = {k: f"{path}/{k}" for k in ("scaler", "chunks", "features", "runs")}
    if series:
        scaler = SeriesScaler(series).fit(head, chosen)
        scaler.save(artifacts["scaler"])
    else:
        scaler = RobustScaler().fit(head, chosen)
        scaler.save(spark, artifacts["scaler"])
    scaled = scaler.transform(table)
    write_chunks(scaled, artifacts["chunks"], chunk_rows, series)
    write_feature_names(spark, chosen, artifacts["features"])
    stored = spark.read.parquet(artifacts["chunks"]).select(table.columns)
    placed = with_splits(stored, series, ratios, chunk_rows, lengths=lengths)
    samples = window_means(
        placed,
        chosen,
        label,
        shape.seq_length,
        series=series,
        chunk_rows=chunk_rows,
        keep=[SPLIT, "split_row", "split_rows"],
    )
    moments = stage(task_moments(samples, chosen, label, shape, series), "moments")
    if online is None:
        scores = walkforward.fit_and_score(moments, series, penalty)
    else:
        phases = ["all"] if ratios is None else ["valid", "test"]
        scores = walkforward.online_pass(
            moments, len(chosen) + 1, online, series, phases, penalty
        )
    scores = stage(scores, "scores")
    summary = metric_summary(scores, metric, [SPLIT])
    whole = metric_summary(scores, metric, []).first()["mean"]
    append_run(spark, artifacts["runs"], name, metric, whole, artifacts)
    return Run(scores, summary, artifacts)
