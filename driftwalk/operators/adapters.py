"""Gated adapters of features and labels as column functions.

An adapter is a small set of heads. A vector's gate is the softmax of its
cosines with the heads' prototypes; labels and features are the gate-weighted
mix of what each head makes of them. Parameters are fixed in size by the number
of heads and the width of a vector, and travel with the function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from driftwalk.functions.columns import col_of, decay_weights
from driftwalk.functions.vectors import as_lists, cosines, softmax, stacked

# Fixed value: keeps the scale of a head away from zero.
SCALE_GUARD = 1e-9
MAX_HEADS = 4096


@dataclass(frozen=True)
class Gate:
    """Prototypes, softmax temperature and an optional projection before the cosine."""

    prototypes: np.ndarray
    temperature: float = 4.0
    projection: np.ndarray | None = None
    decay_rate: float = 0.5

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        if self.projection is not None:
            vectors = vectors @ self.projection.T
        if vectors.shape[-1] != self.prototypes.shape[-1]:
            raise ValueError("vector and prototype width differ")
        return cosines(vectors, self.prototypes)

    def per_vector(self, vectors: np.ndarray) -> np.ndarray:
        """Gates of vectors, or of each step of windows."""
        return softmax(self.scores(vectors) / self.temperature)

    def per_sample(self, vectors: np.ndarray) -> np.ndarray:
        """One gate per sample; steps of a window are mixed by geometric decay."""
        scores = self.scores(vectors)
        if scores.ndim == 3:
            weights = np.array(decay_weights(scores.shape[1], self.decay_rate))
            scores = np.einsum("nth,t->nh", scores, weights)
        return softmax(scores / self.temperature)


@dataclass(frozen=True)
class LabelAdapter:
    gate: Gate
    gamma: np.ndarray
    beta: np.ndarray

    def apply(self, vectors: np.ndarray, labels: np.ndarray, inverse: bool) -> np.ndarray:
        y = labels[:, None]
        if inverse:
            heads = (y - self.beta) / (self.gamma + SCALE_GUARD)
        else:
            heads = (self.gamma + SCALE_GUARD) * y + self.beta
        return (self.gate.per_sample(vectors) * heads).sum(axis=-1)


@dataclass(frozen=True)
class FeatureAdapter:
    gate: Gate
    weights: np.ndarray
    biases: np.ndarray

    def apply(self, vectors: np.ndarray) -> np.ndarray:
        moved = np.einsum("hij,...j->...hi", self.weights, vectors) + self.biases
        return vectors + (self.gate.per_vector(vectors)[..., None] * moved).sum(axis=-2)


def centroids(
    df: DataFrame, vector: str, label: str, width: int, max_heads: int = MAX_HEADS
) -> np.ndarray:
    """Mean vector per label, by label: prototypes of as many heads.

    One partial aggregate with a column per position; the result is as small as
    the adapter, which is checked: more than ``max_heads`` labels are an error.
    """
    means = [F.avg(F.col(vector)[i].cast("double")) for i in range(width)]
    rows = df.groupBy(label).agg(F.array(*means).alias("mean")).limit(max_heads + 1).collect()
    if len(rows) > max_heads:
        raise ValueError(f"more than {max_heads} labels cannot be heads of one adapter")
    return np.array([r["mean"] for r in sorted(rows, key=lambda r: r[label])])


def _lists(levels: int) -> pa.DataType:
    kind = pa.float64()
    for _ in range(levels):
        kind = pa.list_(kind)
    return kind


def _of_batch(x: pa.Array, kind: pa.DataType, compute: Callable[[np.ndarray], pa.Array]) -> pa.Array:
    """``compute`` of a batch's vectors; a batch of nulls alone has no width and stays null."""
    return pa.nulls(len(x), kind) if len(x) == x.null_count else compute(stacked(x))


def gate_column(vector: str | Column, gate: Gate, steps: bool = False) -> Column:
    """Gate weights by head; with ``steps`` a list per step of a window. Null stays null."""
    shape = "array<array<double>>" if steps else "array<double>"

    apply, kind = gate.per_vector if steps else gate.per_sample, _lists(1 + steps)

    @F.arrow_udf(shape)
    def gates(x: pa.Array) -> pa.Array:
        return _of_batch(x, kind, lambda vectors: as_lists(apply(vectors), like=x))

    return gates(col_of(vector))


def adapt_label(
    vector: str | Column, label: str | Column, adapter: LabelAdapter, inverse: bool = False
) -> Column:
    """Adapted label; ``inverse`` mixes the heads' inverses instead.

    The mix of inverses is not the inverse of the mix: a round trip returns the
    label only where one head has all the weight.
    """

    @F.arrow_udf("double")
    def adapted(x: pa.Array, y: pa.Array) -> pa.Array:
        labels = y.to_numpy(zero_copy_only=False).astype(np.float64)

        def compute(vectors: np.ndarray) -> pa.Array:
            return pa.array(adapter.apply(vectors, labels, inverse), from_pandas=True)

        return _of_batch(x, pa.float64(), compute)

    return adapted(col_of(vector), col_of(label).cast("double"))


def adapt_features(df: DataFrame, vector: str, adapter: FeatureAdapter, output: str) -> DataFrame:
    """Add the adapted vector, or window of vectors."""
    kind = df.schema[vector].dataType
    nested = isinstance(kind, ArrayType) and isinstance(kind.elementType, ArrayType)
    out = _lists(1 + nested)

    @F.arrow_udf("array<array<double>>" if nested else "array<double>")
    def adapted(x: pa.Array) -> pa.Array:
        return _of_batch(x, out, lambda vectors: as_lists(adapter.apply(vectors), like=x))

    return df.withColumn(output, adapted(F.col(vector)))


def adapted_forecast(
    df: DataFrame,
    vector: str,
    label: str,
    predict: Callable[[Column], Column],
    features: FeatureAdapter | None = None,
    labels: LabelAdapter | None = None,
) -> DataFrame:
    """Forecast with feature and label adaptation, each of which may be off.

    Adds ``adapted_label`` (what the forecaster is fitted to) and
    ``prediction`` (back on the scale of the label). The label's gate always
    sees the raw vector.
    """
    shown = vector
    if features is not None:
        df, shown = adapt_features(df, vector, features, "adapted_vector"), "adapted_vector"
    df = df.withColumn("prediction", predict(F.col(shown)))
    if labels is None:
        return df.withColumn("adapted_label", F.col(label).cast("double"))
    return df.withColumn("adapted_label", adapt_label(vector, label, labels)).withColumn(
        "prediction", adapt_label(vector, "prediction", labels, inverse=True)
    )


def label_shift(df: DataFrame, adapted: str, label: str, by: Sequence[str]) -> DataFrame:
    """Mean squared change that adaptation makes to the labels of a group."""
    change = F.col(adapted) - F.col(label)
    return df.groupBy(*by).agg(F.avg(change * change).alias("label_shift"))


def task_objective(
    query_loss: Column,
    old_loss: Column,
    shift: Column,
    reg: float = 0.5,
    sigma: float = 1.0,
    first_order: bool = True,
    adapt_y: bool = True,
) -> Column:
    """Query loss plus the weighted label shift of the task.

    In first-order mode the shift also weighs the change of the loss against
    the forecast before adaptation.
    """
    if not adapt_y:
        return query_loss
    weight = F.lit(reg)
    if first_order:
        weight = weight + (query_loss - old_loss) / F.lit(sigma)
    return query_loss + shift * weight
