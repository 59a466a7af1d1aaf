"""Arithmetic on batches of vectors inside Arrow functions.

Spark's array functions are interpreted element by element; a batch of vectors
is one matrix here, and a matrix product per batch does the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: smallest product of norms a cosine divides by.
NORM_FLOOR = 1e-8


def stacked(column: pa.Array) -> np.ndarray:
    """A batch of equally long (nested) lists as one array; null rows become NaN.

    Lists of different lengths, also further in, raise an error that names both.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows, valid = len(column), None
    if column.null_count:
        valid = np.asarray(column.is_valid())
        column = column.drop_null()
    shape: list[int] = []
    values = column
    while pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        if values.null_count:
            raise ValueError("a list inside a vector is null")
        lengths = np.asarray(pc.list_value_length(values))
        width = int(lengths[0]) if len(lengths) else 0
        if (lengths != width).any():
            other = lengths[np.argmax(lengths != width)]
            raise ValueError(f"vectors of {width} and of {other} values in one column")
        values = values.flatten()
        shape.append(width)
    dense = values.to_numpy(zero_copy_only=False).astype(np.float64)
    dense = dense.reshape(len(column), *shape)
    if valid is None:
        return dense
    whole = np.full((rows, *shape), np.nan)
    whole[valid] = dense
    return whole


def as_lists(values: np.ndarray, like: pa.Array | None = None) -> pa.Array:
    """The reverse of ``stacked`` for one or two levels of lists; null where ``like`` is."""
    flat: pa.Array = pa.array(np.ascontiguousarray(values).reshape(-1))
    for axis in range(values.ndim - 1, 0, -1):
        width = values.shape[axis]
        count = int(np.prod(values.shape[:axis]))
        flat = pa.ListArray.from_arrays(np.arange(count + 1, dtype=np.int32) * width, flat)
    if like is not None and like.null_count:
        flat = pc.if_else(like.is_valid(), flat, pa.scalar(None, flat.type))
    return flat


def cosines(vectors: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    """Cosine of every vector (last axis) with every prototype."""
    norms = np.linalg.norm(vectors, axis=-1)[..., None] * np.linalg.norm(prototypes, axis=-1)
    return vectors @ prototypes.T / np.maximum(norms, NORM_FLOOR)


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)
