"""Joins that keep null keys and check sizes before broadcasting."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
# Rows whose size is not known from their type are fetched in smaller numbers.
NESTED_ROWS = 1_000


def broadcast_if_small(df: DataFrame, row_limit: int = BROADCAST_ROWS) -> DataFrame:
    """A table of few rows and bytes marked for broadcast; a larger one as it is.

    At most ``row_limit + 1`` rows are fetched to find out. A small table is
    then known by its rows, so what it was computed from is not run again.
    """
    nested = any(isinstance(f.dataType, (ArrayType, MapType, StructType)) for f in df.schema)
    row_limit = min(row_limit, NESTED_ROWS) if nested else row_limit
    rows = df.limit(row_limit + 1).toArrow()
    if rows.num_rows > row_limit or rows.nbytes > BROADCAST_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "inner",
) -> DataFrame:
    """Join ``table`` (unique by ``keys``) to ``rows``; null keys match each other."""
    renamed = table.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(and_, [rows[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return rows.join(renamed, same, how).drop(*[f"__{k}" for k in keys])
