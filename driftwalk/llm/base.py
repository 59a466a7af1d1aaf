"""Registry and column helpers shared by the operators of this subpackage.

Operators take the names of the columns they read. Helper columns start with
``HELPER``, so that they do not clash with columns of the given table; a result
column takes the place of a given column of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HELPER = "__llm_"

# ASCII white space as the contracts name it, and the letters they lower.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL giving the same rows."""

    def keep(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def column(name: str) -> Column:
    """The column called exactly ``name``, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    return F.coalesce(column(name).cast("string"), F.lit(""))


def sha256(value: Column | str) -> Column:
    """Lowercase hex digest of a string's UTF-8 or of binary."""
    return F.sha2(value, 256)


def slices(batches: Iterator[pa.Array], rows: int = 256) -> Iterator[pa.Array]:
    """The batches in pieces of at most ``rows``, so that a worker holds few results."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)
