"""Chunked tables on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwalk.operators.ordering import ROW
from driftwalk.operators.splits import CHUNK, CHUNK_ROWS, with_chunks


def write_chunks(
    df: DataFrame,
    path: str,
    chunk_rows: int = CHUNK_ROWS,
    series: Sequence[str] = (),
    index_col: str = ROW,
    mode: str = "errorifexists",
) -> None:
    """Write chunks of exactly ``chunk_rows`` rows, sorted inside, in one pass.

    Files are grouped into folders by ``bucket`` (1,000 chunks each), since a
    folder per chunk would swamp the file listing; inside a file rows are
    sorted, so a filter on ``chunk_id`` or the index skips row groups.
    """
    keys = [*series, CHUNK]
    # Range partitioning keeps neighbouring chunks together; a chunk has one
    # range key and never spans two files. Without chunks ranges are cut by row, so
    # that a long series is no single task's.
    ranged = keys if chunk_rows else [*keys, index_col]
    (
        with_chunks(df, chunk_rows, index_col)
        .withColumn("bucket", F.expr(f"{CHUNK} div 1000L"))
        .repartitionByRange("bucket", *ranged)
        .sortWithinPartitions("bucket", *keys, index_col)
        .write.mode(mode)
        .partitionBy("bucket")
        .parquet(path)
    )


def read_chunks(
    spark: SparkSession,
    path: str,
    first: int | None = None,
    last: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Chunks ``first`` to ``last``; the bucket filter prunes whole folders."""
    table = spark.read.parquet(path)
    if first is not None:
        table = table.filter((F.col(CHUNK) >= first) & (F.col("bucket") >= first // 1000))
    if last is not None:
        table = table.filter((F.col(CHUNK) <= last) & (F.col("bucket") <= last // 1000))
    return table.select(*columns) if columns else table.drop("bucket")
