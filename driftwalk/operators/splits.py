"""Fixed-row chunks and their split into train, valid and test.

Chunks are a function of the row index, so chunk bounds, the chunk of a row and
the split of a chunk are arithmetic on the index and the series length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from driftwalk.operators.joins import attach
from driftwalk.operators.ordering import (
    PART_ROWS,
    ROW,
    attach_by_part,
    index_rows,
    series_lengths,
)

CHUNK = "chunk_id"
SPLIT = "split"
CHUNK_ROWS = 14_400


def check_ratios(train_ratio: float, valid_ratio: float) -> None:
    if not 0 < train_ratio < 1 or not 0 < valid_ratio < 1 or train_ratio + valid_ratio > 1:
        raise ValueError("ratios must lie in (0, 1) and sum to at most 1")


def chunk_of(chunk_rows: int, index_col: str = ROW) -> Column:
    """The chunk holding a row; one chunk per series when chunking is off (0)."""
    if chunk_rows < 0:
        raise ValueError("chunk size must not be negative")
    if chunk_rows == 0:
        return F.lit(0).cast("bigint")
    return F.expr(f"`{index_col}` div {chunk_rows}L")


def with_chunks(df: DataFrame, chunk_rows: int = CHUNK_ROWS, index_col: str = ROW) -> DataFrame:
    return df.withColumn(CHUNK, chunk_of(chunk_rows, index_col))


def chunk_infos(
    df: DataFrame,
    chunk_rows: int = CHUNK_ROWS,
    series: Sequence[str] = (),
    index_col: str = ROW,
) -> DataFrame:
    """Rows and index bounds of every chunk."""
    return (
        with_chunks(df, chunk_rows, index_col)
        .groupBy(*series, CHUNK)
        .agg(
            F.count(F.lit(1)).alias("num_rows"),
            F.min(index_col).alias("row_start"),
            F.max(index_col).alias("row_end"),
        )
    )


def _split_of(rank: Column, chunks: Column, train_ratio: float, valid_ratio: float) -> Column:
    train = F.floor(chunks * F.lit(train_ratio))
    valid = F.floor(chunks * F.lit(valid_ratio))
    return (
        F.when(rank < train, "train").when(rank < train + valid, "valid").otherwise("test")
    )


def _mixed(keys: Sequence[str], *numbers: int) -> Column:
    """A digest of keys and numbers joined by bars, which any engine can compute."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], *map(F.lit, map(str, numbers))))


def split_chunks(
    chunks: DataFrame,
    train_ratio: float = 0.6,
    valid_ratio: float = 0.2,
    series: Sequence[str] = (),
    seed: int | None = None,
) -> DataFrame:
    """Give every chunk of ``chunk_infos`` its split.

    The first ``int(n * train)`` chunks train, the next ``int(n * valid)``
    validate, the rest test; with a seed the chunks are first put in a hashed
    order, the same on every run and partitioning.
    """
    check_ratios(train_ratio, valid_ratio)
    series = list(series)
    counts = chunks.groupBy(*series).agg((F.max(CHUNK) + 1).alias("__chunks"))
    counts = counts.withColumn("num_rows", F.col("__chunks"))
    rank = CHUNK
    if seed is not None:
        mixed = chunks.withColumn("__mixed", _mixed([*series, CHUNK], seed))
        chunks = index_rows(mixed, ["__mixed", CHUNK], series, "__rank").drop("__mixed")
        rank = "__rank"
    split = _split_of(F.col(rank), F.col("__chunks"), train_ratio, valid_ratio)
    known = attach_by_part(chunks, counts, series, index_col=CHUNK)
    return known.withColumn(SPLIT, split).drop("__chunks", "__rank")


def _cuts(
    df: DataFrame,
    series: Sequence[str],
    ratios: tuple[float, float] | None,
    chunk_rows: int,
    index_col: str,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """Rows of each series and the first rows of its valid and test splits."""
    if lengths is None:
        lengths = series_lengths(df, series, index_col)
    if ratios is None:
        return lengths
    check_ratios(*ratios)
    size = max(chunk_rows, 1)
    chunks = F.expr(f"(num_rows + {size - 1}L) div {size}L")
    first = (F.floor(chunks * F.lit(ratios[0])) * size).cast("bigint")
    second = first + (F.floor(chunks * F.lit(ratios[1])) * size).cast("bigint")
    return lengths.select(
        *series, "num_rows", first.alias("__valid_start"), second.alias("__test_start")
    )


def split_bounds(
    df: DataFrame,
    series: Sequence[str] = (),
    ratios: tuple[float, float] | None = None,
    chunk_rows: int = 0,
    index_col: str = ROW,
) -> DataFrame:
    """First row and row count of every split of every series.

    Splits follow whole chunks (single rows when chunking is off); without
    ratios the series is one split named ``all``.
    """
    cuts = _cuts(df, series, ratios, chunk_rows, index_col)
    zero, end = F.lit(0).cast("bigint"), F.col("num_rows")
    if ratios is None:
        edges = [("all", zero, end)]
    else:
        first, second = F.col("__valid_start"), F.col("__test_start")
        edges = [("train", zero, first), ("valid", first, second), ("test", second, end)]
    named = [
        F.struct(F.lit(n).alias(SPLIT), a.alias("split_start"), (b - a).alias("split_rows"))
        for n, a, b in edges
    ]
    return cuts.select(*series, F.inline(F.array(*named)))


def with_splits(
    df: DataFrame,
    series: Sequence[str] = (),
    ratios: tuple[float, float] | None = None,
    chunk_rows: int = 0,
    index_col: str = ROW,
    part_rows: int = PART_ROWS,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """Add split, row number inside the split and rows of the split to each row.

    Needs only the length of each series, not the chunk table; ``lengths`` are its
    ``series_lengths`` where they are known already.
    """
    cuts = _cuts(df, series, ratios, chunk_rows, index_col, lengths)
    cuts = cuts.withColumn("__rows", F.col("num_rows"))
    rows = attach_by_part(df, cuts, series, index_col, part_rows)
    i, end = F.col(index_col), F.col("__rows")
    if ratios is None:
        return rows.withColumns(
            {SPLIT: F.lit("all"), "split_row": i, "split_rows": end}
        ).drop("__rows")
    first, second = F.col("__valid_start"), F.col("__test_start")

    def by_split(train, valid, test) -> Column:
        return F.when(i < first, train).when(i < second, valid).otherwise(test)

    return rows.withColumns(
        {
            SPLIT: by_split("train", "valid", "test"),
            "split_row": by_split(i, i - first, i - second),
            "split_rows": by_split(first, second - first, end - second),
        }
    ).drop("__rows", "__valid_start", "__test_start")


def locate_rows(
    rows: DataFrame,
    chunks: DataFrame,
    chunk_rows: int,
    series: Sequence[str] = (),
    index_col: str = ROW,
) -> DataFrame:
    """Chunk and offset in it of each row index.

    Chunks are uniform, so the range lookup is an equi-join on the chunk that
    division gives; rows beyond the table find none.
    """
    keyed = with_chunks(rows, chunk_rows, index_col)
    found = attach(keyed, chunks.select(*series, CHUNK, "row_start", "row_end"), [*series, CHUNK])
    inside = F.col(index_col).between(F.col("row_start"), F.col("row_end"))
    return found.filter(inside).select(
        *rows.columns, CHUNK, (F.col(index_col) - F.col("row_start")).alias("offset")
    )


def shuffled_order(items: DataFrame, keys: Sequence[str], epoch: int, seed: int) -> DataFrame:
    """Items in a hashed order that changes with the epoch: adds ``position``."""
    mixed = items.withColumn("__mixed", _mixed(keys, epoch, seed))
    return index_rows(mixed, ["__mixed", *keys], [], "position").drop("__mixed")
