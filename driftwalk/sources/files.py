"""Parquet files as they lie on storage: their footers, and their order as row order.

Files are listed by Spark, and footers are read by a job over the list, a few kilobytes
per file, never by the driver one after the other.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftwalk.operators.joins import broadcast_if_small
from driftwalk.operators.ordering import ROW, running_sums
from driftwalk.staging import stage

FOOTERS = "filename string, length long, row_groups int, columns array<string>, problem string"
# Files whose names are given in a warning, and footers read by a task.
NAMED, FILES_PER_TASK = 10, 200


def _location(path: str) -> tuple[fs.FileSystem, str]:
    """Storage and path of a file as Spark names it (``file:/a`` has one slash)."""
    scheme, found, rest = path.partition(":")
    if not found or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if found else path).lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))


def footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A row per Parquet file under ``paths``: ``FOOTERS``, with what made it unreadable.

    Paths are files or folders, which are searched to the bottom; names that Spark
    passes over (``_`` or ``.`` first) stay out. A path that is not there is an error.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(list(paths))
        .select("path")
    )
    tasks = max(1, -(-listed.count() // FILES_PER_TASK))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    storage, place = _location(path)
                    with storage.open_input_file(place) as file:
                        metadata = pq.read_metadata(file)
                    names = metadata.schema.to_arrow_schema().names
                    rows.append((path, metadata.num_rows, metadata.num_row_groups, names, None))
                except (OSError, pa.ArrowException) as error:
                    rows.append((path, None, None, None, str(error)[:200]))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, [f.split(" ")[0] for f in FOOTERS.split(", ")])

    found = listed.repartition(tasks, "path").mapInArrow(read, FOOTERS)
    return stage(found, "footers")


def file_infos(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """filename, length, row_groups of every readable file, in order of names.

    Files that cannot be read are left out with a warning.
    """
    if not paths:
        return spark.createDataFrame([], "filename string, length long, row_groups int")
    found = footers(spark, paths)
    broken = found.where(F.col("problem").isNotNull())
    named = [r["filename"] for r in broken.orderBy("filename").limit(NAMED).collect()]
    if named:
        warnings.warn(f"{broken.count()} unreadable files are left out, such as {named}", stacklevel=2)
    readable = found.where(F.col("problem").isNull())
    return readable.select("filename", "length", "row_groups").orderBy("filename")


def checked_columns(
    spark: SparkSession, paths: Sequence[str], wanted: Sequence[str] | None, known: Sequence[str]
) -> list[str]:
    """``wanted``, or all columns of the first file but ``known``, after checking all files.

    Every file has to be readable and to hold the wanted and the known columns.
    """
    found = footers(spark, paths)
    if broken := found.where(F.col("problem").isNotNull()).orderBy("filename").first():
        raise ValueError(f"cannot read {broken['filename']}: {broken['problem']}")
    if wanted is None:
        first = found.orderBy("filename").first()
        if first is None:
            raise ValueError("no files found")
        wanted = [c for c in first["columns"] if c not in known]
    missing = F.array_except(F.array(*map(F.lit, [*known, *wanted])), "columns")
    lacking = found.select("filename", missing.alias("missing")).where(F.size("missing") > 0)
    if short := lacking.orderBy("filename").first():
        raise ValueError(f"columns {short['missing']} not found in {short['filename']}")
    return list(wanted)


def _decoded(path: Column) -> Column:
    """A path as it is listed, from the URI that a scan tells."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def index_by_files(
    spark: SparkSession, paths: Sequence[str], index_col: str = ROW, columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows of files with their index in the order of file names, then of rows inside.

    The rows are not sorted or shuffled: a file's first index is the number of rows in
    the files before it, which footers tell, and a scan knows each row's place in its
    file. Files that cannot be read are left out with a warning. A column called
    ``index_col`` gives way.
    """
    infos = stage(file_infos(spark, paths).drop("row_groups"), "infos")
    before = running_sums(infos, [], ["filename"], {"__upto": F.col("length")})
    starts = before.select("filename", (F.col("__upto") - F.col("length")).alias("__start"))
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    rows = reader.option("ignoreCorruptFiles", True).parquet(*paths)
    chosen = [c for c in (columns or rows.columns) if c != index_col]
    rows = rows.select(
        *chosen,
        _decoded(F.col("_metadata.file_path")).alias("__file"),
        F.col("_metadata.row_index").alias("__row"),
    )
    # A file holds a bounded share of the rows; few files are broadcast.
    found = rows.join(broadcast_if_small(starts), F.col("__file") == F.col("filename"))
    return found.select(*chosen, (F.col("__start") + F.col("__row")).alias(index_col))
