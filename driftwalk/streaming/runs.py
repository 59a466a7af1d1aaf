"""Starting streams on whatever has arrived, and their results as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from driftwalk.staging import new_path


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    pattern: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream of the Parquet files in a folder, oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def process_available(
    stream: DataFrame,
    output_mode: str = "append",
    each_batch: Callable[[DataFrame, int], None] | None = None,
    checkpoint: str | None = None,
    path: str | None = None,
) -> str:
    """Process all input that has arrived, then stop; returns the result's path.

    Appended rows go to a Parquet table. Other modes replace the table with
    each batch, as their batches hold the whole result.
    """
    spark = stream.sparkSession
    path = path or new_path(spark, "stream")
    writer = stream.writeStream.outputMode(output_mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", checkpoint or new_path(spark, "progress"))
    if each_batch is not None:
        writer = writer.foreachBatch(each_batch)
    elif output_mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:

        def replace(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(path)

        writer = writer.foreachBatch(replace)
    writer.start().awaitTermination()
    return path


def result_table(stream: DataFrame, output_mode: str = "append") -> DataFrame:
    """All available input processed into a table."""
    path = process_available(stream, output_mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
