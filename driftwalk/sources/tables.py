"""Loading and saving tables, feature lists and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from driftwalk.sources.files import checked_columns

RUNS_SCHEMA = "run string, finished timestamp, metric string, value double, artifacts map<string,string>"


def load_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None
) -> DataFrame:
    """Read ``.csv`` (with header) or ``.parquet`` by the path's ending.

    Give a schema for CSV when it is known; inferring one reads the file twice.
    """
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
        return reader.csv(path)
    if path.endswith(".parquet"):
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    raise ValueError(f"unsupported file format: {path}")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def read_files(
    spark: SparkSession,
    paths: Sequence[str],
    label: str,
    features: Sequence[str] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Several Parquet files as one table of keys, features and label.

    Every file's columns are checked by a job that reads footers only. Without a
    feature list all columns of the first file but label and keys are features.
    """
    if not paths:
        raise ValueError("no files given")
    if features is not None and label in features:
        raise ValueError(f"label column {label!r} must not be a feature")
    features = checked_columns(spark, paths, features, [*keys, label])
    wanted = [*keys, *features, label]
    return spark.read.parquet(*paths).select(*wanted)


def concatenate(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of several tables matched by column name."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table)
    return first


def clean_feature_name(line: Column) -> Column:
    """A name without surrounding blanks, quotes and commas."""
    return F.regexp_replace(F.trim(line), r"^[\s'\",]+|[\s'\",]+$", "")


def read_feature_names(spark: SparkSession, path: str, price: str) -> list[str]:
    """Feature names, one per line, in file order and without the price column.

    The list is as long as the table is wide, so it comes to the driver.
    """
    lines = spark.read.text(path, wholetext=False).coalesce(1)
    names = (
        lines.filter(F.trim("value") != "")
        .select(clean_feature_name(F.col("value")).alias("name"))
        .filter(F.col("name") != price)
    )
    return [row["name"] for row in names.collect()]


def write_feature_names(spark: SparkSession, names: Sequence[str], path: str) -> None:
    rows = [(name,) for name in names]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


def append_run(
    spark: SparkSession,
    path: str,
    run: str,
    metric: str,
    value: float | None,
    artifacts: dict[str, str],
) -> None:
    """Append one row on a finished run to the table of runs."""
    row = spark.createDataFrame(
        [(run, metric, value, artifacts)],
        "run string, metric string, value double, artifacts map<string,string>",
    ).withColumn("finished", F.current_timestamp())
    row.select("run", "finished", "metric", "value", "artifacts").write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS_SCHEMA).parquet(path)
