"""The incremental operators, fed from the given files and checked as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    EV_ORDER,
    EV_SERIES,
    FILTER_LENGTH,
    ORACLES,
    SHIFT,
    labelled_sql,
    r6,
    read,
    register,
    sql_r6,
)
from catalog.scaling import COLUMNS, clipped_sql, lineitem, rounded, transformed_sql
from catalog.tasks import loss_sql
from driftwalk.operators import moments
from driftwalk.operators.scaling import RobustScaler
from driftwalk.staging import new_path
from driftwalk.streaming.labels import FilteredBatches, LabelledBatches, stream_filter, stream_labels
from driftwalk.streaming.runs import process_available, read_stream, result_table


def stream_of(spark, folder, table):
    return read_stream(spark, folder, read(spark, folder, table).schema, f"{table}.parquet")


@register("stream_filter", ORACLES["high_pass_filter"])
def filter_stream(spark, folder):
    events = stream_of(spark, folder, "events")
    found = result_table(stream_filter(events, EV_SERIES, EV_ORDER, "value", FILTER_LENGTH))
    return found.select("user_id", "row_idx", r6("filtered_price").alias("filtered_price"))


@register("stream_filter_by_batch", ORACLES["high_pass_filter"])
def filter_stream_by_batch(spark, folder):
    """Micro-batches filtered by the batch operator, with tails kept in buckets."""
    path = new_path(spark, "filtered-batches")
    writer = FilteredBatches(path, EV_SERIES, EV_ORDER, "value", FILTER_LENGTH)
    process_available(stream_of(spark, folder, "events"), each_batch=writer)
    found = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/filtered")
    return found.select("user_id", "row_idx", r6("filtered_price").alias("filtered_price"))


STREAM_LABELS_SQL = f"""WITH RECURSIVE {labelled_sql()}
    SELECT user_id, CAST(row_idx AS BIGINT) AS row_idx, {sql_r6("l_value")} AS l_value
    FROM labelled WHERE future_filtered_price IS NOT NULL"""


@register("stream_labels", STREAM_LABELS_SQL)
def label_stream(spark, folder):
    events = stream_of(spark, folder, "events")
    found = result_table(stream_labels(events, EV_SERIES, EV_ORDER, "value", FILTER_LENGTH, SHIFT))
    return found.select("user_id", "row_idx", r6("l_value").alias("l_value"))


@register("stream_labels_by_batch", STREAM_LABELS_SQL)
def label_stream_by_batch(spark, folder):
    """Micro-batches labelled by the batch operator, with stored tails."""
    path = new_path(spark, "labelled-batches")
    writer = LabelledBatches(path, EV_SERIES, EV_ORDER, "value", FILTER_LENGTH, SHIFT)
    process_available(stream_of(spark, folder, "events"), each_batch=writer)
    found = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/labels")
    return found.select("user_id", "row_idx", r6("l_value").alias("l_value"))


@register(
    "stream_loss",
    f"""WITH e AS (SELECT event_type, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events),
        sums AS (SELECT event_type, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy,
                 sum(x * y) AS sxy FROM e GROUP BY event_type)
        SELECT event_type, CAST(n AS BIGINT) AS n, {sql_r6(loss_sql())} AS corr_loss FROM sums""",
)
def loss_stream(spark, folder):
    """Correlation loss of a value and a property, updated with every batch."""
    events = stream_of(spark, folder, "events").select(
        "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    found = result_table(moments.accumulate_loss(events, "value", "k", ["event_type"]), "complete")
    return found.select("event_type", "n", r6("corr_loss").alias("corr_loss"))


@register("stream_scaling", transformed_sql(clipped_sql))
def scaling_stream(spark, folder):
    """Arriving rows scaled with parameters saved by a batch fit."""
    path = new_path(spark, "scaler")
    rows = lineitem(spark, folder)
    RobustScaler().fit(rows, COLUMNS).save(spark, path)
    arriving = stream_of(spark, folder, "lineitem").select(*rows.columns)
    return rounded(result_table(RobustScaler.load(spark, path).transform(arriving)))
