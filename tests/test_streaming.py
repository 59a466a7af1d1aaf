import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwalk.operators import labels, moments, ordering, recurrence
from driftwalk.staging import folders_in, new_path
from driftwalk.streaming.labels import FilteredBatches, LabelledBatches, stream_filter, stream_labels
from driftwalk.streaming.runs import process_available, read_stream, result_table
from driftwalk.streaming.tails import TailStore

SCHEMA = "s string, at int, x double"


@pytest.fixture()
def arrivals(spark):
    """Three files in time order, each unsorted inside."""
    rng = np.random.default_rng(0)
    rows = [(s, i, float(50 + rng.normal())) for s, n in [("a", 700), ("b", 90), ("late", 30)] for i in range(n)]
    rows[20] = ("a", 20, 0.0)
    # Inside a block, at its start and end (blocks have 181 rows), and beside a file's end.
    for at, x in ((4, None), (5, None), (150, math.nan), (361, None), (399, None), (540, None), (543, math.nan)):
        rows[at] = ("a", at, x)
    rows[700 + 30] = ("b", 30, math.nan)
    rows[790] = ("late", 0, None)
    batches = [[], [], []]
    for r in rows:
        cut = {"a": (5, 400), "b": (30, 31), "late": (0, 0)}[r[0]]
        batches[(r[1] >= cut[0]) + (r[1] >= cut[1])].append(r)
    folder = new_path(spark, "arrivals")
    for batch in batches:
        random.Random(1).shuffle(batch)
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    whole = spark.createDataFrame(rows, SCHEMA)
    stream = read_stream(spark, folder, whole.schema, files_per_batch=1)
    return stream, ordering.index_rows(whole, ["at"], ["s"])


def keyed(df, *columns):
    return {(r["s"], r["row_idx"]): tuple(r[c] for c in columns) for r in df.collect()}


def close(got, wanted):
    assert got.keys() == wanted.keys()
    for key, values in wanted.items():
        for a, b in zip(got[key], values):
            assert (a is None) == (b is None), key
            assert a is None or a == pytest.approx(b, abs=1e-9, nan_ok=True), key


def reached(rows, shift):
    """Rows whose row ``shift`` ahead has arrived."""
    last = rows.groupBy("s").agg({"row_idx": "max"}).withColumnRenamed("max(row_idx)", "last")
    return rows.join(last, "s").filter(f"row_idx + {shift} <= last")


def test_blocks_of_the_fixture():
    assert recurrence.HighPass(10).block_rows == 181


def test_filter_equals_batch(arrivals):
    stream, rows = arrivals
    found = result_table(stream_filter(stream, ["s"], ["at"], "x", 10))
    wanted = recurrence.high_pass_filter(rows, "x", 10, ["s"], residual="residual")
    close(keyed(found, "filtered_price", "residual"), keyed(wanted, "filtered_price", "residual"))


@pytest.mark.parametrize("shift", [0, 4])
def test_labels_equal_batch(arrivals, shift):
    stream, rows = arrivals
    found = result_table(stream_labels(stream, ["s"], ["at"], "x", 10, shift))
    wanted = reached(labels.trend_labels(rows, "x", 10, shift, ["s"]), shift)
    wanted = wanted.withColumnRenamed("x", "price")
    names = "price", "future_filtered_price", "l_value"
    close(keyed(found, *names), keyed(wanted, *names))


def test_labelled_batches_equal_batch(spark, arrivals):
    stream, rows = arrivals
    path = new_path(spark, "labelled")
    writer = LabelledBatches(path, ["s"], ["at"], "x", 10, 4, part_rows=64, buckets=2)

    def twice(batch, batch_id):
        """As after a failure: a batch may run again."""
        writer(batch, batch_id)
        writer(batch, batch_id)

    process_available(stream, each_batch=twice)
    found = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/labels")
    wanted = reached(labels.trend_labels(rows, "x", 10, 4, ["s"]), 4)
    assert found.count() == wanted.count()
    close(keyed(found, "l_value"), keyed(wanted, "l_value"))


def test_filtered_batches_equal_batch(spark, arrivals):
    """One series split into parts of 64 rows."""
    stream, rows = arrivals
    path = new_path(spark, "filtered")
    process_available(stream, each_batch=FilteredBatches(path, ["s"], ["at"], "x", 10, part_rows=64))
    found = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/filtered")
    wanted = recurrence.high_pass_filter(rows, "x", 10, ["s"], residual="residual")
    assert found.count() == wanted.count()
    names = "at", "filtered_price", "residual"
    close(keyed(found, *names), keyed(wanted, *names))


def test_batches_replace_only_touched_buckets(spark):
    path = new_path(spark, "tails")
    writer = LabelledBatches(path, ["s"], ["at"], "x", 10, 4, buckets=16)

    def arrive(batch_id, names, start):
        rows = [(s, start + i, 1.0 + i) for s in names for i in range(5)]
        writer(spark.createDataFrame(rows, SCHEMA), batch_id)

    store = TailStore(spark, f"{path}/tail", 16)
    names = [f"s{i}" for i in range(20)]
    arrive(0, names, 0)
    first = store.versions()
    assert len(first) > 4 and all(v == [0] for v in first.values())
    [hit] = store.touched(spark.createDataFrame([("s3",)], "s string"), ["s"])
    for batch_id in range(1, 4):
        arrive(batch_id, ["s3"], 5 * batch_id)
    after = store.versions()
    # The touched bucket has its last two versions, the others the files of the first batch.
    assert after.pop(hit) == [2, 3]
    assert all(v == [0] for v in after.values()) and after.keys() == first.keys() - {hit}
    assert folders_in(spark, f"{path}/tail") == ["0", "2", "3"]
    arrive(4, names, 20)
    tail = store.read(spark.createDataFrame([], "s string, row_idx bigint").schema, first, 5)
    lengths = {r["s"]: r["n"] for r in tail.groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert lengths == {s: 25 if s == "s3" else 10 for s in names}


def test_empty_batches(spark):
    path = new_path(spark, "tails")
    writer = LabelledBatches(path, ["s"], ["at"], "x", 10, 1)
    empty = spark.createDataFrame([], SCHEMA)
    for batch_id, batch in enumerate([empty, spark.createDataFrame([(None, 0, 1.0), (None, 1, 2.0)], SCHEMA), empty]):
        writer(batch, batch_id)
    found = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/labels").collect()
    assert [(r["s"], r["row_idx"]) for r in found] == [(None, 0)]


def test_loss_equals_batch(arrivals):
    stream, rows = arrivals
    found = result_table(moments.accumulate_loss(stream, "x", "at", ["s"]), "complete")
    wanted = moments.accumulate_loss(rows, "x", "at", ["s"])
    a, b = ({r["s"]: r["corr_loss"] for r in d.collect()} for d in (found, wanted))
    assert a == pytest.approx(b)
