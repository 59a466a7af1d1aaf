import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwalk.operators import moments, splits, tasks
from driftwalk.operators.tasks import TaskShape


def walked(n, shape):
    """Task starts found by stepping along the series."""
    out, at = [], 0
    while at + shape.total + shape.seq_length - 1 < n - 1:
        out.append(at)
        at += shape.interval
    return out


SHAPES = [TaskShape(s, q, i, l) for s, q, i, l in [(20, 10, 10, 5), (7, 3, 2, 1), (4, 4, 15, 3), (6, 5, 4, 9)]]
LENGTHS = {"a": 0, "b": 1, "c": 17, "d": 36, "e": 37, "f": 120}


@pytest.mark.parametrize("shape", SHAPES)
def test_rolling_tasks(table, shape):
    df = table([(s, i) for s, n in LENGTHS.items() for i in range(n)], "s string, row_idx bigint")
    found = tasks.rolling_tasks(splits.split_bounds(df, ["s"]), shape, ["s"]).collect()
    got = {(r["s"], r["task_id"]): r for r in found}
    wanted = {(s, k): at for s, n in LENGTHS.items() for k, at in enumerate(walked(n, shape))}
    assert got.keys() == wanted.keys()
    for key, at in wanted.items():
        r = got[key]
        bounds = (r["support_start"], r["support_end"], r["query_start"], r["query_end"])
        assert bounds == (at, at + shape.support - 1, at + shape.support, at + shape.total - 1)


@pytest.mark.parametrize("shape,length", itertools.product(SHAPES, [1, 4]))
def test_assignment_equals_scan(table, shape, length):
    df = table([(s, i) for s, n in LENGTHS.items() for i in range(n)], "s string, row_idx bigint")
    rows = splits.with_splits(df, ["s"])
    found = {
        (r["s"], r["row_idx"], r["task_id"], r["part"])
        for r in tasks.assign_tasks(rows, shape, length).collect()
    }
    wanted = set()
    for s, n in LENGTHS.items():
        for (k, at), r in itertools.product(enumerate(walked(n, shape)), range(n)):
            for part, lo, hi in [
                ("support", at, at + shape.support - 1),
                ("query", at + shape.support, at + shape.total - 1),
            ]:
                if lo <= r and r + length - 1 <= hi:
                    wanted.add((s, r, k, part))
    assert found == wanted


def test_many_tasks_fan_out(spark):
    bounds = spark.sql("SELECT 'all' AS split, 5L AS split_start, 20000L AS split_rows")
    found = tasks.rolling_tasks(bounds, TaskShape(2, 1, 1, 1))
    assert found.count() == len(walked(20000, TaskShape(2, 1, 1, 1)))
    assert found.select("task_id").distinct().count() == found.count()
    assert found.agg(F.min("support_start"), F.max("task_id")).first() == (5, found.count() - 1)


def test_required_tasks(spark):
    make = lambda *names: spark.createDataFrame([(n,) for n in names], "split string")
    with pytest.raises(ValueError):
        tasks.require_tasks(make("train", "test"))
    with pytest.warns(UserWarning):
        tasks.require_tasks(make("train", "valid"))
    for bad in [(0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 0, 1), (1, 1, 1, 0)]:
        with pytest.raises(ValueError):
            TaskShape(*bad)


def test_task_chunks(spark):
    row = spark.sql("SELECT 95L AS support_start, 214L AS support_end, 215L AS query_start, 299L AS query_end")
    found = tasks.task_chunks(row, 100).first()
    assert found["support_chunks"] == [0, 1, 2] and found["query_chunks"] == [2]
    assert (found["support_start_offset"], found["query_end_offset"]) == (95, 99)


@pytest.mark.parametrize("wide", [16, 0])
@pytest.mark.parametrize(
    "shape", [TaskShape(20, 10, 10, 5), TaskShape(20, 10, 5, 5), TaskShape(7, 3, 2, 2), TaskShape(6, 5, 4, 2)]
)
def test_task_moments_equal_direct_sums(table, shape, wide):
    rng = np.random.default_rng(0)
    data = [(s, i, *map(float, rng.normal(size=3))) for s, n in LENGTHS.items() for i in range(n)]
    df = table(data, "s string, row_idx bigint, a double, b double, y double")
    rows = splits.with_splits(df, ["s"])
    last = F.col("split_rows") - shape.seq_length
    rows = rows.filter(F.col("split_row") <= last)
    found = moments.task_moments(rows, ["a", "b"], "y", shape, ["s"], wide).collect()
    values = {(s, i): np.array(v) for s, i, *v in data}
    wanted = {}
    for s, n in LENGTHS.items():
        for k, at in enumerate(walked(n, shape)):
            for part, lo, size in [("support", at, shape.support), ("query", at + shape.support, shape.query)]:
                z = np.array([values[(s, r)] for r in range(lo, lo + size - shape.seq_length + 1)])
                if len(z):
                    wanted[(s, k, part)] = z
    assert {(r["s"], r["task_id"], r["part"]) for r in found} == set(wanted)
    for r in found:
        z = wanted[(r["s"], r["task_id"], r["part"])]
        assert r["n"] == len(z)
        np.testing.assert_allclose(r["sums"], z.sum(0), atol=1e-9)
        np.testing.assert_allclose(r["products"], (z.T @ z)[np.triu_indices(3)], atol=1e-9)


def test_loss_edges(table):
    df = table(
        [("up", 1.0, 2.0), ("up", 2.0, 4.0), ("flat", 1.0, 3.0), ("flat", 5.0, 3.0), ("none", 1.0, None)],
        "g string, p double, t double",
    )
    found = {r["g"]: r["corr_loss"] for r in moments.accumulate_loss(df, "p", "t", ["g"]).collect()}
    assert found["up"] == pytest.approx(0, abs=1e-9)
    assert found["flat"] == pytest.approx(1)
    assert found["none"] == 0.0
