import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwalk.operators import recurrence
from driftwalk.streaming.labels import FilterState, advance


def looped(prices, length):
    w = 1.414 * math.pi / length
    c2, c3 = 2 * math.exp(-w) * math.cos(w), -math.exp(-2 * w)
    c1 = (1 + c2 - c3) / 4
    x1 = x2 = h1 = h2 = 0.0
    out = []
    for x in prices:
        h = c1 * (x - 2 * x1 + x2) + c2 * h1 + c3 * h2
        x1, x2, h1, h2 = x, x1, h, h1
        out.append(h)
    return np.array(out)


def walk(n, seed=0):
    return 100 + np.cumsum(np.random.default_rng(seed).normal(size=n))


@pytest.mark.parametrize("length", [3, 10, 30])
@pytest.mark.parametrize("part_rows", [1, 4096])
def test_filter_equals_loop(table, length, part_rows):
    series = {"a": walk(3000), "b": walk(17, 1), "c": walk(1, 2)}
    rows = [(s, i, float(x)) for s, xs in series.items() for i, x in enumerate(xs)]
    df = table(rows, "s string, row_idx bigint, x double")
    found = recurrence.high_pass_filter(
        df, "x", length, ["s"], residual="hp", part_rows=part_rows
    ).toPandas()
    for s, xs in series.items():
        one = found[found.s == s].sort_values("row_idx")
        hp = looped(xs, length)
        np.testing.assert_allclose(one.hp, hp, atol=1e-10)
        np.testing.assert_allclose(one.filtered_price, xs - hp, atol=1e-10)


def test_long_filter_length(table):
    xs = walk(4000, 3)
    df = table([(i, float(x)) for i, x in enumerate(xs)], "row_idx bigint, x double")
    found = recurrence.high_pass_filter(df, "x", 500.0, residual="hp").toPandas().sort_values("row_idx")
    np.testing.assert_allclose(found.hp, looped(xs, 500.0), atol=1e-8)


def test_filter_length_must_be_positive():
    with pytest.raises(ValueError):
        recurrence.HighPass(0)


def test_batch_advance_equals_loop():
    xs, shape = walk(1000, 4), recurrence.HighPass(10)
    state, out = FilterState(), []
    for start, stop in [(0, 1), (1, 2), (2, 5), (5, 700), (700, 1000)]:
        part, state = advance(shape, xs[start:stop], state)
        out.append(part)
    np.testing.assert_allclose(np.concatenate(out), looped(xs, 10), atol=1e-10)


@pytest.mark.parametrize("at", [100, 180, 181, 400])
def test_nan_and_null_whatever_the_parts(table, at):
    """A NaN ends with the block after its own (two after, when its bends reach over)."""
    xs = [float(x) for x in walk(1200, 7)]
    xs[at], xs[700], xs[701] = math.nan, None, None
    df = table(list(enumerate(xs)), "row_idx bigint, x double")
    rows = recurrence.HighPass(10).block_rows
    last = ((at + 2) // rows + 2) * rows
    for part_rows in (1, 4096):
        found = recurrence.high_pass_filter(df, "x", 10, residual="hp", part_rows=part_rows)
        hp = {r["row_idx"]: r["hp"] for r in found.collect()}
        assert [i for i in hp if hp[i] is None] in ([700, 701], [701, 700])
        assert {i for i in hp if hp[i] is not None and math.isnan(hp[i])} == set(range(at, last)) - {700, 701}
    part, state = advance(recurrence.HighPass(10), np.array([math.nan if x is None else x for x in xs]),
                          FilterState(), np.array([x is None for x in xs]))
    np.testing.assert_allclose([part[i] for i in range(1200) if xs[i] is not None],
                               [hp[i] for i in range(1200) if xs[i] is not None], atol=1e-9)


@pytest.mark.parametrize("keep", [0.3, 0.9])
def test_decayed_sums(table, keep):
    xs = np.random.default_rng(5).normal(size=2500)
    df = table([(i, float(x)) for i, x in enumerate(xs)], "row_idx bigint, x double")
    found = recurrence.decayed_sums(df, ["x"], keep, part_rows=1).toPandas().sort_values("row_idx")
    state, wanted = 0.0, []
    for x in xs:
        state = keep * state + x
        wanted.append(state)
    np.testing.assert_allclose(found.x, wanted, atol=1e-10)
    with pytest.raises(ValueError):
        recurrence.decayed_sums(df, ["x"], 1.0)


def test_shift_ahead_over_parts(table):
    df = table([(i, i * 10) for i in range(500)], "row_idx bigint, x int")
    found = recurrence.shift_ahead(df, "x", 7, "ahead", part_rows=1)
    assert found.filter(F.col("ahead") == F.col("x") + 70).count() == 493
    assert found.filter("ahead is null").count() == 7
