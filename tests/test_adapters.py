import numpy as np
import pyarrow as pa
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftwalk.functions.vectors import as_lists, stacked
from driftwalk.operators import adapters

RNG = np.random.default_rng(0)
HEADS, WIDTH, HIDDEN, STEPS = 4, 6, 3, 5
X = RNG.normal(size=(30, WIDTH))
WINDOWS = RNG.normal(size=(30, STEPS, WIDTH))
Y = RNG.normal(size=30)


def gate_by_hand(x, protos, temperature, projection=None):
    v = projection @ x if projection is not None else x
    s = np.array([v @ p / (np.linalg.norm(v) * np.linalg.norm(p)) for p in protos])
    return s, np.exp(s / temperature) / np.exp(s / temperature).sum()


@pytest.fixture()
def rows(table):
    data = [(i, x.tolist(), w.tolist(), float(y)) for i, (x, w, y) in enumerate(zip(X, WINDOWS, Y))]
    return table(data, "i int, x array<double>, w array<array<double>>, y double")


def gathered(df, column):
    frame = df.select("i", column.alias("v")).toPandas().sort_values("i")
    return np.array([np.array([list(s) if hasattr(s, "__len__") else s for s in v]) if hasattr(v, "__len__") else v for v in frame.v])


PROTOS = RNG.normal(size=(HEADS, WIDTH))
PROJECTION = RNG.normal(size=(HIDDEN, WIDTH))
LOW_PROTOS = RNG.normal(size=(HEADS, HIDDEN))
GAMMA, BETA = RNG.uniform(0.75, 1.25, HEADS), np.full(HEADS, 0.125)


def test_gates(rows):
    plain = gathered(rows, adapters.gate_column("x", adapters.Gate(PROTOS, 2.0)))
    np.testing.assert_allclose(plain, [gate_by_hand(x, PROTOS, 2.0)[1] for x in X])
    low = gathered(rows, adapters.gate_column("x", adapters.Gate(LOW_PROTOS, 4.0, PROJECTION)))
    np.testing.assert_allclose(low, [gate_by_hand(x, LOW_PROTOS, 4.0, PROJECTION)[1] for x in X])
    weights = 0.5 ** np.arange(STEPS - 1, -1, -1)
    mixed = gathered(rows, adapters.gate_column("w", adapters.Gate(PROTOS, 2.0)))
    for got, window in zip(mixed, WINDOWS):
        s = sum(w * gate_by_hand(x, PROTOS, 2.0)[0] for w, x in zip(weights / weights.sum(), window))
        np.testing.assert_allclose(got, np.exp(s / 2) / np.exp(s / 2).sum())
    steps = gathered(rows, adapters.gate_column("w", adapters.Gate(PROTOS, 2.0), steps=True))
    assert steps.shape == (30, STEPS, HEADS)
    np.testing.assert_allclose(steps.sum(-1), 1.0)


@pytest.mark.parametrize("inverse", [False, True])
def test_label_adapter(rows, inverse):
    adapter = adapters.LabelAdapter(adapters.Gate(LOW_PROTOS, 4.0, PROJECTION), GAMMA, BETA)
    got = gathered(rows, adapters.adapt_label("x", "y", adapter, inverse))
    for value, x, y in zip(got, X, Y):
        _, g = gate_by_hand(x, LOW_PROTOS, 4.0, PROJECTION)
        heads = (y - BETA) / (GAMMA + 1e-9) if inverse else (GAMMA + 1e-9) * y + BETA
        assert value == pytest.approx((g * heads).sum())


def test_round_trip_is_not_the_identity(rows):
    adapter = adapters.LabelAdapter(adapters.Gate(PROTOS, 4.0), GAMMA, BETA)
    once = rows.withColumn("a", adapters.adapt_label("x", "y", adapter))
    back = gathered(once, adapters.adapt_label("x", "a", adapter, inverse=True))
    assert np.abs(back - Y).max() > 1e-3
    single = adapters.LabelAdapter(adapters.Gate(PROTOS[:1], 4.0), GAMMA[:1], BETA[:1])
    once = rows.withColumn("a", adapters.adapt_label("x", "y", single))
    np.testing.assert_allclose(gathered(once, adapters.adapt_label("x", "a", single, inverse=True)), Y)


def test_feature_adapter(rows):
    weights, biases = RNG.normal(size=(HEADS, WIDTH, WIDTH)), RNG.normal(size=(HEADS, WIDTH))
    adapter = adapters.FeatureAdapter(adapters.Gate(PROTOS, 4.0), weights, biases)

    def by_hand(x):
        _, g = gate_by_hand(x, PROTOS, 4.0)
        return x + sum(g[h] * (weights[h] @ x + biases[h]) for h in range(HEADS))

    flat = gathered(adapters.adapt_features(rows, "x", adapter, "moved"), F.col("moved"))
    np.testing.assert_allclose(flat, [by_hand(x) for x in X])
    nested = gathered(adapters.adapt_features(rows, "w", adapter, "moved"), F.col("moved"))
    np.testing.assert_allclose(nested, [[by_hand(x) for x in w] for w in WINDOWS])


def test_forecast_without_adapters(rows):
    found = adapters.adapted_forecast(rows, "x", "y", lambda x: x[0] * 2)
    for r in found.collect():
        assert r["adapted_label"] == r["y"] and r["prediction"] == r["x"][0] * 2


def test_centroids_and_shift(table):
    df = table([(0, [1.0, 2.0], 1.0), (0, [3.0, 4.0], 2.0), (1, [5.0, 6.0], 4.0)], "k int, x array<double>, y double")
    np.testing.assert_allclose(adapters.centroids(df, "x", "k", 2), [[2, 3], [5, 6]])
    found = adapters.label_shift(df.withColumn("a", F.col("y") * 2), "a", "y", ["k"]).collect()
    assert {r["k"]: r["label_shift"] for r in found} == {0: 2.5, 1: 16.0}


def test_task_objective(table):
    df = table([(0.4, 0.6, 0.5)], "now double, old double, shift double")
    col = lambda **k: df.select(adapters.task_objective(F.col("now"), F.col("old"), F.col("shift"), **k)).first()[0]
    assert col() == pytest.approx(0.4 + 0.5 * 0.5 + 0.5 * (0.4 - 0.6))
    assert col(first_order=False) == pytest.approx(0.4 + 0.25)
    assert col(adapt_y=False) == 0.4
    assert col(reg=1.0, sigma=2.0) == pytest.approx(0.4 + 0.5 + 0.5 * -0.1)


def test_wrong_width():
    with pytest.raises(ValueError):
        adapters.Gate(PROTOS, 4.0).per_vector(np.ones((2, WIDTH + 1)))


def test_lists_and_arrays_round_trip():
    column = pa.array([[[1.0, 2.0], [3.0, 4.0]], None, [[5.0, 6.0], [7.0, 8.0]]])
    dense = stacked(column)
    assert dense.shape == (3, 2, 2) and np.isnan(dense[1]).all() and dense[2, 1, 0] == 7
    assert as_lists(dense[[0, 2]]).to_pylist() == [[[1, 2], [3, 4]], [[5, 6], [7, 8]]]


@pytest.mark.parametrize(
    "lists", [[[1.0, 2.0, 3.0], [4.0]], [[1.0], [2.0, 3.0]], [[], [1.0]], [[[1.0], [2.0, 3.0]]]]
)
def test_ragged_vectors_raise(lists):
    with pytest.raises(ValueError, match="vectors of"):
        stacked(pa.array(lists))


def test_null_and_empty_vectors():
    assert stacked(pa.array([None, [1.0, 2.0]]))[1].tolist() == [1.0, 2.0]
    assert stacked(pa.array([], pa.list_(pa.float64()))).shape == (0, 0)
    assert stacked(pa.array([[], []], pa.list_(pa.float64()))).shape == (2, 0)
    with pytest.raises(ValueError, match="null"):
        stacked(pa.array([[[1.0], None]]))


def test_null_vectors_stay_null(table):
    gate = adapters.Gate(np.array([[1.0, 0.0], [0.0, 1.0]]))
    adapter = adapters.FeatureAdapter(gate, np.zeros((2, 2, 2)), np.ones((2, 2)))
    df = table([(1, [1.0, 2.0]), (2, None)], "i int, x array<double>")
    found = adapters.adapt_features(df, "x", adapter, "moved")
    rows = {r["i"]: r for r in found.withColumn("g", adapters.gate_column("x", gate)).collect()}
    assert rows[2]["moved"] is None and rows[2]["g"] is None
    assert rows[1]["moved"] == [2.0, 3.0] and sum(rows[1]["g"]) == pytest.approx(1)
    with pytest.raises(ValueError, match="more than 1 labels"):
        adapters.centroids(df.withColumn("l", df.i), "x", "l", 2, max_heads=1)
