import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwalk.functions.columns import decay_weights
from driftwalk.operators import normalise, windows

LENGTHS = {"a": 53, "b": 20, "c": 4, "d": 5}


@pytest.fixture()
def rows(table):
    data = [(s, i, float(i * i % 17), float(i % 5), float(i)) for s, n in LENGTHS.items() for i in range(n)]
    return table(data, "s string, row_idx bigint, f double, g double, y double")


def starts(n, length, stride, chunk):
    size = chunk or n
    return [
        c + k
        for c in range(0, n, size)
        for k in range(0, min(size, n - c) - length + 1, stride)
    ]


@pytest.mark.parametrize("chunk", [0, 16, 3])
@pytest.mark.parametrize("stride", [1, 2, 7])
@pytest.mark.parametrize("limit", [10**6, 1])
def test_windows(rows, monkeypatch, chunk, stride, limit):
    monkeypatch.setattr(windows, "BOUNDED_ROWS", limit)
    found = windows.sliding_windows(rows, ["f"], "y", 5, stride, ["s"], chunk, part_rows=8)
    got = {}
    for r in found.collect():
        at = r["window_start"]
        assert [x["f"] for x in r["features"]] == [float(i * i % 17) for i in range(at, at + 5)]
        assert r["y"] == at + 4 and r["window_end"] == at + 4
        got.setdefault(r["s"], {})[r["window_id"]] = at
    for s, n in LENGTHS.items():
        assert got.get(s, {}) == dict(enumerate(starts(n, 5, stride, chunk))), s
    counts = windows.count_windows(rows, 5, stride, ["s"], chunk).collect()
    assert {r["s"]: r["num_windows"] for r in counts} == {
        s: len(starts(n, 5, stride, chunk)) for s, n in LENGTHS.items()
    }


@pytest.mark.parametrize("chunk", [0, 16])
def test_lookup(rows, chunk):
    for ordinal in (0, 9):
        found = {r["s"]: r for r in windows.window_at(rows, ordinal, ["f"], "y", 5, 2, ["s"], chunk).collect()}
        for s, n in LENGTHS.items():
            at = dict(enumerate(starts(n, 5, 2, chunk))).get(ordinal)
            assert (s in found) == (at is not None)
            if at is not None:
                assert found[s]["window_start"] == at and found[s]["y"] == at + 4
                assert [x["f"] for x in found[s]["features"]] == [float(i * i % 17) for i in range(at, at + 5)]
    for bad in (-1, 1000):
        with pytest.raises(IndexError):
            windows.window_at(rows, bad, ["f"], "y", 5, 2, ["s"], chunk)
    with pytest.raises(ValueError):
        windows.window_at(rows, 0, ["f"], "y", 0)


def test_window_means(rows):
    found = windows.window_means(rows, ["f"], "y", 5, series=["s"], part_rows=8).collect()
    for r in found:
        at = r["window_start"]
        assert r["f"] == pytest.approx(np.mean([i * i % 17 for i in range(at, at + 5)]))
    weights = decay_weights(5, 0.5)
    assert sum(weights) == pytest.approx(1) and weights[-1] == pytest.approx(2 * weights[-2])
    decayed = windows.window_means(rows, ["f"], "y", 5, series=["s"], decay=0.5).collect()
    assert len(decayed) == len(found)
    for r in decayed:
        at = r["window_start"]
        assert r["f"] == pytest.approx(sum(w * ((at + k) ** 2 % 17) for k, w in enumerate(weights)))


def test_score_windows(rows):
    found = windows.sliding_windows(rows, ["f", "g"], "y", 5, series=["s"])
    scored = windows.score_windows(found, lambda b: b["features"].map(lambda w: w[-1]["g"] + 1))
    assert all(r["prediction"] == r["window_end"] % 5 + 1 for r in scored.collect())
    assert scored.count() == found.count()


def test_two_way_normalisation(rows):
    params = normalise.TwoWay(0.001, 0.7, feature_scale=[2.0, 3.0, 1.0])
    found = normalise.two_way_normalize(rows, ["f", "g", "y"], 5, ["s"], params, part_rows=8).collect()
    assert len(found) == sum(len(starts(n, 5, 1, 0)) for n in LENGTHS.values())
    for r in found:
        i = np.arange(r["window_start"], r["window_start"] + 5)
        x = np.column_stack([i * i % 17, i % 5, i]).astype(float)
        guard = lambda s: np.where(s < 1e-4, 1.0, s)
        z2 = (x - x.mean(0)) / guard(x.std(0, ddof=1))
        z1 = (x - x.mean(1)[:, None]) / guard(x.std(1, ddof=1))[:, None]
        wanted = 0.01 * z1 + 0.7 * z2 * np.array([2.0, 3.0, 1.0])
        np.testing.assert_allclose(np.array(r["normalized"]), wanted, atol=1e-9)


def test_constant_windows_are_guarded(table):
    df = table([(i, 2.0, 2.0) for i in range(6)], "row_idx bigint, f double, g double")
    for r in normalise.two_way_normalize(df, ["f", "g"], 3).collect():
        assert np.allclose(r["normalized"], 0.0)


def test_attention_summaries(table):
    rng = np.random.default_rng(0)
    att = rng.random((3, 6, 6)) - 0.3
    data = [(h, q, k, float(att[h, q, k])) for h in range(3) for q in range(6) for k in range(6)]
    df = table(data, "head int, query int, key int, weight double")
    reach = np.abs(np.arange(6)[:, None] - np.arange(6))
    for r in normalise.attention_distance(df, ["head"]).collect():
        assert r["mean_distance"] == pytest.approx((np.abs(att[r["head"]]) * reach).sum() / 6)
    for r in normalise.attention_peaks(df, ["head"]).collect():
        row = att[r["head"], r["query"]]
        assert (r["max_weight"], r["max_key"]) == (row.max(), row.argmax())
    tied = df.withColumn("weight", F.lit(1.0))
    assert {r["max_key"] for r in normalise.attention_peaks(tied, ["head"]).collect()} == {0}


def test_many_features_and_long_windows(spark):
    """79 features over 60 rows: decayed means and dense batches, against numpy."""
    rng = np.random.default_rng(4)
    values = rng.normal(size=(130, 79))
    names = [f"f{i}" for i in range(79)]
    data = [(i, *map(float, v), float(i)) for i, v in enumerate(values)]
    schema = "row_idx bigint, " + ", ".join(f"{n} double" for n in names) + ", y double"
    df = spark.createDataFrame(data, schema).repartition(4)
    weights = np.array(decay_weights(60, 0.9))
    for r in windows.window_means(df, names, "y", 60, decay=0.9).collect():
        start = r["window_start"]
        np.testing.assert_allclose([r[n] for n in names], weights @ values[start : start + 60])
    found = windows.sliding_windows(df, names, "y", 60)
    shapes = windows.score_arrays(found, lambda b: b[:, -1, 78] + b.shape[1] * 1000 + b.shape[2])
    for r in shapes.collect():
        expected = values[r["window_start"] + 59, 78] + 60_079
        assert r["prediction"] == pytest.approx(expected)
    assert "features" not in shapes.columns and shapes.count() == 71
