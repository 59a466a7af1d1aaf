import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwalk.operators import cleaning, labels
from driftwalk.plans.prepare import prepare_features_and_labels


def scaled(values, k=5.0):
    """The scaling as written down for one array."""
    values = np.asarray(values, float)
    mean, std = values.mean(), values.std()
    if not std > 1e-9:
        return np.zeros(len(values))
    dev = np.clip(values, mean - k * std, mean + k * std) - mean
    out = np.zeros(len(values))
    if (dev > 0).any():
        out[dev > 0] = dev[dev > 0] / dev.max()
    if (dev < 0).any():
        out[dev < 0] = dev[dev < 0] / -dev.min()
    return out


SERIES = {
    "mixed": list(np.random.default_rng(0).normal(size=200)) + [40.0, -35.0],
    "constant": [2.5] * 5,
    "one_sided": [1.0] * 9 + [7.0],
    "single": [3.0],
}


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("k", [5.0, 1.0])
def test_normalize_labels(table, bounded, k):
    rows = [(s, i, float(v)) for s, vs in SERIES.items() for i, v in enumerate(vs)]
    df = table(rows, "s string, row_idx bigint, l_value double")
    found = labels.normalize_labels(df, series=["s"], num_std=k, bounded=bounded, part_rows=16).toPandas()
    for s, vs in SERIES.items():
        one = found[found.s == s].sort_values("row_idx")
        np.testing.assert_allclose(one.normalized_l_value, scaled(vs, k), atol=1e-12)


def test_normalize_by_training_rows_only(table):
    values = [0.0, 1.0, 2.0, 50.0]
    df = table(list(enumerate(values)), "row_idx bigint, l_value double")
    found = labels.normalize_labels(df, fit_rows=F.col("row_idx") < 3).toPandas().sort_values("row_idx")
    assert list(found.normalized_l_value[:3]) == [-1.0, 0.0, 1.0]
    assert found.normalized_l_value.iloc[3] > 1


def test_zero_price_gives_no_label(table):
    df = table([(0, 5.0), (1, 0.0), (2, 7.0), (3, 8.0)], "row_idx bigint, mid_price double")
    found = labels.trend_labels(df, shift_length=1).toPandas().sort_values("row_idx")
    assert list(found.l_value.isna()) == [False, True, False, True]


def test_drop_nulls_keeps_nan(table):
    df = table([(1.0, "a"), (None, "b"), (float("nan"), "c"), (4.0, None)], "x double, s string")
    assert {r["s"] for r in cleaning.drop_null_rows(df).collect()} == {"a", "c"}
    assert cleaning.drop_null_rows(df, ["x"]).count() == 3


def test_feature_selection():
    columns = ["row_idx", "mid_price", "a", "b", "l_value"]
    assert cleaning.select_features(columns, "mid_price") == ["a", "b"]
    assert cleaning.select_features(columns, "mid_price", ["b", "zzz", "l_value"]) == ["b"]
    with pytest.raises(ValueError):
        cleaning.select_features(columns, "mid_price", ["zzz"])


def test_row_guards(table, spark):
    df = table([(i,) for i in range(10)], "row_idx bigint")
    assert sorted(r[0] for r in cleaning.slice_rows(df, 3, 4).collect()) == [3, 4, 5, 6]
    with pytest.raises(ValueError):
        cleaning.slice_rows(df, -1, 4)
    with pytest.raises(ValueError):
        cleaning.require_rows(df.filter("false"))


@pytest.mark.parametrize("bounded", [True, False])
def test_prepare_renumbers_after_drops(table, bounded):
    rng = np.random.default_rng(3)
    rows = [
        (s, i, None if (s, i) == ("a", 4) else float(p), float(i))
        for s in "ab"
        for i, p in enumerate(50 + rng.normal(size=60))
    ]
    rows[10] = ("a", 10, 0.0, 10.0)
    df = table(rows, "s string, at int, mid_price double, f double")
    found, features, label = prepare_features_and_labels(
        df, ["at"], ["s"], shift_length=3, bounded=bounded, part_rows=1, check_rows=True
    )
    assert features == ["f"] and found.columns == ["s", "row_idx", "f", label]
    one = found.filter("s = 'a'").toPandas().sort_values("row_idx")
    # One null price, one zero price, three rows without a look-ahead.
    assert list(one.row_idx) == list(range(60 - 5))
    assert set(range(57)) - set(one.f) == {4.0, 10.0}
    assert one[label].abs().max() == 1.0


def test_prepare_refuses_empty_tables(table):
    df = table([(1, 2.0, 3.0)], "at int, mid_price double, f double")
    with pytest.raises(ValueError):
        prepare_features_and_labels(df, ["at"], shift_length=5, check_rows=True)
