import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftwalk.operators import metrics


def pairs(seed=0):
    rng = np.random.default_rng(seed)
    for g, n in [("a", 40), ("b", 25), ("tiny", 1), ("flat", 6)]:
        p = np.round(rng.normal(size=n), 1)
        t = np.full(n, 2.0) if g == "flat" else np.round(0.5 * p + rng.normal(size=n), 1)
        yield g, p, t


def numpy_scores(p, t):
    out = {
        "mse": -np.mean((p - t) ** 2),
        "mae": -np.mean(np.abs(p - t)),
        "rmse": -np.sqrt(np.mean((p - t) ** 2)),
        "mape": -np.mean(np.abs(p - t) / np.maximum(np.abs(t), 1.17e-6)),
        "smape": -np.mean(2 * np.abs(p - t) / np.maximum(np.abs(p) + np.abs(t), 1.17e-6)),
    }
    if len(p) > 1:
        cov = np.cov(100 * p, 100 * t)
        out["concordance"] = 2 * cov[0, 1] / (cov[0, 0] + cov[1, 1] + (100 * (p - t)).mean() ** 2)
    if t.std() > 0:
        out["r2"] = 1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum()
        out["explained_variance"] = 1 - (t - p).var() / t.var()
        out["pearson"] = np.corrcoef(p, t)[0, 1]
        out["spearman"] = np.corrcoef(pd.Series(p).rank(), pd.Series(t).rank())[0, 1]
    return out


@pytest.mark.parametrize("bounded", [True, False])
def test_regression_metrics(table, bounded):
    data = [(g, float(a), float(b)) for g, p, t in pairs() for a, b in zip(p, t)]
    df = table([*data, ("a", None, 1.0), ("a", 1.0, None)], "g string, p double, t double")
    names = [*metrics.REGRESSION, "spearman"]
    found = {r["g"]: r for r in metrics.regression_metrics(df, "p", "t", ["g"], names, bounded).collect()}
    for g, p, t in pairs():
        wanted = numpy_scores(p, t)
        for name in names:
            if name in wanted:
                assert found[g][name] == pytest.approx(wanted[name], rel=1e-9), (g, name)
            else:
                assert found[g][name] is None, (g, name)


def test_unknown_metric(table):
    df = table([("a", 1.0, 1.0)], "g string, p double, t double")
    with pytest.raises(ValueError):
        metrics.regression_metrics(df, "p", "t", ["g"], ["nope"])
    with pytest.raises(ValueError):
        metrics.binary_metrics(df, "p", "t", ["g"], ["mse"])


def labelled(seed=1):
    rng = np.random.default_rng(seed)
    for g, n in [("a", 60), ("b", 30), ("one_class", 8)]:
        t = np.ones(n, int) if g == "one_class" else rng.integers(0, 2, n)
        s = np.round(np.clip(0.3 * t + rng.random(n), 0, 1), 1)
        yield g, s, t


def area(s, t):
    wins = [(a > b) + 0.5 * (a == b) for a in s[t == 1] for b in s[t == 0]]
    return np.mean(wins) if wins else None


def average_precision(s, t):
    if not t.sum():
        return None
    out, before = 0.0, 0.0
    for cut in sorted(set(s), reverse=True):
        chosen = s >= cut
        recall = (chosen & (t == 1)).sum() / t.sum()
        out += (recall - before) * (t[chosen] == 1).mean()
        before = recall
    return out


@pytest.mark.parametrize("bounded", [True, False])
def test_ranking_metrics(table, bounded):
    data = [(g, float(a), int(b)) for g, s, t in labelled() for a, b in zip(s, t)]
    df = table(data, "g string, s double, t int")
    found = {r["g"]: r for r in metrics.ranking_metrics(df, "s", "t", ["g"], bounded).collect()}
    for g, s, t in labelled():
        for name, wanted in [("auroc", area(s, t)), ("average_precision", average_precision(s, t))]:
            if wanted is None:
                assert found[g][name] is None
            else:
                assert found[g][name] == pytest.approx(wanted)


def test_binary_metrics(table):
    data = [(g, int(a > 0.5), int(b)) for g, s, t in labelled() for a, b in zip(s, t)]
    df = table(data, "g string, p int, t int")
    found = {r["g"]: r for r in metrics.binary_metrics(df, "p", "t", ["g"]).collect()}
    for g, s, t in labelled():
        p = (s > 0.5).astype(int)
        tp, fp = ((p == 1) & (t == 1)).sum(), ((p == 1) & (t == 0)).sum()
        fn, tn = ((p == 0) & (t == 1)).sum(), ((p == 0) & (t == 0)).sum()
        r, n = found[g], len(t)
        assert r["accuracy"] == pytest.approx((tp + tn) / n)
        assert r["precision"] == pytest.approx(tp / (tp + fp))
        assert r["recall"] == pytest.approx(tp / (tp + fn))
        assert r["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
        assert r["specificity"] == pytest.approx(tn / (tn + fp) if tn + fp else 0.0)
        if g == "one_class":
            assert r["matthews_corr"] is None
        else:
            assert r["matthews_corr"] == pytest.approx(np.corrcoef(p, t)[0, 1])
            chance = p.mean() * t.mean() + (1 - p.mean()) * (1 - t.mean())
            assert r["cohen_kappa"] == pytest.approx(((tp + tn) / n - chance) / (1 - chance))


def test_multiclass_with_a_class_never_predicted(table):
    rng = np.random.default_rng(2)
    t = rng.integers(0, 3, 50)
    p = np.where(t == 2, 0, np.where(rng.random(50) < 0.7, t, 1 - t))
    df = table([("g", int(a), int(b)) for a, b in zip(p, t)], "g string, p int, t int")
    r = metrics.multiclass_metrics(df, "p", "t", ["g"]).first()
    recalls = [(p[t == c] == c).mean() for c in range(3)]
    precisions = [(t[p == c] == c).mean() if (p == c).any() else 0.0 for c in range(3)]
    f1 = [2 * a * b / (a + b) if a + b else 0.0 for a, b in zip(recalls, precisions)]
    specific = [(p[t != c] != c).mean() for c in range(3)]
    assert r["accuracy"] == r["recall"] == pytest.approx(np.mean(recalls))
    assert r["precision"] == pytest.approx(np.mean(precisions))
    assert r["f1"] == pytest.approx(np.mean(f1))
    assert r["specificity"] == pytest.approx(np.mean(specific))
    onehot = lambda v: np.eye(3)[v] - np.eye(3)[v].mean(0)
    cov = lambda a, b: (onehot(a) * onehot(b)).sum()
    assert r["matthews_corr"] == pytest.approx(cov(p, t) / np.sqrt(cov(p, p) * cov(t, t)))


def test_one_vs_rest(table):
    rng = np.random.default_rng(3)
    scores, t = np.round(rng.random((40, 3)), 1), rng.integers(0, 3, 40)
    df = table([("g", list(map(float, s)), int(c)) for s, c in zip(scores, t)], "g string, s array<double>, t int")
    r = metrics.one_vs_rest_metrics(df, "s", "t", ["g"]).first()
    assert r["auroc"] == pytest.approx(np.mean([area(scores[:, c], (t == c).astype(int)) for c in range(3)]))
    # Probabilities of rounded scores would tie up to rounding errors.
    scores = rng.random((40, 3))
    df = table([("g", list(map(float, s)), int(c)) for s, c in zip(scores, t)], "g string, s array<double>, t int")
    raised = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    r = metrics.one_vs_rest_metrics(df, "s", "t", ["g"], logits=True).first()
    assert r["auroc"] == pytest.approx(np.mean([area(raised[:, c], (t == c).astype(int)) for c in range(3)]))


def test_predicted_class(table):
    df = table([(0.5, [0.1, 0.7, 0.2], 2.5), (0.6, [0.9, 0.9, 0.0], 3.5)], "s double, v array<double>, x double")
    found = df.select(
        metrics.predicted_class("s").alias("binary"),
        metrics.predicted_class(scores="v").alias("best"),
        metrics.predicted_class("x", binary=False).alias("nearest"),
    ).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 2), (1, 0, 4)]
    with pytest.raises(ValueError):
        metrics.predicted_class()


def test_is_binary(table):
    df = table([("a", 0), ("a", 1), ("a", 1), ("b", 0), ("b", 1), ("b", 2)], "g string, t int")
    assert {r["g"]: r["is_binary"] for r in metrics.is_binary(df, "t", ["g"]).collect()} == {"a": True, "b": False}


def stop_by_loop(values, patience):
    best, best_epoch, left = -np.inf, None, patience
    for epoch, value in enumerate(values, 1):
        if value > best:
            best, best_epoch, left = value, epoch, patience
        else:
            left -= 1
            if left <= 0:
                return best_epoch, best, epoch
    return best_epoch, best, None


@pytest.mark.parametrize("patience", [1, 2, 3])
def test_early_stop(table, patience):
    rng = np.random.default_rng(4)
    runs = {"given": [0.1, 0.3, 0.3, 0.2, 0.4], "rising": [1.0, 2.0, 3.0], "falling": [3.0, 2.0, 1.0, 5.0]}
    runs |= {f"r{i}": list(np.round(rng.random(12), 1)) for i in range(20)}
    data = [(g, e, float(v)) for g, vs in runs.items() for e, v in enumerate(vs, 1)]
    df = table(data, "g string, number int, value double")
    found = metrics.early_stop(df, "number", "value", patience, ["g"]).collect()
    got = {r["g"]: (r["best_epoch"], r["best_value"], r["stop_epoch"]) for r in found}
    assert got == {g: stop_by_loop(vs, patience) for g, vs in runs.items()}
    if patience == 2:
        assert got["given"] == (2, 0.3, 4)
    with pytest.raises(ValueError):
        metrics.early_stop(df, "number", "value", 0)


@pytest.mark.parametrize("bounded", [True, False])
def test_running_mean_and_summary(table, bounded):
    values = [1.0, None, 4.0, 7.0]
    df = table([("a", i, v) for i, v in enumerate(values)], "g string, task_id int, v double")
    found = metrics.running_mean(df, "v", ["g"], ["task_id"], bounded).orderBy("task_id").collect()
    assert [r["running_mean"] for r in found] == [1.0, 1.0, 2.5, 4.0]
    row = metrics.metric_summary(df, "v", ["g"]).first()
    assert row["mean"] == 4.0 and row["spread"] == pytest.approx(np.std([1, 4, 7]))


def test_more_rows_than_integers_multiply(spark, monkeypatch):
    """Counts of billions: squares of them leave the range of a bigint."""
    cells = [("g", 0, 0, 5_000_000_000), ("g", 0, 1, 1_000_000_000), ("g", 1, 1, 4_500_000_000)]
    table = spark.createDataFrame(cells, "g string, pred int, target int, rows bigint")
    monkeypatch.setattr(metrics, "confusion", lambda *_: table)
    r = metrics.multiclass_metrics(table, "pred", "target", ["g"]).first()
    n, right = 10.5, 9.5
    cross = (6 * 5 + 4.5 * 5.5) / (n * n)
    assert r["cohen_kappa"] == pytest.approx((right / n - cross) / (1 - cross))
    spread = np.sqrt((n * n - 6**2 - 4.5**2) * (n * n - 5**2 - 5.5**2))
    assert r["matthews_corr"] == pytest.approx((right * n - cross * n * n) / spread)
    assert r["specificity"] == pytest.approx((4.5 / 5.5 + 1.0) / 2)


def test_unknown_classes_count_nowhere(table):
    rows = [("g", 0, 0), ("g", 1, 1), ("g", 1, 1), ("g", 1, None), ("g", None, 0), ("h", None, 1)]
    df = table(rows, "g string, p int, t int")
    (r,) = metrics.multiclass_metrics(df, "p", "t", ["g"]).collect()
    assert r["g"] == "g" and all(r[m] == pytest.approx(1.0) for m in metrics.COUNTED)


def test_rank_correlation_without_groups_and_of_constants(table):
    rng = np.random.default_rng(8)
    p, t = rng.integers(0, 4, 300) / 3, rng.normal(size=300).round(1)
    df = table([(float(a), float(b)) for a, b in zip(p, t)], "p double, t double")
    wanted = np.corrcoef(pd.Series(p).rank(), pd.Series(t).rank())[0, 1]
    r = metrics.regression_metrics(df, "p", "t", [], ["spearman", "mse"]).first()
    assert r["spearman"] == pytest.approx(wanted)
    assert r["mse"] == pytest.approx(-((p - t) ** 2).mean())
    flat = df.withColumn("p", df.p * 0 + 7)
    assert metrics.regression_metrics(flat, "p", "t", [], ["spearman"]).first()["spearman"] is None


def test_heavy_values_are_split_as_far_as_they_need(spark, table):
    """One value holds half of the distinct pairs; the others a pair each."""
    n, piece = 4000, 50
    rng = np.random.default_rng(11)
    p = np.where(np.arange(n) % 2 == 0, 0.0, rng.permutation(n) + 1.0)
    t = rng.permutation(n).astype(float)
    df = table([(float(a), float(b)) for a, b in zip(p, t)], "p double, t double")
    r = metrics.regression_metrics(df, "p", "t", [], ["spearman"], piece_rows=piece).first()
    assert r["spearman"] == pytest.approx(np.corrcoef(pd.Series(p).rank(), pd.Series(t).rank())[0, 1])
    pairs = df.withColumn("rows", F.lit(1))
    ranks, heavy = metrics._rank_table(pairs, [], "p", piece)
    assert [tuple(r) for r in heavy.collect()] == [(0.0, 41)]
    assert ranks.count() == n // 2 + 41
    key = F.pmod(F.xxhash64("t"), F.lit(41))
    sizes = [r["count"] for r in pairs.filter("p = 0").groupBy(key).count().collect()]
    assert len(sizes) == 41 and max(sizes) < 2 * n // 2 / 41
