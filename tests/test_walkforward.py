import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwalk.functions import linear
from driftwalk.operators import moments, splits
from driftwalk.operators.tasks import TaskShape
from driftwalk.plans import walkforward

SHAPE = TaskShape(12, 6, 6, 1)
N = 100


def data(seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(N, 3))
    return x, x @ [1.0, -2.0, 0.5] + 3 + 0.3 * rng.normal(size=N)


def parts(k):
    at = k * SHAPE.interval
    return slice(at, at + SHAPE.support), slice(at + SHAPE.support, at + SHAPE.total)


@pytest.fixture()
def found(table):
    rows = []
    for s in "ab":
        x, y = data(ord(s))
        rows += [(s, i, *map(float, x[i]), float(y[i])) for i in range(N)]
    df = table(rows, "s string, row_idx bigint, x1 double, x2 double, x3 double, y double")
    samples = splits.with_splits(df, ["s"])
    return moments.task_moments(samples, ["x1", "x2", "x3"], "y", SHAPE, ["s"])


def least_squares(x, y):
    a = np.column_stack([x, np.ones(len(x))])
    return np.linalg.lstsq(a, y, rcond=None)[0]


COUNT = (N - SHAPE.total - SHAPE.seq_length - 1) // SHAPE.interval + 1


def test_fit_and_score(found):
    rows = walkforward.fit_and_score(found, ["s"]).collect()
    assert len(rows) == 2 * COUNT
    for r in rows:
        x, y = data(ord(r["s"]))
        support, query = parts(r["task_id"])
        w = least_squares(x[support], y[support])
        np.testing.assert_allclose(r["coefficients"], w, atol=1e-8)
        p, t = x[query] @ w[:-1] + w[-1], y[query]
        assert r["mse"] == pytest.approx(-np.mean((p - t) ** 2))
        assert r["pearson"] == pytest.approx(np.corrcoef(p, t)[0, 1])
        assert r["corr_loss"] == pytest.approx(1 - np.corrcoef(p, t)[0, 1], abs=1e-6)
        cov = np.cov(p, t)
        assert r["concordance"] == pytest.approx(
            2 * cov[0, 1] / (cov[0, 0] + cov[1, 1] + (p.mean() - t.mean()) ** 2)
        )


def test_base_uses_all_query_rows(found):
    base = walkforward.base_coefficients(found, 4, split=None).first()["base"]
    xs, ys = [], []
    for s in "ab":
        x, y = data(ord(s))
        for k in range(COUNT):
            xs.append(x[parts(k)[1]])
            ys.append(y[parts(k)[1]])
    np.testing.assert_allclose(base, least_squares(np.vstack(xs), np.concatenate(ys)), atol=1e-8)
    by_series = walkforward.base_coefficients(found, 4, split=None, by=["s"])
    assert by_series.count() == 2
    scored = walkforward.adapt_and_score(found, by_series, 0.1, ["s"], by=["s"])
    assert scored.count() == 2 * COUNT


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    cov, w = np.cov(z.T, bias=True)[None], rng.normal(size=3)

    def loss(v):
        return 1 - np.corrcoef(z[:, :3] @ v, z[:, 3])[0, 1]

    numeric = [(loss(w + h) - loss(w - h)) / 2e-6 for h in np.eye(3) * 1e-6]
    np.testing.assert_allclose(linear.correlation_gradient(w[None], cov)[0], numeric, atol=1e-8)
    assert (linear.correlation_gradient(np.zeros((1, 3)), cov) == 0).all()


def test_step_lowers_the_support_loss(found):
    base = found.sparkSession.createDataFrame([([1.0, 1.0, 1.0, 0.0],)], "base array<double>")
    rows = walkforward.adapt_and_score(found, base, 0.2, ["s"]).collect()
    for r in rows:
        x, y = data(ord(r["s"]))
        support, query = parts(r["task_id"])
        loss = lambda w: 1 - np.corrcoef(x[support] @ w, y[support])[0, 1]
        w = np.array(r["coefficients"])
        assert loss(w[:3]) < loss(np.ones(3))
        assert (x[support] @ w[:3] + w[3]).mean() == pytest.approx(y[support].mean())
        before = 1 - np.corrcoef(x[query] @ np.ones(3), y[query])[0, 1]
        assert r["corr_loss_before"] == pytest.approx(before, abs=1e-6)
    kept = walkforward.adapt_and_score(found, base, 0.2, ["s"], level=False).first()
    assert kept["coefficients"][3] == 0.0


@pytest.mark.parametrize("with_prior", [False, True])
@pytest.mark.parametrize("keep", [0.3, 0.95])
def test_online_pass_equals_fold(found, keep, with_prior):
    split = found.withColumn(
        "split", F.when(F.col("task_id") < 3, "train").when(F.col("task_id") < 8, "valid").otherwise("test")
    )
    train = split.filter("split = 'train' and part = 'query'")
    prior = walkforward.merge_moments(train, 4) if with_prior else None
    rows = walkforward.online_pass(split, 4, keep, ["s"], prior=prior).collect()
    got = {(r["s"], r["task_id"]): r for r in rows}
    assert len(got) == 2 * (COUNT - 3)

    def gram(x, y):
        z = np.column_stack([x, y, np.ones(len(x))])
        return z.T @ z

    start = np.zeros((5, 5))
    if with_prior:
        for s in "ab":
            x, y = data(ord(s))
            start = start + sum(gram(x[parts(k)[1]], y[parts(k)[1]]) for k in range(3))
    for s in "ab":
        x, y = data(ord(s))
        state = start.copy()
        for k in range(3, COUNT):
            support, query = parts(k)
            m = state + gram(x[support], y[support])
            inner = m[np.ix_([0, 1, 2, 4], [0, 1, 2, 4])]
            w = np.linalg.solve(inner, m[[0, 1, 2, 4], 3])
            np.testing.assert_allclose(got[(s, k)]["coefficients"], w, atol=1e-7)
            p = x[query] @ w[:3] + w[3]
            assert got[(s, k)]["mse"] == pytest.approx(-np.mean((p - y[query]) ** 2))
            state = keep * state + gram(x[query], y[query])


@pytest.mark.parametrize("keep", [0.0, 0.4, 1.0])
def test_series_of_many_parts(found, keep):
    """States carried from part to part are those of one part."""

    def states(series, part_tasks):
        rows = found.filter("s = 'a'") if not series else found
        train = found.filter("task_id < 2 and part = 'query'")
        prior = walkforward.merge_moments(train, 4)
        fits = walkforward.online_pass(
            rows, 4, keep, series, ["all"], prior=prior, part_tasks=part_tasks
        )
        keys = [*series, "task_id"]
        return {tuple(r[k] for k in keys): r["coefficients"] for r in fits.collect()}

    for series in (["s"], []):
        whole = states(series, 1000)
        assert len(whole) == COUNT * max(1, 2 * len(series))
        for part_tasks in (1, 2, 5):
            parts = states(series, part_tasks)
            assert parts.keys() == whole.keys()
            for key, weights in parts.items():
                np.testing.assert_allclose(weights, whole[key], atol=1e-9)


def test_collinear_and_missing_support(spark):
    rows = [
        ("all", 0, "support", 4, [10.0, 20.0, 10.0], [30.0, 60.0, 30.0, 120.0, 60.0, 30.0]),
        ("all", 0, "query", 4, [10.0, 20.0, 12.0], [30.0, 60.0, 33.0, 120.0, 66.0, 44.0]),
        ("all", 1, "query", 1, [1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 4.0, 2.0, 1.0]),
    ]
    df = spark.createDataFrame(
        rows, "split string, task_id long, part string, n long, sums array<double>, products array<double>"
    )
    found = {r["task_id"]: r for r in walkforward.fit_and_score(df).collect()}
    np.testing.assert_allclose(found[0]["coefficients"], [0.2, 0.4, 0.0], atol=1e-9)
    assert found[1]["mse"] is None


@pytest.mark.parametrize("wide", [16, 0])
@pytest.mark.parametrize("shape", [TaskShape(400, 200, 200, 2), TaskShape(401, 199, 100, 2)])
def test_fit_needs_no_like_scales(table, wide, shape):
    """Spreads of 1e5 and 0.3, a level of 1e9, and gaps: the true weights come out."""
    rng = np.random.default_rng(5)
    x1, x2 = rng.normal(0, 1e5, 1300), rng.normal(0, 0.3, 1300)
    x3 = 1e9 + rng.normal(size=1300)
    y = 2 * x2 + 1e-5 * x1 + 3 * (x3 - 1e9)
    data = [
        (i, None if i % 11 == 0 else float(a), float(b), None if i % 13 == 0 else float(c), float(d))
        for i, (a, b, c, d) in enumerate(zip(x1, x2, x3, y))
    ]
    df = table(data, "row_idx bigint, x1 double, x2 double, x3 double, y double")
    rows = splits.with_splits(df, [])
    found = moments.task_moments(rows, ["x1", "x2", "x3"], "y", shape, [], wide)
    for r in walkforward.fit_and_score(found).collect():
        np.testing.assert_allclose(r["coefficients"][:3], [1e-5, 2.0, 3.0], rtol=1e-6)
    support = found.filter("part = 'support' AND task_id = 0").first()
    kept = sum(i % 11 > 0 and i % 13 > 0 for i in range(shape.support - 1))
    assert support["n"] == kept


def test_moments_of_a_whole_table_merge_as_a_tree(spark):
    """Many tasks, more than one of each key, equal the one product of all rows."""
    from driftwalk.operators import moments

    rolls = np.random.default_rng(2)
    values = rolls.normal(size=(900, 3)) + [1e6, 0, 5]
    upper = np.triu_indices(3)
    rows = []
    for part in values.reshape(300, 3, 3):
        apart = part - part.mean(0)
        rows.append(
            (3, part.sum(0).tolist(), (part.T @ part)[upper].tolist(), (apart.T @ apart)[upper].tolist())
        )
    schema = "n long, sums array<double>, products array<double>, spreads array<double>"
    table = spark.createDataFrame(rows, schema).repartition(40)
    monkey, moments.FAN = moments.FAN, 7
    try:
        found = walkforward.merge_moments(table, 3).collect()
        assert walkforward.merge_moments(table.limit(0), 3).count() == 0
    finally:
        moments.FAN = monkey
    apart = values - values.mean(0)
    assert len(found) == 1 and found[0]["n"] == 900
    np.testing.assert_allclose(found[0]["spreads"], (apart.T @ apart)[upper], atol=1e-7)
    np.testing.assert_allclose(found[0]["sums"], values.sum(0), rtol=1e-12)
