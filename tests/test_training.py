"""The training loop against plain loops over samples."""

import hashlib

import numpy as np
import pytest

from driftwalk.operators.moments import task_moments
from driftwalk.operators.tasks import TaskShape
from driftwalk.plans import training

SHAPE = TaskShape(12, 6, 6, 1)
START, INNER, OUTER = [1.0, -0.5], 0.05, 0.2


def made(splits, rows=60, seed=1):
    rolls = np.random.default_rng(seed)
    out = []
    for split in splits:
        x = rolls.normal(size=(rows, 2))
        y = x @ [0.3, 1.0] + rolls.normal(size=rows) * 0.7
        out += [(split, i, rows, *map(float, x[i]), float(y[i])) for i in range(rows)]
    return out


@pytest.fixture()
def moments(table):
    def build(splits=("train", "valid"), partitions=3, **options):
        rows = table(
            made(splits, **options),
            "split string, split_row long, split_rows long, a double, b double, y double",
            partitions,
        )
        return task_moments(rows, ["a", "b"], "y", SHAPE)

    return build


def tasks_of(split, rows):
    """(support, query) samples of each task of a split."""
    own = np.array([r[3:] for r in rows if r[0] == split])
    n = (len(own) - SHAPE.total - SHAPE.seq_length - 1) // SHAPE.interval + 1 if len(own) else 0
    cut = []
    for t in range(max(n, 0)):
        at = t * SHAPE.interval
        cut.append((own[at : at + 12], own[at + 12 : at + 18]))
    return cut


def gradient(w, part):
    """Of ``1 - corr``, by small differences."""
    def loss(w):
        return 1 - np.corrcoef(part[:, :2] @ w, part[:, 2])[0, 1]

    return np.array([(loss(w + d) - loss(w - d)) / 2e-6 for d in np.eye(2) * 1e-6])


def plain(rows, epochs, block, seed=7):
    tasks, judged = tasks_of("train", rows), tasks_of("valid", rows)
    w, history = np.array(START), []
    for epoch in range(1, epochs + 1):
        def mixed(t):
            return hashlib.md5(f"train|{t}|{epoch}|{seed}".encode()).hexdigest()

        order = sorted(range(len(tasks)), key=mixed)
        ends, loss = [], 0.0
        for first in range(0, len(order), block):
            own = w.copy()
            for t in order[first : first + block]:
                support, query = tasks[t]
                adapted = own - INNER * gradient(own, support)
                loss += 1 - np.corrcoef(query[:, :2] @ adapted, query[:, 2])[0, 1]
                own = own - OUTER * gradient(adapted, query)
            ends.append((len(order[first : first + block]), own))
        w = sum(n * e for n, e in ends) / len(order)
        scores = []
        for support, query in judged:
            adapted = w - INNER * gradient(w, support)
            scores.append(np.corrcoef(query[:, :2] @ adapted, query[:, 2])[0, 1])
        history.append((loss / len(order), float(np.mean(scores)), w))
    return history


@pytest.mark.parametrize("block", [1000, 3])
def test_epochs_equal_plain_loops(moments, block):
    rows = made(("train", "valid"))
    found = training.offline_training(
        moments(), START, 3, INNER, OUTER, patience=3, block_tasks=block, seed=7
    )
    got = found.history.orderBy("epoch").collect()
    for row, (loss, value, weights) in zip(got, plain(rows, 3, block), strict=True):
        assert row.train_loss == pytest.approx(loss, abs=1e-6)
        assert row.valid_value == pytest.approx(value, abs=1e-6)
        assert row.weights == pytest.approx(list(weights), abs=1e-5)
    best = max(got, key=lambda r: r.valid_value)
    assert found.best_epoch == best.epoch
    assert found.base.first().base == pytest.approx([*best.weights, 0.0])


def test_stops_and_keeps_the_best(moments, monkeypatch):
    values = iter([0.1, 0.3, 0.3, None, 0.4])

    class Row(dict):
        pass

    class Frame:
        def first(self):
            return Row(mean=next(values))

    monkeypatch.setattr(training, "metric_summary", lambda *a: Frame())
    found = training.offline_training(moments(), START, 9, INNER, OUTER, patience=2)
    assert (found.best_epoch, found.stop_epoch, found.history.count()) == (2, 4, 4)
    kept = found.history.where("epoch = 2").first().weights
    assert found.base.first().base == [*kept, 0.0]
    row = training.stopped(found, 2).first()
    assert (row.best_epoch, row.stop_epoch) == (2, 4)


def test_goes_on_where_it_broke_off(moments, tmp_path):
    sums = moments()
    options = dict(patience=9, block_tasks=4, seed=3)
    whole = training.offline_training(sums, START, 3, INNER, OUTER, **options)
    path = str(tmp_path / "states")
    training.offline_training(sums, START, 2, INNER, OUTER, path=path, **options)
    on = training.offline_training(sums, START, 3, INNER, OUTER, path=path, resume=True, **options)
    assert on.history.orderBy("epoch").collect() == whole.history.orderBy("epoch").collect()
    assert on.best_epoch == whole.best_epoch


def test_partitions_decide_nothing(moments):
    few, many = (
        training.offline_training(moments(partitions=p), START, 2, INNER, OUTER, block_tasks=2)
        .history.orderBy("epoch").collect()
        for p in (1, 7)
    )
    for a, b in zip(few, many):
        assert a.weights == pytest.approx(b.weights, rel=1e-9)


def test_missing_splits(moments):
    no_valid = training.offline_training(moments(("train",)), START, 3, INNER, OUTER, patience=2)
    assert (no_valid.best_epoch, no_valid.stop_epoch) == (None, 2)
    no_train = training.offline_training(moments(("valid",)), START, 2, INNER, OUTER)
    assert no_train.base.first().base == [*START, 0.0] and no_train.best_epoch == 1
    with pytest.raises(ValueError):
        training.offline_training(moments(), START, 2, INNER, OUTER, metric="corr_loss")
    with pytest.raises(ValueError):
        training.offline_training(moments(), START, 0, INNER, OUTER)
