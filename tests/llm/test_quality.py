import hashlib
import zlib

import numpy as np
import pytest

from driftwalk.llm import quality
from made import sentences


def test_gradient():
    rolls = np.random.default_rng(0)
    features, starts = rolls.normal(size=(9, quality.FEATURES)), np.array([0, 2, 3])
    target = np.array([1.0, 0.0, 1.0])
    model = quality.Attention.start(features, 0.5)

    def loss():
        score = model.forward(features, starts)["score"]
        return -(target * np.log(score) + (1 - target) * np.log(1 - score)).mean()

    for name, found in model.gradient(features, starts, target).items():
        flat, at = model.weights[name].reshape(-1), rolls.integers(model.weights[name].size)
        before = flat[at]
        flat[at] = before + 1e-6
        above = loss()
        flat[at] = before - 1e-6
        slope = (above - loss()) / 2e-6
        flat[at] = before
        assert found.reshape(-1)[at] == pytest.approx(slope, abs=1e-6), name


def test_attention_sums_to_one_and_finds_the_bad_part(rows):
    good = sentences(30, 300, 400)
    docs, labels = [], []
    for i, text in enumerate(good):
        bad = i % 3 == 0
        docs.append((i, text + " " + "JUNK!! " * 150 + text if bad else text + " " + text))
        labels.append((i, int(not bad)))
    table, marks = rows(docs, "doc_id long, text string"), rows(labels, "doc_id long, quality int")
    made = quality.classify_quality(table, marks).collect()
    held = [r for r in made if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [r.predicted == int(r.doc_id % 3 != 0) for r in held]
    assert np.mean(right) > 0.95
    kept = quality.drop_low_quality(table, marks)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in made if r.predicted}


def test_odd_rows(rows, odd_docs):
    marks = rows([(1, 1), (2, 0), (2, None), (None, 1), (6, 1), (7, 0), (7, 1)], "doc_id long, quality int")
    made = quality.classify_quality(odd_docs, marks)
    got = made.collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {True}
    assert quality.classify_quality(odd_docs.limit(0), marks).count() == 0
    none = quality.classify_quality(odd_docs, marks.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    same = quality.classify_quality(odd_docs, marks.where("quality = 1")).collect()
    assert {r.score for r in same} == {1.0}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    scored = quality.op9_quality(spark, folder).join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id"
    )
    held = scored.where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() >= 0.95


def test_repeated_ids_are_one_document_of_the_fit(rows, monkeypatch):
    free = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % quality.FOLDS]
    first, second = free[:2]
    many = [(first, f"text number {i} of one id") for i in range(50)]
    smallest = min((t for _, t in many), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    other = (second, "another text")
    seen = []
    start = quality.Attention.start

    def spy(features, share):
        seen.append((features.copy(), share))
        return start(features, share)

    monkeypatch.setattr(quality.Attention, "start", spy)
    labels = rows([(first, 1), (second, 0)], "doc_id long, quality int")
    for docs in ([*many, other], [(first, smallest), other]):
        quality.fit_quality(rows(docs, "doc_id long, text string"), labels)
    assert [s for _, s in seen] == [0.5, 0.5]
    assert (seen[0][0] == seen[1][0]).all() and len(seen[0][0]) == 2
