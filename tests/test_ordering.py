import random

import pytest
from pyspark.sql import functions as F

from driftwalk.operators import ordering


def shuffled(n, series=("a", "b", None)):
    rows = [(series[i % 7 % len(series)], i, float(i * 37 % 11)) for i in range(n)]
    random.Random(1).shuffle(rows)
    return rows


def expected_index(rows):
    seen, out = {}, {}
    for name, at, _ in sorted(rows, key=lambda r: r[1]):
        out[(name, at)] = seen.get(name, 0)
        seen[name] = seen.get(name, 0) + 1
    return out


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("slices", [1, 4, 7])
def test_index_by_series_keeps_null_series(table, bounded, slices):
    rows = shuffled(500)
    df = table(rows, "s string, at int, v double")
    found = ordering.index_rows(df, ["at"], ["s"], bounded=bounded, slices=slices).collect()
    assert {(r["s"], r["at"]): r["row_idx"] for r in found} == expected_index(rows)


@pytest.mark.parametrize("slices", [1, 4, 7])
def test_index_of_one_long_series(table, slices):
    rows = [(i,) for i in random.Random(2).sample(range(1000), 300)]
    found = ordering.index_rows(table(rows, "at int"), ["at"], slices=slices).collect()
    assert {r["at"]: r["row_idx"] for r in found} == {v: i for i, (v,) in enumerate(sorted(rows))}


def test_existing_index_is_kept(table):
    df = table([(5,), (9,)], "row_idx int")
    found = ordering.index_rows(df, ["row_idx"])
    assert found.schema["row_idx"].dataType.simpleString() == "bigint"
    assert sorted(r[0] for r in found.collect()) == [5, 9]


@pytest.mark.parametrize("bounded", [True, False])
def test_running_sums(table, bounded):
    rows = shuffled(300)
    df = table(rows, "s string, at int, v double")
    found = ordering.running_sums(
        df, ["s"], ["at"], {"total": F.col("v"), "rows": F.lit(1)}, bounded, slices=5
    ).collect()
    sums, wanted = {}, {}
    for s, at, v in sorted(rows, key=lambda r: r[1]):
        total, n = sums.get(s, (0, 0))
        sums[s] = wanted[(s, at)] = (total + v, n + 1)
    assert {(r["s"], r["at"]): (r["total"], r["rows"]) for r in found} == wanted


def test_halo_holds_what_frames_need(spark):
    df = spark.range(25).withColumnRenamed("id", "row_idx")
    parts = {}
    for r in ordering.with_halo(df, before=12, after=3, part_rows=10).collect():
        parts.setdefault(r[ordering.PART], set()).add(r["row_idx"])
    for part in range(3):
        own = range(part * 10, min(part * 10 + 10, 25))
        assert parts[part] >= set(range(max(own[0] - 12, 0), min(own[-1] + 4, 25)))
    kept = ordering.own_rows(ordering.with_halo(df, 12, 3, 10), 10).collect()
    assert sorted(r["row_idx"] for r in kept) == list(range(25))
    with pytest.raises(ValueError):
        ordering.with_halo(df, before=-1)


@pytest.mark.parametrize("bounded", [True, False])
def test_compact_index(table, bounded):
    rows = [(s, i) for s in "ab" for i in range(100) if i % 3]
    df = table(rows, "s string, row_idx bigint").withColumn("was", F.col("row_idx"))
    found = ordering.compact_index(df, ["s"], bounded=bounded, part_rows=16).collect()
    wanted = {(s, v): i for s in "ab" for i, v in enumerate(v for v in range(100) if v % 3)}
    assert {(r["s"], r["was"]): r["row_idx"] for r in found} == wanted


@pytest.mark.parametrize("limit", [0, 100])
def test_attach_by_part_small_and_large(table, monkeypatch, limit):
    monkeypatch.setattr(ordering, "broadcast_if_small", lambda df: df if limit == 0 else F.broadcast(df))
    df = table([(s, i) for s in "ab" for i in range(50)], "s string, row_idx bigint")
    stats = table([("a", 1.0, 50), ("b", 2.0, 50)], "s string, v double, num_rows bigint")
    found = ordering.attach_by_part(df, stats, ["s"], part_rows=8).collect()
    assert len(found) == 100
    assert {(r["s"], r["v"]) for r in found} == {("a", 1.0), ("b", 2.0)}


@pytest.mark.parametrize("series", [[], ["s"]])
def test_totals_of_blocks_of_blocks(spark, series):
    """Slices summed in blocks of two, over several levels, give the same order."""
    rows = spark.range(3000).selectExpr("id", "id % 3 AS s", "(id * 7919) % 3000 AS k")
    options = dict(bounded=False, slices=23)
    expected = {r.id: r.row_idx for r in ordering.index_rows(rows, ["k"], series, **options).collect()}
    deep = ordering.index_rows(rows, ["k"], series, block_slices=2, **options)
    assert {r.id: r.row_idx for r in deep.collect()} == expected
    sums = {"total": F.col("k")}
    flat = ordering.running_sums(rows, series, ["k"], sums, **options)
    tree = ordering.running_sums(rows, series, ["k"], sums, block_slices=3, **options)
    assert {r.id: r.total for r in tree.collect()} == {r.id: r.total for r in flat.collect()}


def test_slices_follow_the_input(spark, monkeypatch):
    rows = spark.range(4000)
    assert ordering._slice_count(rows, None)[0] is None
    monkeypatch.setattr(ordering, "SLICE_BYTES", 1000)
    assert ordering._slice_count(rows, None) == (32, 32)
    assert ordering._slice_count(rows, 5) == (5, 5)
    assert ordering._slice_count(rows.join(rows, "id"), None)[0] is None


def test_rows_not_from_storage_have_no_known_size(spark, table):
    """Their estimate is the largest long, which once asked for 2**35 slices."""
    made = table([("a", 1), ("a", 0), (None, 0)], "s string, i int")
    assert ordering._plain_bytes(made) is None
    assert ordering._plain_bytes(spark.range(10).filter("id > 3")) < 1000
    found = ordering.running_sums(made, [], ["i", "s"], {"n": F.lit(1)}, bounded=False).collect()
    assert sorted(r["n"] for r in found) == [1, 2, 3]
