from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftwalk.operators import splits
from driftwalk.sources import chunks, tables
from driftwalk.staging import new_path


@pytest.fixture()
def rows(spark):
    return spark.range(2, 1025).select((F.col("id") - 2).alias("row_idx"), F.col("id").alias("v")).repartition(5)


def test_chunks_on_storage(spark, rows):
    path = new_path(spark, "chunks")
    chunks.write_chunks(rows, path, 100)
    back = spark.read.parquet(path).withColumn("file", F.input_file_name())
    found = back.groupBy("chunk_id").agg(
        F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.min("row_idx").alias("lo")
    )
    for r in found.collect():
        assert r["files"] == 1 and r["lo"] == r["chunk_id"] * 100
        assert r["n"] == (23 if r["chunk_id"] == 10 else 100)
    some = chunks.read_chunks(spark, path, 2, 3)
    assert some.count() == 200
    assert "PartitionFilters: [isnotnull(bucket" in some._jdf.queryExecution().toString()


def test_no_chunking(rows):
    infos = splits.chunk_infos(rows, 0).collect()
    assert [(r["chunk_id"], r["num_rows"]) for r in infos] == [(0, 1023)]
    with pytest.raises(ValueError):
        splits.chunk_of(-1)


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_split_sizes(rows, seed):
    infos = splits.chunk_infos(rows, 100)
    found = splits.split_chunks(infos, 0.6, 0.2, seed=seed).collect()
    assert Counter(r["split"] for r in found) == {"train": 6, "valid": 2, "test": 3}
    order = [r["split"] for r in sorted(found, key=lambda r: r["chunk_id"])]
    chronological = ["train"] * 6 + ["valid"] * 2 + ["test"] * 3
    assert (order == chronological) == (seed is None)


def test_shuffles_are_stable(rows):
    infos = splits.chunk_infos(rows, 10)
    first, again, other = (
        {r["chunk_id"]: r["position"] for r in splits.shuffled_order(d, ["chunk_id"], e, 7).collect()}
        for d, e in [(infos, 0), (infos.repartition(9), 0), (infos, 1)]
    )
    assert first == again != other
    assert sorted(first.values()) == list(range(103))


@pytest.mark.parametrize("ratios", [(0.0, 0.5), (0.5, 1.0), (0.7, 0.4)])
def test_ratios_are_checked(ratios):
    with pytest.raises(ValueError):
        splits.check_ratios(*ratios)


def test_split_rows_follow_their_chunks(table):
    rows = [(s, i) for s, n in [("a", 95), ("b", 40), ("c", 3)] for i in range(n)]
    df = table(rows, "s string, row_idx bigint")
    chunked = splits.split_chunks(splits.chunk_infos(df, 10, ["s"]), 0.6, 0.2, ["s"]).collect()
    of_chunk = {(r["s"], r["chunk_id"]): r["split"] for r in chunked}
    found = splits.with_splits(df, ["s"], (0.6, 0.2), 10).collect()
    assert len(found) == 138
    for name in "abc":
        for split in ("train", "valid", "test"):
            own = sorted((r for r in found if (r["s"], r["split"]) == (name, split)), key=lambda r: r["row_idx"])
            assert [r["split_row"] for r in own] == list(range(len(own)))
            assert all(r["split_rows"] == len(own) for r in own)
            assert all(of_chunk[(name, r["row_idx"] // 10)] == split for r in own)


def test_load_table(spark, table):
    df = table([(1, "x"), (2, "y")], "a int, b string")
    for ending in ("csv", "parquet"):
        path = f"{new_path(spark, 'table')}.{ending}"
        if ending == "csv":
            df.write.option("header", True).csv(path)
        else:
            tables.write_table(df, path)
        assert sorted(map(tuple, tables.load_table(spark, path).collect())) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        tables.load_table(spark, "table.json")


def test_read_files_checks_every_file(spark, table):
    good, bad = new_path(spark, "good"), new_path(spark, "bad")
    tables.write_table(table([(1.0, 2.0, 0.5)], "a double, b double, y double"), good)
    tables.write_table(table([(1.0, 0.5)], "a double, y double"), bad)
    assert tables.read_files(spark, [good, bad], "y", ["a"]).count() == 2
    assert tables.read_files(spark, [good], "y").columns == ["a", "b", "y"]
    for paths, label, features in [
        ([good, bad], "y", ["a", "b"]),
        ([good], "z", ["a"]),
        ([good], "y", ["a", "y"]),
        ([], "y", None),
    ]:
        with pytest.raises(ValueError):
            tables.read_files(spark, paths, label, features)


def test_feature_names(spark, tmp_path):
    path = tmp_path / "features.txt"
    path.write_text("'bid_size_1',\n\n  ask_price_1\n\"mid_price\",\n'ask_size_1' ,\n")
    names = tables.read_feature_names(spark, str(path), "mid_price")
    assert names == ["bid_size_1", "ask_price_1", "ask_size_1"]
    tables.write_feature_names(spark, names, str(tmp_path / "saved"))
    assert tables.read_feature_names(spark, str(tmp_path / "saved"), "mid_price") == names


def test_runs_are_appended(spark):
    path = new_path(spark, "runs")
    tables.append_run(spark, path, "first", "mse", -0.5, {"scaler": "a"})
    tables.append_run(spark, path, "second", "mse", None, {})
    found = {r["run"]: r for r in tables.read_runs(spark, path).collect()}
    assert found["first"]["value"] == -0.5 and found["first"]["artifacts"] == {"scaler": "a"}
    assert found["second"]["value"] is None and found["second"]["finished"] is not None


def test_feature_names_query_stays_off_the_driver(spark, monkeypatch):
    from catalog import chunks as queries

    def never(*_):
        raise AssertionError("a list of all names on the driver")

    monkeypatch.setattr(tables, "read_feature_names", never)
    monkeypatch.setattr(tables, "write_feature_names", never)
    folder = "/root/testdata/sf0.001"
    got = queries.feature_names(spark, folder).orderBy("position").collect()
    parts = spark.read.parquet(f"{folder}/part.parquet").select("p_name").distinct().collect()
    assert [tuple(r) for r in got] == list(enumerate(sorted(r[0] for r in parts)))
