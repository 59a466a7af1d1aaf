"""Footers of files on storage, and row order taken from files."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from driftwalk.sources import files


@pytest.fixture()
def folder(tmp_path):
    """Files of unequal length, one empty, with odd names and row groups of three rows."""
    place = tmp_path / "a b+c%20é"
    (place / "deep").mkdir(parents=True)
    n, lengths = 0, {}
    for name, rows in (("00", 7), ("01", 0), ("deep/02 x+y", 4), ("03%41", 1)):
        values = pa.table({"v": pa.array(range(n, n + rows), pa.int64()), "row_idx": ["x"] * rows})
        pq.write_table(values, f"{place}/{name}.parquet", row_group_size=3)
        lengths[f"{name}.parquet"] = rows
        n += rows
    (place / "_hidden.parquet").write_bytes(b"none")
    (place / "note.txt").write_text("none")
    return place, lengths


def test_infos(spark, folder):
    place, lengths = folder
    (place / "00a.parquet").write_bytes(b"PAR1 this is no footer PAR1")
    with pytest.warns(UserWarning, match="1 unreadable.*00a"):
        found = files.file_infos(spark, [str(place)])
    got = [(r.filename.split("c%20é/")[1], r.length, r.row_groups) for r in found.collect()]
    expected = [(n, rows, max(1, -(-rows // 3))) for n, rows in lengths.items()]
    assert sorted(got) == sorted(expected)
    assert [r.filename for r in found.collect()] == sorted(r.filename for r in found.collect())
    problems = {r.filename.split("/")[-1]: r.problem for r in files.footers(spark, [str(place)]).collect()}
    assert problems.pop("00a.parquet") and not any(problems.values())
    assert files.file_infos(spark, []).count() == 0


def test_index_is_that_of_the_rows(spark, folder):
    place, lengths = folder
    found = files.index_by_files(spark, [str(place)])
    names = sorted(lengths)
    starts, at = {}, 0
    for name in names:
        starts[name], at = at, at + lengths[name]
    first = {"00.parquet": 0, "deep/02 x+y.parquet": 7, "03%41.parquet": 11, "01.parquet": 7}
    expected = {
        first[name] + i: starts[name] + i for name in names for i in range(lengths[name])
    }
    assert {r.v: r.row_idx for r in found.collect()} == expected
    assert found.columns == ["v", "row_idx"]
    assert sorted(r.row_idx for r in found.collect()) == list(range(12))


def test_index_over_many_files(spark, tmp_path):
    """Spark's own files, in more slices than one."""
    path = str(tmp_path / "many")
    spark.range(0, 5000, 1, 23).write.parquet(path)
    found = files.index_by_files(spark, [path])
    assert found.where("id <> row_idx").count() == 0 and found.count() == 5000


def test_columns_of_all_files(spark, folder):
    place, _ = folder
    path = str(place)
    assert files.checked_columns(spark, [path], None, ["v"]) == ["row_idx"]
    with pytest.raises(ValueError, match="w"):
        files.checked_columns(spark, [path], ["w"], [])
    (place / "zz.parquet").write_bytes(b"none")
    with pytest.raises(ValueError, match="cannot read"):
        files.checked_columns(spark, [path], None, ["v"])
