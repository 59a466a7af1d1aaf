import hashlib
from collections import Counter

import pytest

from driftwalk.llm import sharding


def test_table_is_even_and_stable():
    names = sharding.shard_names(20)
    table = sharding.lookup_table(names, 10_007)
    sizes = Counter(table)
    assert len(table) == 10_007 and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 10_007)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.15 * len(table)


def test_first_turns_follow_preferences():
    names = ["a", "b", "c"]
    table = sharding.lookup_table(names, 13)
    firsts = [sharding._number(f"offset {n}") % 13 for n in names]
    assert table[firsts[0]] == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 12)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"], 13)


def test_rows_go_where_the_table_says(odd_docs):
    names = sharding.shard_names(7)
    placed = sharding.place_rows(odd_docs, names, slots=101).collect()
    table = sharding.lookup_table(names, 101)
    assert len(placed) == odd_docs.count()
    for row in placed:
        key = str(row.doc_id) if row.doc_id is not None else (row.text or "")
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (row.slot, row.shard, row.shard_name) == (slot, table[slot], names[table[slot]])
    assert sharding.place_rows(odd_docs.limit(0), names, slots=101).count() == 0


def test_written_shards(spark, odd_docs):
    from driftwalk.staging import new_path

    path = new_path(spark, "shards")
    sharding.write_shards(sharding.place_rows(odd_docs, sharding.shard_names(3), slots=101), path)
    assert spark.read.parquet(path).count() == odd_docs.count()
