import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture()
def rows(spark):
    """A table of tuples over three partitions."""

    def make(values, schema):
        return spark.createDataFrame(values, schema).repartition(3)

    return make


@pytest.fixture()
def odd_docs(rows):
    """Nulls, empty and long texts, repeated rows and ids, and columns that clash."""
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    values = [
        (1, "alpha beta\nshared line of text", "a"),
        (2, "Shared Line of text \nother", "b"),
        (2, "Shared Line of text \nother", "b"),
        (3, None, None),
        (4, "", "c"),
        (None, "shared line of text\nno id here", "d"),
        (None, None, None),
        (5, "   \t\n\n  ", "e"),
        (6, long_text, "f"),
        (7, "İstanbul ΣΑΣ 👍 naïve café", "g"),
    ]
    return rows(values, "doc_id long, text string, n_lines string").selectExpr(
        "*", "1 AS gone", "2 AS lines", "3 AS score", "4 AS hash", "5 AS n_tokens", "6 AS ids",
        "7 AS shard", "8 AS node", "9 AS key", "10 AS owner", "11 AS row_key",
    )
