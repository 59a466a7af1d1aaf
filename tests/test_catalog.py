"""The registered queries and the driver's contract, on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from catalog.check import compare, connect

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
ALL = os.environ.get("CHECK_ALL")

# One query per area by default; CHECK_ALL=1 compares every one.
SOME = [
    "drop_nulls",
    "row_index_hot_series",
    "prepare_features_and_labels",
    "robust_transform",
    "read_chunk_range",
    "task_windows",
    "metric_concordance",
    "metric_auroc",
    "adapted_forecast",
    "fit_tasks",
    "stream_labels_by_batch",
]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()) if ALL else SOME)
def test_query_equals_sql(spark, duck, name):
    query = contract.queries()[name]
    assert compare(spark, duck, query, contract.oracle_sql()[name], FOLDER) is None


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    found = contract.entry(spark)
    assert found.columns == ["user_id", "row_idx", "f1", "f2", "f3", "label"]
    assert found.count() > 0
