"""Compare registered queries with their SQL: ``python -m catalog.check [names]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark, connection, query, sql: str, folder: str) -> str | None:
    """None when rows agree exactly, else the first difference."""
    ours = query(spark, folder).toPandas()
    theirs = connection.execute(sql).df()
    names = sorted(ours.columns)
    if names != sorted(theirs.columns):
        return f"columns {names} / {sorted(theirs.columns)}"
    kinds = [(n, str(ours[n].dtype), str(theirs[n].dtype)) for n in names]
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"

    def rows(table):
        table = table[names].astype(object)
        table = table.where(table.notna(), None)
        return sorted(map(tuple, table.itertuples(index=False)), key=_key)

    for a, b in zip(rows(ours), rows(theirs)):
        if a != b:
            return f"values {a} / {b} of {names}"
    odd = [k for k in kinds if k[1] != k[2]]
    return f"types {odd}" if odd and len(ours) else None


def main() -> int:
    from catalog import ORACLES, QUERIES
    from driftwalk.session import local_session

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    connection = connect(folder)
    failed = 0
    for name in sys.argv[1:] or QUERIES:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, connection, QUERIES[name], ORACLES[name], folder)
            else:
                problem = None if len(QUERIES[name](spark, folder).toPandas()) else "no rows"
        except Exception as error:  # the report goes on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        mark = "rows" if name not in ORACLES else "ok"
        print(f"{name:40s} {time.time() - start:6.2f}s {problem or mark}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
