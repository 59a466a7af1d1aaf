"""Fixtures shared by the registered queries, in DataFrames and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the fixtures.
FILTER_LENGTH, SHIFT = 10, 3
SEQ, SUPPORT, QUERY, INTERVAL = 5, 20, 10, 10
CHUNK = 1000
TRAIN, VALID = 0.6, 0.2
TEMPERATURE = 10.0

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL giving the same rows."""

    def keep(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def r6(value: Column | str, digits: int = 6) -> Column:
    """Doubles rounded for comparison: summation order differs between engines."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), digits)


def sql_r6(value: str, digits: int = 6) -> str:
    """The same rounding in SQL; adding zero turns -0.0 into 0.0."""
    return f"round(CAST({value} AS DOUBLE), {digits}) + 0.0"


def ev(spark: SparkSession, folder: str) -> DataFrame:
    """Events: many series by user, price ``value``, features f1, f2, f3."""
    return read(spark, folder, "events").select(
        "user_id",
        "ts",
        "event_id",
        "value",
        F.col("value").alias("f1"),
        F.get_json_object("props", "$.k").cast("double").alias("f2"),
        F.hour("ts").cast("double").alias("f3"),
    )


EV_SQL = """
ev AS (
  SELECT user_id, ts, event_id, value, value AS f1,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS f2,
         CAST(hour(ts) AS DOUBLE) AS f3
  FROM events
),
evi AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx
  FROM ev
)"""

EV_SERIES, EV_ORDER = ["user_id"], ["ts", "event_id"]


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders: one long series, price ``o_totalprice``."""
    return read(spark, folder, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")


OR_ORDER = ["o_orderdate", "o_orderkey"]

OR_SQL = """
ori AS (
  SELECT o_orderkey, o_totalprice,
         row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_idx
  FROM orders
)"""


def filter_sql(source: str, price: str, length: float, key: str = "user_id") -> str:
    """Recursive SQL for the high-pass filter of ``source`` (key, row_idx, price)."""
    return f"""
coef AS (
  SELECT 2 * exp(-w) * cos(w) AS c2, -exp(-2 * w) AS c3,
         (1 + 2 * exp(-w) * cos(w) + exp(-2 * w)) / 4 AS c1
  FROM (SELECT 1.414 * pi() / {length} AS w)
),
bent AS (
  SELECT {key} AS k, row_idx AS i, {price} AS x,
         {price} - 2 * coalesce(lag({price}, 1) OVER s, 0) + coalesce(lag({price}, 2) OVER s, 0) AS d
  FROM {source} WINDOW s AS (PARTITION BY {key} ORDER BY row_idx)
),
hpf AS (
  SELECT k, i, x, c1 * d AS hp, CAST(0 AS DOUBLE) AS hp1 FROM bent, coef WHERE i = 0
  UNION ALL
  SELECT b.k, b.i, b.x, c.c1 * b.d + c.c2 * h.hp + c.c3 * h.hp1, h.hp
  FROM hpf h JOIN bent b ON b.k = h.k AND b.i = h.i + 1, coef c
),
filtered AS (SELECT k, i, x, hp, x - hp AS fp FROM hpf)"""


def labelled_sql(extra: str = "f1, f2, f3") -> str:
    """Labels of EV: columns user_id, row_idx, value, features, l_value."""
    return (
        EV_SQL
        + ","
        + filter_sql("evi", "value", FILTER_LENGTH)
        + f""",
ahead AS (
  SELECT k, i, x, hp, fp, lead(fp, {SHIFT}) OVER (PARTITION BY k ORDER BY i) AS ffp
  FROM filtered
),
labelled AS (
  SELECT e.user_id, e.row_idx, e.value, e.event_id, {", ".join("e." + c.strip() for c in extra.split(","))},
         a.hp, a.fp AS filtered_price, a.ffp AS future_filtered_price,
         (a.ffp - a.x) / nullif(a.x, 0) AS l_value
  FROM evi e JOIN ahead a ON a.k = e.user_id AND a.i = e.row_idx
)"""
    )


PREPARED_SQL = (
    labelled_sql()
    + """,
kept AS (SELECT * FROM labelled WHERE l_value IS NOT NULL),
spreads AS (
  SELECT user_id, avg(l_value) AS m, stddev_pop(l_value) AS s FROM kept GROUP BY user_id
),
clipped AS (
  SELECT k.*, s.m, s.s, greatest(least(l_value, m + 5 * s), m - 5 * s) AS c
  FROM kept k JOIN spreads s USING (user_id)
),
extremes AS (
  SELECT user_id, max(CASE WHEN c > m THEN c - m END) AS up,
         max(CASE WHEN c < m THEN m - c END) AS down
  FROM clipped GROUP BY user_id
),
prepared AS (
  SELECT c.user_id,
         row_number() OVER (PARTITION BY c.user_id ORDER BY c.row_idx) - 1 AS row_idx,
         c.value, c.f1, c.f2, c.f3,
         CASE WHEN s <= 1e-9 THEN 0.0
              WHEN c.c > m AND up > 1e-9 THEN (c.c - m) / up
              WHEN c.c < m AND down > 1e-9 THEN (c.c - m) / down
              ELSE 0.0 END AS label
  FROM clipped c JOIN extremes e USING (user_id)
)"""
)
