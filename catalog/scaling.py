"""Robust scaling queries on the numeric lineitem columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    EV_ORDER,
    EV_SERIES,
    EV_SQL,
    OR_SQL,
    TRAIN,
    ev,
    r6,
    read,
    register,
    sql_r6,
)
from catalog.labels import indexed_orders
from driftwalk.operators.joins import attach, broadcast_if_small
from driftwalk.operators.ordering import index_rows
from driftwalk.operators.scaling import RobustScaler, SeriesScaler, training_head
from driftwalk.staging import new_path

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]

PARAMS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, median({c}) AS median, mad({c}) * 1.4826 AS mad FROM lineitem"
    for c in COLUMNS
)
FIT_SQL = f"""SELECT feature, {sql_r6("median")} AS median, {sql_r6("mad")} AS mad
              FROM ({PARAMS_SQL})"""


def scaled_sql(column: str) -> str:
    return f"({column} - m_{column}) / (d_{column} + 1e-8)"


STATS_SQL = "stats AS (SELECT " + ", ".join(
    f"median({c}) AS m_{c}, mad({c}) * 1.4826 AS d_{c}" for c in COLUMNS
) + " FROM lineitem)"


def transformed_sql(expression) -> str:
    values = ", ".join(f"{sql_r6(expression(c))} AS {c}" for c in COLUMNS)
    return f"WITH {STATS_SQL} SELECT {', '.join(KEYS)}, {values} FROM lineitem, stats"


def clipped_sql(column: str) -> str:
    return f"least(greatest({scaled_sql(column)}, -3.0), 3.0)"


def lineitem(spark, folder):
    return read(spark, folder, "lineitem").select(*KEYS, *COLUMNS)


def rounded(df):
    return df.select(*KEYS, *[r6(c).alias(c) for c in COLUMNS])


def params(scaler, spark):
    frame = scaler.to_frame(spark)
    return frame.select("feature", r6("median").alias("median"), r6("mad").alias("mad"))


@register("robust_fit", FIT_SQL)
def robust_fit(spark, folder):
    return params(RobustScaler().fit(lineitem(spark, folder), COLUMNS), spark)


@register("robust_fit_by_selection", FIT_SQL)
def robust_fit_by_selection(spark, folder):
    """The path for tables too large to sort: brackets narrowed by sketches."""
    return params(RobustScaler().fit(lineitem(spark, folder), COLUMNS, median_cells=0), spark)


@register(
    "robust_fit_head",
    f"""WITH {OR_SQL}, head AS (
          SELECT o_totalprice AS x FROM ori
          WHERE row_idx < floor((SELECT count(*) FROM orders) * {TRAIN}))
        SELECT 'o_totalprice' AS feature, {sql_r6("median(x)")} AS median,
               {sql_r6("mad(x) * 1.4826")} AS mad FROM head""",
)
def robust_fit_head(spark, folder):
    rows = indexed_orders(spark, folder)
    head = training_head(rows, TRAIN, rows.count())
    return params(RobustScaler().fit(head, ["o_totalprice"]), spark)


@register("robust_transform", transformed_sql(clipped_sql))
def robust_transform(spark, folder):
    rows = lineitem(spark, folder)
    return rounded(RobustScaler().fit(rows, COLUMNS).transform(rows))


@register("robust_fit_transform_unclipped", transformed_sql(scaled_sql))
def robust_fit_transform_unclipped(spark, folder):
    return rounded(RobustScaler(clip_outlier=False).fit_transform(lineitem(spark, folder), COLUMNS))


@register(
    "robust_inverse_transform",
    transformed_sql(lambda c: f"{clipped_sql(c)} * d_{c} + m_{c}"),
)
def robust_inverse_transform(spark, folder):
    rows = lineitem(spark, folder)
    scaler = RobustScaler().fit(rows, COLUMNS)
    return rounded(scaler.inverse_transform(scaler.transform(rows)))


@register("robust_save_load", transformed_sql(clipped_sql))
def robust_save_load(spark, folder):
    rows = lineitem(spark, folder)
    path = new_path(spark, "scaler")
    RobustScaler().fit(rows, COLUMNS).save(spark, path)
    return rounded(RobustScaler.load(spark, path).transform(rows))


@register(
    "attach_parameters",
    f"""WITH p AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY l_returnflag)
        SELECT {", ".join(KEYS)}, l_returnflag, {sql_r6("l_quantity - m")} AS centred
        FROM lineitem JOIN p USING (l_returnflag)""",
)
def attach_parameters(spark, folder):
    """A fitted number per group put next to every row of the group."""
    rows = read(spark, folder, "lineitem").select(*KEYS, "l_returnflag", "l_quantity")
    fitted = rows.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("centre"))
    rows = attach(rows, broadcast_if_small(fitted), ["l_returnflag"])
    centred = r6(F.col("l_quantity") - F.col("centre")).alias("centred")
    return rows.select(*KEYS, "l_returnflag", centred)


EV_COLUMNS = ["f1", "f2", "f3"]


def user_params_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT user_id, '{c}' AS feature, {sql_r6(f'median({c})')} AS median, {sql_r6(f'mad({c}) * 1.4826')} AS mad "
        f"FROM {source} GROUP BY user_id"
        for c in EV_COLUMNS
    )


def user_params(scaler):
    return scaler.params.select(
        "user_id", "feature", r6("median").alias("median"), r6("mad").alias("mad")
    )


@register("robust_fit_by_user", f"WITH {EV_SQL} {user_params_sql('ev')}")
def robust_fit_by_user(spark, folder):
    return user_params(SeriesScaler(EV_SERIES).fit(ev(spark, folder), EV_COLUMNS))


@register("robust_fit_by_user_long", f"WITH {EV_SQL} {user_params_sql('ev')}")
def robust_fit_by_user_long(spark, folder):
    """The path for series of any length."""
    return user_params(SeriesScaler(EV_SERIES).fit(ev(spark, folder), EV_COLUMNS, bounded=False))


@register(
    "robust_fit_head_by_user",
    f"""WITH {EV_SQL}, head AS (
          SELECT * FROM evi QUALIFY row_idx < floor(count(*) OVER (PARTITION BY user_id) * {TRAIN})
        ) {user_params_sql('head')}""",
)
def robust_fit_head_by_user(spark, folder):
    """The first rows of each user's own series."""
    rows = index_rows(ev(spark, folder), EV_ORDER, EV_SERIES)
    head = training_head(rows, TRAIN, series=EV_SERIES)
    return user_params(SeriesScaler(EV_SERIES).fit(head, EV_COLUMNS))


@register(
    "robust_transform_by_user",
    f"""WITH {EV_SQL}, stats AS (
          SELECT user_id, {", ".join(f"median({c}) AS m_{c}, mad({c}) * 1.4826 AS d_{c}" for c in EV_COLUMNS)}
          FROM ev GROUP BY user_id
        )
        SELECT event_id, {", ".join(f"{sql_r6(clipped_sql(c))} AS {c}" for c in EV_COLUMNS)}
        FROM ev JOIN stats USING (user_id)""",
)
def robust_transform_by_user(spark, folder):
    """Fitted, saved, loaded and applied."""
    rows, path = ev(spark, folder), new_path(spark, "scalers")
    SeriesScaler(EV_SERIES).fit(rows, EV_COLUMNS).save(path)
    scaled = SeriesScaler.load(spark, path, EV_SERIES).transform(rows)
    return scaled.select("event_id", *[r6(c).alias(c) for c in EV_COLUMNS])
