"""Cleaning, indexing, filtering and labelling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    EV_ORDER,
    EV_SERIES,
    EV_SQL,
    FILTER_LENGTH,
    OR_ORDER,
    OR_SQL,
    PREPARED_SQL,
    SHIFT,
    ev,
    filter_sql,
    labelled_sql,
    orders,
    r6,
    read,
    register,
    sql_r6,
)
from driftwalk.operators import cleaning, labels, ordering, recurrence
from driftwalk.plans.prepare import prepare_features_and_labels
from driftwalk.staging import stage


def indexed_ev(spark, folder):
    return ordering.index_rows(ev(spark, folder), EV_ORDER, EV_SERIES)


def indexed_orders(spark, folder):
    return ordering.index_rows(orders(spark, folder), OR_ORDER)


def prepared_ev(spark, folder):
    """The prepared EV table: user_id, row_idx, f1, f2, f3, label."""
    table, _, name = prepare_features_and_labels(
        ev(spark, folder),
        EV_ORDER,
        EV_SERIES,
        price="value",
        features=["f1", "f2", "f3"],
        filter_length=FILTER_LENGTH,
        shift_length=SHIFT,
    )
    return table.withColumnRenamed(name, "label")


def processed_ev(spark, folder):
    """The prepared table written once; windows and tasks read it."""
    return stage(prepared_ev(spark, folder), "processed")


@register(
    "drop_nulls",
    """SELECT event_id, user_id, nullif(event_type, 'error') AS event_type, value
       FROM events WHERE event_type <> 'error' AND value IS NOT NULL""",
)
def drop_nulls(spark, folder):
    events = read(spark, folder, "events").select(
        "event_id",
        "user_id",
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        "value",
    )
    return cleaning.drop_null_rows(events)


@register(
    "cast_to_double",
    f"""WITH {EV_SQL}
        SELECT event_id, CAST(user_id AS DOUBLE) AS user_id, value, f2 FROM ev""",
)
def cast_to_double(spark, folder):
    rows = ev(spark, folder).select("event_id", "user_id", "value", "f2")
    return cleaning.cast_to_double(rows, ["user_id", "value", "f2"])


@register("row_index_series", f"WITH {EV_SQL} SELECT event_id, user_id, CAST(row_idx AS BIGINT) AS row_idx FROM evi")
def row_index_series(spark, folder):
    return indexed_ev(spark, folder).select("event_id", "user_id", "row_idx")


@register("row_index_long", f"WITH {OR_SQL} SELECT o_orderkey, CAST(row_idx AS BIGINT) AS row_idx FROM ori")
def row_index_long(spark, folder):
    return indexed_orders(spark, folder).select("o_orderkey", "row_idx")


@register(
    "row_index_hot_series",
    """SELECT event_id, event_type,
              CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS row_idx
       FROM events""",
)
def row_index_hot_series(spark, folder):
    """Few series holding a large share of the rows each: ordered in slices."""
    events = read(spark, folder, "events").select("event_id", "event_type", "ts")
    indexed = ordering.index_rows(events, EV_ORDER, ["event_type"], bounded=False)
    return indexed.select("event_id", "event_type", "row_idx")


@register("row_slice", f"WITH {OR_SQL} SELECT o_orderkey, CAST(row_idx AS BIGINT) AS row_idx FROM ori WHERE row_idx BETWEEN 500 AND 1749")
def row_slice(spark, folder):
    rows = cleaning.slice_rows(indexed_orders(spark, folder), 500, 1250)
    return rows.select("o_orderkey", "row_idx")


@register(
    "feature_selection",
    f"WITH {EV_SQL} SELECT event_id, f1, f2, f3 FROM evi",
)
def feature_selection(spark, folder):
    rows = indexed_ev(spark, folder)
    chosen = cleaning.select_features(rows.columns, "value", reserved=["user_id", "ts"])
    return rows.select(*chosen)


FILTERED = f"""WITH RECURSIVE {EV_SQL}, {filter_sql("evi", "value", FILTER_LENGTH)}
SELECT k AS user_id, CAST(i AS BIGINT) AS row_idx, """


@register("high_pass_filter", FILTERED + sql_r6("fp") + " AS filtered_price FROM filtered")
def high_pass_filter(spark, folder):
    rows = recurrence.high_pass_filter(indexed_ev(spark, folder), "value", FILTER_LENGTH, EV_SERIES)
    return rows.select("user_id", "row_idx", r6("filtered_price").alias("filtered_price"))


@register("high_pass_residual", FILTERED + sql_r6("hp") + " AS residual FROM filtered")
def high_pass_residual(spark, folder):
    rows = recurrence.high_pass_filter(
        indexed_ev(spark, folder), "value", FILTER_LENGTH, EV_SERIES, residual="residual"
    )
    return rows.select("user_id", "row_idx", r6("residual").alias("residual"))


# One series of all rows: each value as the sum of its last 256 inputs weighted
# by the filter's response, which has decayed to nothing by then.
LONG_FILTER_SQL = f"""
w AS (SELECT 1.414 * pi() / {FILTER_LENGTH} AS w),
bent AS (
  SELECT row_idx AS i, o_totalprice AS x,
         o_totalprice - 2 * coalesce(lag(o_totalprice, 1) OVER s, 0)
           + coalesce(lag(o_totalprice, 2) OVER s, 0) AS d
  FROM ori WINDOW s AS (ORDER BY row_idx)
),
response AS (
  SELECT k, (1 + 2 * exp(-w) * cos(w) + exp(-2 * w)) / 4 * exp(-w * k) * sin((k + 1) * w) / sin(w) AS g
  FROM range(256) t(k), w
),
spread_out AS (
  SELECT b.i + r.k AS i, sum(r.g * b.d) AS hp FROM bent b CROSS JOIN response r GROUP BY 1
),
long_filtered AS (
  SELECT b.i, b.x, b.x - s.hp AS fp FROM bent b JOIN spread_out s USING (i)
)"""


@register(
    "high_pass_filter_long",
    f"""WITH {OR_SQL}, {LONG_FILTER_SQL}
        SELECT CAST(i AS BIGINT) AS row_idx, {sql_r6("fp", 4)} AS filtered_price FROM long_filtered""",
)
def high_pass_filter_long(spark, folder):
    rows = recurrence.high_pass_filter(
        indexed_orders(spark, folder), "o_totalprice", FILTER_LENGTH, part_rows=1000
    )
    return rows.select("row_idx", r6("filtered_price", 4).alias("filtered_price"))


@register(
    "trend_labels_long",
    f"""WITH {OR_SQL}, {LONG_FILTER_SQL}
        SELECT CAST(i AS BIGINT) AS row_idx,
               {sql_r6("(lead(fp, 60) OVER (ORDER BY i) - x) / x")} AS l_value
        FROM long_filtered""",
)
def trend_labels_long(spark, folder):
    rows = labels.trend_labels(
        indexed_orders(spark, folder), "o_totalprice", FILTER_LENGTH, 60, part_rows=1000
    )
    return rows.select("row_idx", r6("l_value").alias("l_value"))


@register(
    "future_value",
    f"""WITH {EV_SQL}
        SELECT user_id, CAST(row_idx AS BIGINT) AS row_idx,
               lead(value, {SHIFT}) OVER (PARTITION BY user_id ORDER BY row_idx) AS future_value
        FROM evi""",
)
def future_value(spark, folder):
    rows = ordering.index_rows(ev(spark, folder), EV_ORDER, EV_SERIES)
    rows = recurrence.shift_ahead(rows, "value", SHIFT, "future_value", EV_SERIES)
    return rows.select("user_id", "row_idx", "future_value")


@register(
    "trend_labels",
    f"""WITH RECURSIVE {labelled_sql()}
        SELECT user_id, CAST(row_idx AS BIGINT) AS row_idx,
               {sql_r6("filtered_price")} AS filtered_price,
               {sql_r6("future_filtered_price")} AS future_filtered_price,
               {sql_r6("l_value")} AS l_value
        FROM labelled""",
)
def trend_labels(spark, folder):
    rows = labels.trend_labels(
        indexed_ev(spark, folder), "value", FILTER_LENGTH, SHIFT, EV_SERIES
    )
    return rows.select(
        "user_id",
        "row_idx",
        *[r6(c).alias(c) for c in ("filtered_price", "future_filtered_price", "l_value")],
    )


@register(
    "label_moments",
    f"""WITH {EV_SQL}
        SELECT user_id, {sql_r6("avg(value)")} AS mean, {sql_r6("stddev_pop(value)")} AS spread
        FROM evi GROUP BY user_id""",
)
def label_moments(spark, folder):
    stats = ev(spark, folder).groupBy("user_id").agg(*labels.label_statistics("value"))
    return stats.select("user_id", r6(labels.MEAN).alias("mean"), r6(labels.SPREAD).alias("spread"))


@register(
    "label_extremes",
    """WITH m AS (
         SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY event_type
       ), c AS (
         SELECT event_type, m, greatest(least(value, m + 1.5 * s), m - 1.5 * s) AS c
         FROM events JOIN m USING (event_type)
       )
       SELECT event_type,
              round(max(CASE WHEN c > m THEN c - m END), 6) + 0.0 AS up,
              round(min(CASE WHEN c < m THEN c - m END), 6) + 0.0 AS down
       FROM c GROUP BY event_type""",
)
def label_extremes(spark, folder):
    """Extremes after clipping at 1.5 spreads, from one aggregate."""
    events = read(spark, folder, "events")
    stats = events.groupBy("event_type").agg(*labels.label_statistics("value"))
    mean, reach = F.col(labels.MEAN), 1.5 * F.col(labels.SPREAD)
    return stats.select(
        "event_type",
        r6(F.least(labels.HIGH, mean + reach) - mean).alias("up"),
        r6(F.greatest(labels.LOW, mean - reach) - mean).alias("down"),
    )


NORMALIZED_SQL = f"""WITH m AS (
         SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY event_type
       ), c AS (
         SELECT event_type, event_id, m, greatest(least(value, m + 1.5 * s), m - 1.5 * s) AS c
         FROM events JOIN m USING (event_type)
       ), e AS (
         SELECT event_type, max(c - m) AS up, max(m - c) AS down FROM c GROUP BY event_type
       )
       SELECT event_id, event_type,
              {sql_r6("CASE WHEN c > m THEN (c - m) / up WHEN c < m THEN (c - m) / down ELSE 0 END")} AS label
       FROM c JOIN e USING (event_type)"""


@register("normalize_labels", NORMALIZED_SQL)
def normalize_labels(spark, folder):
    """Event types as series: each holds a large share of all rows."""
    events = read(spark, folder, "events").select("event_id", "event_type", "value")
    rows = labels.normalize_labels(
        events, "value", ["event_type"], 1.5, output="label", index_col="event_id"
    )
    return rows.select("event_id", "event_type", r6("label").alias("label"))


@register(
    "prepare_features_and_labels",
    f"""WITH RECURSIVE {PREPARED_SQL}
        SELECT user_id, CAST(row_idx AS BIGINT) AS row_idx, f1, f2, f3, {sql_r6("label")} AS label
        FROM prepared""",
)
def prepare_features(spark, folder):
    return prepared_ev(spark, folder).select(
        "user_id", "row_idx", "f1", "f2", "f3", r6("label").alias("label")
    )


@register(
    "row_index_in_levels",
    f"WITH {OR_SQL} SELECT o_orderkey, CAST(row_idx AS BIGINT) AS row_idx FROM ori",
)
def row_index_in_levels(spark, folder):
    """The index of one long series whose slices are summed in blocks of blocks."""
    rows = ordering.index_rows(orders(spark, folder), OR_ORDER, slices=30, block_slices=4)
    return rows.select("o_orderkey", "row_idx")
