"""Window, task, loss and metric queries on the prepared events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    CHUNK,
    EV_SERIES,
    INTERVAL,
    OR_SQL,
    PREPARED_SQL,
    QUERY,
    SEQ,
    SUPPORT,
    TRAIN,
    VALID,
    r6,
    register,
    sql_r6,
)
from catalog.labels import indexed_orders, processed_ev
from driftwalk.functions.columns import decay_weights
from driftwalk.operators import metrics, moments, splits, tasks, windows

SHAPE = tasks.TaskShape(SUPPORT, QUERY, INTERVAL, SEQ)
FEATURES = ["f1", "f2", "f3"]
REACH = SUPPORT + QUERY + SEQ + 1


def mean_windows(spark, folder, features=("f1",), decay=None):
    """Window means of the features with the last row's label."""
    return windows.window_means(
        processed_ev(spark, folder), list(features), "label", SEQ, series=EV_SERIES, decay=decay
    )


def samples(spark, folder, features=("f1",)):
    """Windows placed in their series, ready for task assignment."""
    rows = splits.with_splits(processed_ev(spark, folder), EV_SERIES)
    placed = ["split", "split_row", "split_rows"]
    return windows.window_means(
        rows, list(features), "label", SEQ, series=EV_SERIES, keep=placed
    )


def task_samples(spark, folder, features=("f1",)):
    return tasks.assign_tasks(samples(spark, folder, features), SHAPE)


BASE_SQL = f"""WITH RECURSIVE {PREPARED_SQL}"""

LENGTHS_SQL = "lengths AS (SELECT user_id, count(*) AS n FROM prepared GROUP BY user_id)"

TASKS_SQL = f"""{LENGTHS_SQL},
tasks AS (
  SELECT user_id, t AS task_id, t * {INTERVAL} AS s0, t * {INTERVAL} + {SUPPORT} - 1 AS s1,
         t * {INTERVAL} + {SUPPORT} AS q0, t * {INTERVAL} + {SUPPORT + QUERY} - 1 AS q1
  FROM lengths, LATERAL (
    SELECT unnest(range(CASE WHEN n < {REACH} THEN 0 ELSE (n - {REACH}) // {INTERVAL} + 1 END)) AS t
  )
)"""


def windows_sql(features=("f1",)) -> str:
    means = ", ".join(
        f"avg({f}) OVER w AS {f}" for f in features
    )
    return f"""wins AS (
  SELECT user_id, row_idx AS w0, row_idx + {SEQ - 1} AS w1, {means},
         lead(label, {SEQ - 1}) OVER (PARTITION BY user_id ORDER BY row_idx) AS label
  FROM prepared
  WINDOW w AS (PARTITION BY user_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND {SEQ - 1} FOLLOWING)
  QUALIFY lead(row_idx, {SEQ - 1}) OVER (PARTITION BY user_id ORDER BY row_idx) IS NOT NULL
),
task_samples AS (
  SELECT t.user_id, t.task_id, p.part, w.*EXCLUDE (user_id)
  FROM tasks t, LATERAL (VALUES ('support', t.s0, t.s1), ('query', t.q0, t.q1)) p(part, lo, hi)
  JOIN wins w ON w.user_id = t.user_id AND w.w0 >= p.lo AND w.w1 <= p.hi
)"""


SAMPLES_SQL = f"{BASE_SQL}, {TASKS_SQL}, {windows_sql()}"


def exploded(found):
    step = F.posexplode("features").alias("pos", "step")
    return found.select("user_id", "window_id", "window_start", "label", step).select(
        "user_id",
        "window_id",
        "window_start",
        "pos",
        F.col("step.f1").alias("f1"),
        F.col("step.f2").alias("f2"),
        r6("label").alias("label"),
    )


def stride_sql(chunk: int, stride: int, where: str = "") -> str:
    """All windows inside chunks of ``chunk`` rows (0: whole series): one frame over the
    prepared rows gathers a window, and only windows of full length start one."""
    local = f"row_idx % {chunk}" if chunk else "row_idx"
    part = f"user_id, row_idx // {chunk}" if chunk else "user_id"
    return f"""{BASE_SQL},
fixed AS MATERIALIZED (SELECT user_id, row_idx, f1, f2, label FROM prepared),
framed AS (
  SELECT user_id, row_idx, count(*) OVER w AS n, last_value(label) OVER w AS label,
         list(struct_pack(f1 := f1, f2 := f2)) OVER w AS steps
  FROM fixed
  WINDOW w AS (PARTITION BY {part} ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND {SEQ - 1} FOLLOWING)
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_idx) - 1 AS window_id
  FROM framed WHERE n = {SEQ} AND {local} % {stride} = 0
)
SELECT user_id, CAST(window_id AS BIGINT) AS window_id, CAST(row_idx AS BIGINT) AS window_start,
       CAST(pos AS INTEGER) AS pos, steps[pos + 1].f1 AS f1, steps[pos + 1].f2 AS f2, {sql_r6("label")} AS label
FROM numbered n, range({SEQ}) r(pos) {where}"""


@register("sliding_windows", stride_sql(0, 1))
def sliding_windows(spark, folder):
    found = windows.sliding_windows(
        processed_ev(spark, folder), ["f1", "f2"], "label", SEQ, 1, EV_SERIES
    )
    return exploded(found)


@register("sliding_windows_in_chunks", stride_sql(16, 2))
def sliding_windows_in_chunks(spark, folder):
    found = windows.sliding_windows(
        processed_ev(spark, folder), ["f1", "f2"], "label", SEQ, 2, EV_SERIES, chunk_rows=16
    )
    return exploded(found)


@register("window_lookup", stride_sql(16, 2, "WHERE n.window_id = 9"))
def window_lookup(spark, folder):
    found = windows.window_at(
        processed_ev(spark, folder), 9, ["f1", "f2"], "label", SEQ, 2, EV_SERIES, chunk_rows=16
    )
    return exploded(found)


@register(
    "window_labels",
    f"""{BASE_SQL}
        SELECT user_id, CAST(row_idx AS BIGINT) AS window_start, {sql_r6("ahead")} AS label
        FROM (SELECT *, lead(label, {SEQ - 1}) OVER (PARTITION BY user_id ORDER BY row_idx) AS ahead
              FROM prepared) WHERE ahead IS NOT NULL""",
)
def window_labels(spark, folder):
    return mean_windows(spark, folder).select("user_id", "window_start", r6("label").alias("label"))


DECAY_SQL = " + ".join(
    f"{w!r} * lead(f2, {k}) OVER (PARTITION BY user_id ORDER BY row_idx)"
    for k, w in enumerate(decay_weights(SEQ, 0.5))
)


@register(
    "decayed_window_means",
    f"""{BASE_SQL}
        SELECT user_id, CAST(row_idx AS BIGINT) AS window_start, {sql_r6("m")} AS decayed
        FROM (SELECT user_id, row_idx, {DECAY_SQL} AS m FROM prepared) WHERE m IS NOT NULL""",
)
def decayed_window_means(spark, folder):
    found = mean_windows(spark, folder, ["f2"], decay=0.5)
    return found.select("user_id", "window_start", r6("f2").alias("decayed"))


@register(
    "score_windows",
    f"""{BASE_SQL}, {TASKS_SQL}, {windows_sql()}
        SELECT user_id, CAST(w0 AS BIGINT) AS window_start, {sql_r6("f1")} AS prediction FROM wins""",
)
def score_windows(spark, folder):
    """A predictor (the mean of f1) applied to dense batches of windows."""
    found = windows.sliding_windows(processed_ev(spark, folder), ["f1"], "label", SEQ, 1, EV_SERIES)
    scored = windows.score_arrays(found, lambda batch: batch[:, :, 0].mean(axis=1))
    return scored.select("user_id", "window_start", r6("prediction").alias("prediction"))


@register(
    "count_windows",
    f"""{BASE_SQL}, {LENGTHS_SQL}
        SELECT user_id, CAST((n // 16) * 6 + CASE WHEN n % 16 >= {SEQ} THEN (n % 16 - {SEQ}) // 2 + 1 ELSE 0 END AS BIGINT)
               AS num_windows FROM lengths""",
)
def count_windows(spark, folder):
    return windows.count_windows(processed_ev(spark, folder), SEQ, 2, EV_SERIES, chunk_rows=16)


@register(
    "chunk_statistics",
    f"""WITH {OR_SQL}, starts AS (
          SELECT row_idx // {CHUNK} AS chunk_id, row_idx % {CHUNK} AS r,
                 count(*) OVER (PARTITION BY row_idx // {CHUNK}) AS n FROM ori)
        SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(count(*) AS BIGINT) AS num_rows,
               CAST(count(*) FILTER (WHERE r % 3 = 0 AND r + 59 < n) AS BIGINT) AS num_windows
        FROM starts GROUP BY chunk_id""",
)
def chunk_statistics(spark, folder):
    infos = splits.chunk_infos(indexed_orders(spark, folder), CHUNK)
    found = windows.chunk_statistics(infos, 60, 3)
    return found.select("chunk_id", "num_rows", "num_windows")


@register(
    "rolling_tasks",
    f"""{BASE_SQL}, {TASKS_SQL}
        SELECT user_id, CAST(task_id AS BIGINT) AS task_id, CAST(s0 AS BIGINT) AS support_start,
               CAST(s1 AS BIGINT) AS support_end, CAST(q0 AS BIGINT) AS query_start,
               CAST(q1 AS BIGINT) AS query_end FROM tasks""",
)
def rolling_tasks(spark, folder):
    bounds = splits.split_bounds(processed_ev(spark, folder), EV_SERIES)
    return tasks.rolling_tasks(bounds, SHAPE, EV_SERIES).drop("split")


OR_SHAPE = tasks.TaskShape(1200, 600, 300, 10)

OR_TASKS_SQL = f"""n AS (SELECT count(*) AS rows, ceil(count(*) / {CHUNK}) AS chunks FROM orders),
cuts AS (
  SELECT rows, CAST(floor(chunks * {TRAIN}) * {CHUNK} AS BIGINT) AS a,
         CAST((floor(chunks * {TRAIN}) + floor(chunks * {VALID})) * {CHUNK} AS BIGINT) AS b FROM n
),
bounds AS (
  SELECT 'train' AS split, 0 AS lo, a AS size FROM cuts
  UNION ALL SELECT 'valid', a, b - a FROM cuts UNION ALL SELECT 'test', b, rows - b FROM cuts
),
or_tasks AS (
  SELECT split, t AS task_id, lo + t * 300 AS s0, lo + t * 300 + 1199 AS s1,
         lo + t * 300 + 1200 AS q0, lo + t * 300 + 1799 AS q1
  FROM bounds, LATERAL (SELECT unnest(range(CASE WHEN size < 1811 THEN 0 ELSE (size - 1811) // 300 + 1 END)) AS t)
)"""


def order_tasks(spark, folder):
    bounds = splits.split_bounds(
        indexed_orders(spark, folder), ratios=(TRAIN, VALID), chunk_rows=CHUNK
    )
    return tasks.rolling_tasks(bounds, OR_SHAPE)


@register(
    "rolling_tasks_by_split",
    f"""WITH {OR_TASKS_SQL}
        SELECT split, CAST(task_id AS BIGINT) AS task_id, CAST(s0 AS BIGINT) AS support_start,
               CAST(q1 AS BIGINT) AS query_end FROM or_tasks""",
)
def rolling_tasks_by_split(spark, folder):
    return order_tasks(spark, folder).select("split", "task_id", "support_start", "query_end")


@register(
    "task_chunks",
    f"""WITH {OR_SQL}, {OR_TASKS_SQL},
        infos AS (SELECT row_idx // {CHUNK} AS chunk_id, min(row_idx) AS lo, max(row_idx) AS hi FROM ori GROUP BY 1)
        SELECT t.split, CAST(t.task_id AS BIGINT) AS task_id, p.part, CAST(i.chunk_id AS BIGINT) AS chunk_id,
               CAST(p.a - (SELECT lo FROM infos f WHERE p.a BETWEEN f.lo AND f.hi) AS BIGINT) AS start_offset,
               CAST(p.b - (SELECT lo FROM infos f WHERE p.b BETWEEN f.lo AND f.hi) AS BIGINT) AS end_offset
        FROM or_tasks t, LATERAL (VALUES ('support', t.s0, t.s1), ('query', t.q0, t.q1)) p(part, a, b)
        JOIN infos i ON i.lo <= p.b AND i.hi >= p.a""",
)
def task_chunks(spark, folder):
    """The chunks each part of a task reads, one row per chunk."""
    found = tasks.task_chunks(order_tasks(spark, folder), CHUNK)
    parts = F.array(
        *[
            F.struct(
                F.lit(part).alias("part"),
                F.col(f"{part}_chunks").alias("chunks"),
                F.col(f"{part}_start_offset").alias("start_offset"),
                F.col(f"{part}_end_offset").alias("end_offset"),
            )
            for part in ("support", "query")
        ]
    )
    long = found.select("split", "task_id", F.inline(parts))
    return long.withColumn("chunk_id", F.explode("chunks")).drop("chunks")


@register(
    "rows_in_tasks",
    f"""{BASE_SQL}, {TASKS_SQL}
        SELECT p.user_id, CAST(p.row_idx AS BIGINT) AS row_idx, CAST(t.task_id AS BIGINT) AS task_id,
               CASE WHEN p.row_idx <= t.s1 THEN 'support' ELSE 'query' END AS part
        FROM prepared p JOIN tasks t ON t.user_id = p.user_id AND p.row_idx BETWEEN t.s0 AND t.q1""",
)
def rows_in_tasks(spark, folder):
    rows = splits.with_splits(processed_ev(spark, folder), EV_SERIES)
    found = tasks.assign_tasks(rows, SHAPE, length=1)
    return found.select("user_id", "row_idx", "task_id", "part")


@register(
    "task_windows",
    f"""{SAMPLES_SQL}
        SELECT user_id, CAST(task_id AS BIGINT) AS task_id, part, CAST(w0 AS BIGINT) AS window_start,
               {sql_r6("f1")} AS f1, {sql_r6("label")} AS label FROM task_samples""",
)
def task_windows(spark, folder):
    return task_samples(spark, folder).select(
        "user_id", "task_id", "part", "window_start", r6("f1").alias("f1"), r6("label").alias("label")
    )


@register(
    "shuffled_tasks",
    f"""WITH {OR_TASKS_SQL}
        SELECT split, CAST(task_id AS BIGINT) AS task_id, CAST(s0 AS BIGINT) AS support_start,
               CAST(s1 AS BIGINT) AS support_end, CAST(q0 AS BIGINT) AS query_start, CAST(q1 AS BIGINT) AS query_end,
               row_number() OVER (ORDER BY md5(concat_ws('|', split, CAST(task_id AS BIGINT), 3, 11)), split, task_id) - 1
                 AS position
        FROM or_tasks""",
)
def shuffled_tasks(spark, folder):
    return splits.shuffled_order(order_tasks(spark, folder), ["split", "task_id"], 3, 11)


@register(
    "online_tasks",
    f"""WITH {OR_TASKS_SQL}
        SELECT CASE split WHEN 'valid' THEN 0 ELSE 1 END AS phase, split, CAST(task_id AS BIGINT) AS task_id
        FROM or_tasks WHERE split <> 'train'""",
)
def online_tasks(spark, folder):
    """Valid tasks followed by test tasks."""
    from driftwalk.sources.tables import concatenate

    found = order_tasks(spark, folder)
    phases = [
        found.filter(F.col("split") == name).select(F.lit(k).alias("phase"), "split", "task_id")
        for k, name in enumerate(("valid", "test"))
    ]
    return concatenate(phases)


SUMS = "count(*) AS n, sum(f1) AS sx, sum(label) AS sy, sum(f1 * f1) AS sxx, sum(label * label) AS syy, sum(f1 * label) AS sxy"


def loss_sql(n="n", sx="sx", sy="sy", sxx="sxx", syy="syy", sxy="sxy") -> str:
    vx = f"greatest(1e4 * {sxx} / {n} - (1e2 * {sx} / {n}) * (1e2 * {sx} / {n}), 0)"
    vy = f"greatest(1e4 * {syy} / {n} - (1e2 * {sy} / {n}) * (1e2 * {sy} / {n}), 0)"
    cov = f"(1e4 * {sxy} / {n} - (1e2 * {sx} / {n}) * (1e2 * {sy} / {n}))"
    den = f"sqrt(({vx} + 1e-8) * ({vy} + 1e-8))"
    return f"1 - CASE WHEN {den} < 1e-6 THEN 0 ELSE least(greatest({cov} / {den}, -1), 1) END"


@register(
    "correlation_loss",
    f"""{SAMPLES_SQL}, sums AS (SELECT user_id, task_id, part, {SUMS} FROM task_samples GROUP BY ALL)
        SELECT user_id, CAST(task_id AS BIGINT) AS task_id, part, CAST(n AS BIGINT) AS n,
               {sql_r6(loss_sql())} AS corr_loss FROM sums""",
)
def correlation_loss(spark, folder):
    by = ["user_id", "task_id", "part"]
    found = moments.accumulate_loss(task_samples(spark, folder), "f1", "label", by)
    return found.select(*by, "n", r6("corr_loss").alias("corr_loss"))


MOMENTS_SQL = f"""{BASE_SQL}, {TASKS_SQL}, {windows_sql(FEATURES)}
        SELECT user_id, CAST(task_id AS BIGINT) AS task_id, part, CAST(count(*) AS BIGINT) AS n,
               {sql_r6("sum(f1)", 4)} AS s_f1, {sql_r6("sum(f3)", 4)} AS s_f3, {sql_r6("sum(label)", 4)} AS s_label,
               {sql_r6("sum(f1 * f2)", 4)} AS s_f1_f2, {sql_r6("sum(f3 * label)", 4)} AS s_f3_label
        FROM task_samples GROUP BY ALL"""


@register("task_moments", MOMENTS_SQL)
def task_moments(spark, folder, wide=moments.WIDE):
    rows = samples(spark, folder, FEATURES)
    found = moments.task_moments(rows, FEATURES, "label", SHAPE, EV_SERIES, wide)
    return found.select(
        "user_id",
        "task_id",
        "part",
        "n",
        r6(F.col("sums")[0], 4).alias("s_f1"),
        r6(F.col("sums")[2], 4).alias("s_f3"),
        r6(F.col("sums")[3], 4).alias("s_label"),
        r6(F.col("products")[1], 4).alias("s_f1_f2"),
        r6(F.col("products")[8], 4).alias("s_f3_label"),
    )


@register("task_moments_as_matrices", MOMENTS_SQL)
def task_moments_as_matrices(spark, folder):
    """The path for many features: matrix products per batch."""
    return task_moments(spark, folder, wide=0)


# Metric queries: prediction is the window mean of f1, target its label.

QUERY_SQL = f"{SAMPLES_SQL}, q AS (SELECT user_id, task_id, f1 AS p, label AS t FROM task_samples WHERE part = 'query')"

REGRESSION_SQL = {
    "concordance": "2 * covar_samp(100 * p, 100 * t) / (var_samp(100 * p) + var_samp(100 * t) + pow(avg(100 * p) - avg(100 * t), 2))",
    "mse": "-avg(pow(p - t, 2))",
    "mae": "-avg(abs(p - t))",
    "r2": "1 - sum(pow(t - p, 2)) / nullif(var_pop(t) * count(*), 0)",
    "rmse": "-sqrt(avg(pow(p - t, 2)))",
    "mape": "-avg(abs(p - t) / greatest(abs(t), 1.17e-6))",
    "smape": "-avg(2 * abs(p - t) / greatest(abs(p) + abs(t), 1.17e-6))",
    "explained_variance": "1 - var_pop(t - p) / nullif(var_pop(t), 0)",
    "pearson": "corr(p, t)",
}


def regression_query(name):
    def query(spark, folder):
        rows = task_samples(spark, folder).filter("part = 'query'")
        found = metrics.regression_metrics(
            rows, "f1", "label", ["user_id", "task_id"], [name], bounded=True
        )
        return found.select("user_id", "task_id", r6(name, digits(name)).alias(name))

    return query


def digits(name):
    """Errors relative to near-zero labels are large; compare fewer digits."""
    return 2 if name in ("mape", "r2", "explained_variance", "mse") else 6


for metric, expression in REGRESSION_SQL.items():
    register(
        f"metric_{metric}",
        f"""{QUERY_SQL} SELECT user_id, CAST(task_id AS BIGINT) AS task_id,
            {sql_r6(expression, digits(metric))} AS {metric} FROM q GROUP BY ALL""",
    )(regression_query(metric))

RANKS_SQL = """ranked AS (
  SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0 AS rp,
         rank() OVER (PARTITION BY {by} ORDER BY t) + (count(*) OVER (PARTITION BY {by}, t) - 1) / 2.0 AS rt
  FROM {source}
)"""

register(
    "metric_spearman",
    f"""{QUERY_SQL}, {RANKS_SQL.format(by="user_id, task_id", source="q")}
        SELECT user_id, CAST(task_id AS BIGINT) AS task_id, {sql_r6("corr(rp, rt)")} AS spearman
        FROM ranked GROUP BY ALL""",
)(regression_query("spearman"))


@register(
    "metric_spearman_large_groups",
    f"""WITH e AS (SELECT event_type, value AS p, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS t FROM events),
        {RANKS_SQL.format(by="event_type", source="e")}
        SELECT event_type, {sql_r6("corr(rp, rt)")} AS spearman FROM ranked GROUP BY event_type""",
)
def metric_spearman_large_groups(spark, folder):
    from catalog.base import read

    rows = read(spark, folder, "events").select(
        "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    found = metrics.regression_metrics(rows, "value", "k", ["event_type"], ["spearman"])
    return found.select("event_type", r6("spearman").alias("spearman"))


HEAVY_SQL = """SELECT event_type, CAST(CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id END AS DOUBLE) AS p,
  (event_id * 7919) % 100003 + value AS t FROM events"""


@register(
    "metric_spearman_heavy_value",
    f"""WITH e AS ({HEAVY_SQL}), {RANKS_SQL.format(by="event_type", source="e")}
        SELECT event_type, {sql_r6("corr(rp, rt)")} AS spearman FROM ranked GROUP BY event_type""",
)
def metric_spearman_heavy_value(spark, folder):
    """One prediction of every type stands in half of the type's distinct pairs."""
    from catalog.base import read

    read(spark, folder, "events").createOrReplaceTempView("events")
    rows = spark.sql(HEAVY_SQL)
    found = metrics.regression_metrics(rows, "p", "t", ["event_type"], ["spearman"], piece_rows=200)
    return found.select("event_type", r6("spearman").alias("spearman"))


HOT_SQL = """SELECT event_type, CASE WHEN event_id % 4 = 0 THEN value ELSE 0 END AS p,
  CASE WHEN event_id % 4 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) ELSE 0 END AS t FROM events"""


@register(
    "metric_spearman_hot_pair",
    f"""WITH e AS ({HOT_SQL}), {RANKS_SQL.format(by="event_type", source="e")}
        SELECT event_type, {sql_r6("corr(rp, rt)")} AS spearman FROM ranked GROUP BY event_type""",
)
def metric_spearman_hot_pair(spark, folder):
    """Three of four rows are the same pair (0, 0)."""
    from catalog.base import read

    quarter = F.col("event_id") % 4 == 0
    k = F.get_json_object("props", "$.k").cast("double")
    rows = read(spark, folder, "events").select(
        "event_type",
        F.when(quarter, F.col("value")).otherwise(F.lit(0.0)).alias("p"),
        F.when(quarter, k).otherwise(F.lit(0.0)).alias("t"),
    )
    found = metrics.regression_metrics(rows, "p", "t", ["event_type"], ["spearman"])
    return found.select("event_type", r6("spearman").alias("spearman"))


def task_metric(spark, folder):
    """Mean absolute error of each task: a short metric history per user."""
    rows = task_samples(spark, folder).filter("part = 'query'")
    return metrics.regression_metrics(rows, "f1", "label", ["user_id", "task_id"], ["mae"])


HISTORY_SQL = f"{QUERY_SQL}, history AS (SELECT user_id, task_id, -avg(abs(p - t)) AS mae FROM q GROUP BY ALL)"


@register(
    "metric_summary",
    f"""{HISTORY_SQL} SELECT user_id, {sql_r6("avg(mae)")} AS mean, {sql_r6("stddev_pop(mae)")} AS spread
        FROM history GROUP BY user_id""",
)
def metric_summary(spark, folder):
    found = metrics.metric_summary(task_metric(spark, folder), "mae", ["user_id"])
    return found.select("user_id", r6("mean").alias("mean"), r6("spread").alias("spread"))


@register(
    "running_metric_mean",
    f"""{HISTORY_SQL} SELECT user_id, CAST(task_id AS BIGINT) AS task_id,
        {sql_r6("avg(mae) OVER (PARTITION BY user_id ORDER BY task_id)")} AS running_mean FROM history""",
)
def running_metric_mean(spark, folder):
    found = metrics.running_mean(task_metric(spark, folder), "mae", ["user_id"], ["task_id"])
    return found.select("user_id", "task_id", r6("running_mean").alias("running_mean"))


@register(
    "early_stopping",
    """WITH RECURSIVE days AS (
         SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) AS e,
                round(avg(value), 4) AS v
         FROM events GROUP BY event_type, CAST(ts AS DATE)
       ), run AS (
         SELECT event_type, e, v AS best, e AS best_epoch, 3 AS patience FROM days WHERE e = 1
         UNION ALL
         SELECT r.event_type, d.e, CASE WHEN d.v > r.best THEN d.v ELSE r.best END,
                CASE WHEN d.v > r.best THEN d.e ELSE r.best_epoch END,
                CASE WHEN d.v > r.best THEN 3 ELSE r.patience - 1 END
         FROM run r JOIN days d ON d.event_type = r.event_type AND d.e = r.e + 1
         WHERE r.patience > 0
       )
       SELECT event_type, CAST(max_by(best_epoch, e) AS INTEGER) AS best_epoch, max_by(best, e) AS best_value,
              CAST(max(CASE WHEN patience = 0 THEN e END) AS INTEGER) AS stop_epoch
       FROM run GROUP BY event_type""",
)
def early_stopping(spark, folder):
    """Daily mean value per event type as a metric history, patience 3."""
    from pyspark.sql import Window

    from catalog.base import read

    days = (
        read(spark, folder, "events")
        .groupBy("event_type", F.to_date("ts").alias("day"))
        .agg(F.round(F.avg("value"), 4).alias("value"))
    )
    # One row per day: the history of a run is as short as its number of days.
    number = F.row_number().over(Window.partitionBy("event_type").orderBy("day"))
    history = days.select("event_type", number.alias("epoch"), "value")
    return metrics.early_stop(history, "epoch", "value", 3, ["event_type"])
