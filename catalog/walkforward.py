"""Walk-forward fits on the moments of rolling tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    CHUNK,
    EV_ORDER,
    EV_SERIES,
    FILTER_LENGTH,
    OR_ORDER,
    OR_SQL,
    SHIFT,
    TRAIN,
    VALID,
    ev,
    orders,
    r6,
    register,
    sql_r6,
)
from catalog.labels import LONG_FILTER_SQL
from catalog.tasks import (
    BASE_SQL,
    OR_SHAPE,
    SHAPE,
    TASKS_SQL,
    loss_sql,
    samples,
    windows_sql,
)
from driftwalk.operators import metrics, moments, splits, tasks, windows
from driftwalk.plans import walkforward
from driftwalk.plans.prepare import prepare_features_and_labels
from driftwalk.plans.run import walk_forward_run
from driftwalk.staging import new_path, stage

KEYS = ["user_id", "split", "task_id"]
PAIR = ["f1", "f2"]


def ev_moments(spark, folder, features):
    found = moments.task_moments(samples(spark, folder, features), features, "label", SHAPE, EV_SERIES)
    return stage(found, "moments")


SAMPLES_SQL = f"{BASE_SQL}, {TASKS_SQL}, {windows_sql()}"

FITS_SQL = """fits AS (
  SELECT user_id, task_id, regr_slope(label, f1) AS slope, regr_intercept(label, f1) AS intercept
  FROM task_samples WHERE part = 'support' GROUP BY ALL
)"""


@register(
    "fit_tasks",
    f"""{SAMPLES_SQL}, {FITS_SQL}
        SELECT f.user_id, CAST(f.task_id AS BIGINT) AS task_id, {sql_r6("any_value(slope)")} AS slope,
               {sql_r6("any_value(intercept)")} AS intercept,
               {sql_r6("-avg(pow(slope * f1 + intercept - label, 2))")} AS mse,
               {sql_r6("corr(slope * f1 + intercept, label)")} AS pearson
        FROM fits f JOIN task_samples s ON s.user_id = f.user_id AND s.task_id = f.task_id
        WHERE part = 'query' GROUP BY ALL""",
)
def fit_tasks(spark, folder):
    found = walkforward.fit_and_score(ev_moments(spark, folder, ["f1"]), EV_SERIES)
    return found.select(
        "user_id",
        "task_id",
        r6(F.col("coefficients")[0]).alias("slope"),
        r6(F.col("coefficients")[1]).alias("intercept"),
        r6("mse").alias("mse"),
        r6("pearson").alias("pearson"),
    )


@register(
    "predict_queries",
    f"""{SAMPLES_SQL}, {FITS_SQL}
        SELECT s.user_id, CAST(s.task_id AS BIGINT) AS task_id, CAST(w0 AS BIGINT) AS window_start,
               {sql_r6("slope * f1 + intercept")} AS prediction, {sql_r6("label")} AS label
        FROM task_samples s JOIN fits f ON s.user_id = f.user_id AND s.task_id = f.task_id WHERE part = 'query'""",
)
def predict_queries(spark, folder):
    rows = stage(samples(spark, folder, ["f1"]), "samples")
    found = moments.task_moments(rows, ["f1"], "label", SHAPE, EV_SERIES)
    fits = walkforward.fit_and_score(found, EV_SERIES)
    placed = tasks.assign_tasks(rows, SHAPE)
    scored = walkforward.predict_queries(placed, ["f1"], fits, KEYS)
    return scored.select(
        "user_id", "task_id", "window_start", r6("prediction").alias("prediction"), r6("label").alias("label")
    )


def scaled_moments(spark, folder, wide):
    """Moments of f1 far above its spread and f2 far below one, with gaps in both."""
    rows = samples(spark, folder, PAIR)
    far = rows.withColumns(
        {
            "f1": F.when(F.col("window_start") % 7 != 3, F.col("f1") * 1e3 + 1e9),
            "f2": F.when(F.col("window_start") % 5 != 2, F.col("f2") * 1e-6),
        }
    )
    found = moments.task_moments(far, PAIR, "label", SHAPE, EV_SERIES, wide)
    return stage(found, "moments")


PAIR_SQL = f"{BASE_SQL}, {TASKS_SQL}, {windows_sql(PAIR)}"


def pair_stats(source: str, where: str, name: str, keys: str = "") -> str:
    """Means and covariances of f1, f2 and the label."""
    chosen = f"{keys}, " if keys else ""
    grouped = "GROUP BY ALL" if keys else ""
    return f"""{name} AS (
  SELECT {chosen}count(*) AS n, avg(f1) AS m1, avg(f2) AS m2, avg(label) AS my,
         var_pop(f1) AS s11, var_pop(f2) AS s22, covar_pop(f1, f2) AS s12,
         covar_pop(f1, label) AS c1, covar_pop(f2, label) AS c2, var_pop(label) AS u
  FROM {source} WHERE {where} {grouped}
)"""


SCALED_SQL = f"""{PAIR_SQL},
{pair_stats("task_samples", "part = 'support' AND w0 % 7 <> 3 AND w0 % 5 <> 2", "sup", "user_id, task_id")}
SELECT user_id, CAST(task_id AS BIGINT) AS task_id, CAST(n AS BIGINT) AS n,
       {sql_r6("(c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12)", 5)} AS w1,
       {sql_r6("(c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12)", 5)} AS w2
FROM sup"""


@register("fit_tasks_scales", SCALED_SQL)
def fit_tasks_scales(spark, folder, wide=16):
    """Weights in the units of the plain features, which the oracle fits."""
    found = scaled_moments(spark, folder, wide)
    counts = found.filter("part = 'support'").select(*KEYS, "n")
    fits = walkforward.fit_and_score(found, EV_SERIES).join(counts, KEYS)
    return fits.select(
        "user_id",
        "task_id",
        "n",
        r6(F.col("coefficients")[0] * 1e3, 5).alias("w1"),
        r6(F.col("coefficients")[1] * 1e-6, 5).alias("w2"),
    )


@register("fit_tasks_scales_as_matrices", SCALED_SQL)
def fit_tasks_scales_as_matrices(spark, folder):
    return fit_tasks_scales(spark, folder, wide=0)


BASE_FIT_SQL = f"""{pair_stats("task_samples", "part = 'query'", "whole")},
base AS (
  SELECT (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS w1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS w2,
         my - m1 * (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) - m2 * (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b
  FROM whole
)"""


@register(
    "base_coefficients",
    f"""{PAIR_SQL}, {BASE_FIT_SQL} SELECT {sql_r6("w1", 8)} AS w1, {sql_r6("w2", 8)} AS w2, {sql_r6("b", 8)} AS b FROM base""",
)
def base_coefficients(spark, folder):
    found = walkforward.base_coefficients(ev_moments(spark, folder, PAIR), 3, split=None)
    return found.select(*[r6(F.col("base")[i], 8).alias(n) for i, n in enumerate(("w1", "w2", "b"))])


RATE = 0.01
V = "(w1 * w1 * s11 + 2 * w1 * w2 * s12 + w2 * w2 * s22)"
ALONG = "(w1 * c1 + w2 * c2)"

STEP_SQL = f"""{BASE_FIT_SQL}, {pair_stats("task_samples", "part = 'support'", "sup", "user_id, task_id")},
stepped AS (
  SELECT user_id, task_id, w1, w2, b, m1, m2, my,
         w1 - {RATE} * ({ALONG} * (s11 * w1 + s12 * w2) / (pow({V}, 1.5) * sqrt(u)) - c1 / sqrt({V} * u)) AS a1,
         w2 - {RATE} * ({ALONG} * (s12 * w1 + s22 * w2) / (pow({V}, 1.5) * sqrt(u)) - c2 / sqrt({V} * u)) AS a2
  FROM sup, base
)"""


@register(
    "gradient_step",
    f"""{PAIR_SQL}, {STEP_SQL}
        SELECT user_id, CAST(task_id AS BIGINT) AS task_id, {sql_r6("a1")} AS w1, {sql_r6("a2")} AS w2,
               {sql_r6("my - a1 * m1 - a2 * m2", 5)} AS b FROM stepped""",
)
def gradient_step(spark, folder):
    found = ev_moments(spark, folder, PAIR)
    base = walkforward.base_coefficients(found, 3, split=None)
    scored = walkforward.adapt_and_score(found, base, RATE, EV_SERIES)
    return scored.select(
        "user_id",
        "task_id",
        r6(F.col("coefficients")[0]).alias("w1"),
        r6(F.col("coefficients")[1]).alias("w2"),
        r6(F.col("coefficients")[2], 5).alias("b"),
    )


@register(
    "loss_before_and_after",
    f"""{PAIR_SQL}, {STEP_SQL},
        forecasts AS (
          SELECT user_id, task_id, label, stepped.w1 * f1 + w2 * f2 + b AS o, a1 * f1 + a2 * f2 AS p
          FROM task_samples JOIN stepped USING (user_id, task_id) WHERE part = 'query'
        ), sums AS (
          SELECT user_id, task_id, count(*) AS n, sum(label) AS sy, sum(label * label) AS syy, sum(o) AS ox,
                 sum(o * o) AS oxx, sum(o * label) AS oxy, sum(p) AS sx, sum(p * p) AS sxx, sum(p * label) AS sxy
          FROM forecasts GROUP BY ALL
        )
        SELECT user_id, CAST(task_id AS BIGINT) AS task_id, {sql_r6(loss_sql(sx="ox", sxx="oxx", sxy="oxy"), 5)} AS corr_loss_before,
               {sql_r6(loss_sql(), 5)} AS corr_loss FROM sums""",
)
def loss_before_and_after(spark, folder):
    found = ev_moments(spark, folder, PAIR)
    base = walkforward.base_coefficients(found, 3, split=None)
    scored = walkforward.adapt_and_score(found, base, RATE, EV_SERIES)
    return scored.select(
        "user_id", "task_id", *[r6(c, 5).alias(c) for c in ("corr_loss_before", "corr_loss")]
    )


KEEP = 0.5


@register(
    "online_pass",
    f"""{SAMPLES_SQL}, parts AS (
      SELECT user_id, task_id, part, count(*) AS n, sum(f1) AS sx, sum(label) AS sy, sum(f1 * f1) AS sxx, sum(f1 * label) AS sxy
      FROM task_samples GROUP BY ALL
    ), weighted AS (
      SELECT s.user_id, s.task_id, p.n * k AS n, p.sx * k AS sx, p.sy * k AS sy, p.sxx * k AS sxx, p.sxy * k AS sxy
      FROM parts s JOIN parts p ON p.user_id = s.user_id AND s.part = 'support'
       AND ((p.part = 'support' AND p.task_id = s.task_id) OR (p.part = 'query' AND p.task_id < s.task_id)),
      LATERAL (SELECT CASE p.part WHEN 'support' THEN 1 ELSE pow({KEEP}, s.task_id - 1 - p.task_id) END AS k)
    ), states AS (
      SELECT user_id, task_id, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy
      FROM weighted GROUP BY ALL
    ), fits AS (
      SELECT user_id, task_id, (sxy / n - sx / n * sy / n) / (sxx / n - sx / n * sx / n) AS slope, sx / n AS mx, sy / n AS my
      FROM states
    )
    SELECT f.user_id, CAST(f.task_id AS BIGINT) AS task_id, {sql_r6("any_value(slope)")} AS slope,
           {sql_r6("-avg(pow(slope * (f1 - mx) + my - label, 2))")} AS mse
    FROM fits f JOIN task_samples s ON s.user_id = f.user_id AND s.task_id = f.task_id
    WHERE part = 'query' GROUP BY ALL""",
)
def online_pass(spark, folder):
    found = walkforward.online_pass(
        ev_moments(spark, folder, ["f1"]), 2, KEEP, EV_SERIES, phases=["all"]
    )
    return found.select(
        "user_id", "task_id", r6(F.col("coefficients")[0]).alias("slope"), r6("mse").alias("mse")
    )


def order_moments(spark, folder):
    """One long series split by chunks: moments of its tasks."""
    rows = orders(spark, folder).withColumn("f1", F.col("o_totalprice") / 1e5)
    table, _, label = prepare_features_and_labels(
        rows,
        OR_ORDER,
        price="o_totalprice",
        features=["f1"],
        filter_length=FILTER_LENGTH,
        shift_length=SHIFT,
        part_rows=4096,
    )
    table = stage(table.withColumnRenamed(label, "label"), "processed")
    placed = splits.with_splits(table, ratios=(TRAIN, VALID), chunk_rows=CHUNK)
    # Windows stay inside chunks, hence inside their split.
    means = windows.window_means(
        placed, ["f1"], "label", SEQ_LONG, chunk_rows=CHUNK, keep=["split", "split_row", "split_rows"]
    )
    return stage(moments.task_moments(means, ["f1"], "label", OR_SHAPE), "moments")


SEQ_LONG = OR_SHAPE.seq_length

OR_SAMPLES_SQL = f"""WITH {OR_SQL}, {LONG_FILTER_SQL},
raw AS (
  SELECT i AS row_idx, x / 1e5 AS f1, (lead(fp, {SHIFT}) OVER (ORDER BY i) - x) / x AS l FROM long_filtered
),
kept AS (SELECT * FROM raw WHERE l IS NOT NULL),
stat AS (SELECT avg(l) AS m, stddev_pop(l) AS s FROM kept),
clipped AS (SELECT row_idx, f1, m, greatest(least(l, m + 5 * s), m - 5 * s) AS c FROM kept, stat),
ext AS (SELECT max(c - m) AS up, max(m - c) AS down FROM clipped),
prepared AS (
  SELECT row_idx, f1, CASE WHEN c > m THEN (c - m) / up WHEN c < m THEN (c - m) / down ELSE 0 END AS label FROM clipped, ext
),
n AS (SELECT count(*) AS rows, ceil(count(*) / {CHUNK}) AS chunks FROM prepared),
cuts AS (
  SELECT rows, CAST(floor(chunks * {TRAIN}) * {CHUNK} AS BIGINT) AS a,
         CAST((floor(chunks * {TRAIN}) + floor(chunks * {VALID})) * {CHUNK} AS BIGINT) AS b FROM n
),
bounds AS (
  SELECT 'train' AS split, 0 AS lo, a AS size FROM cuts
  UNION ALL SELECT 'valid', a, b - a FROM cuts UNION ALL SELECT 'test', b, rows - b FROM cuts
),
or_tasks AS (
  SELECT split, t AS task_id, lo + t * 300 AS s0
  FROM bounds, LATERAL (SELECT unnest(range(CASE WHEN size < 1811 THEN 0 ELSE (size - 1811) // 300 + 1 END)) AS t)
),
wins AS (
  SELECT row_idx AS w0, avg(f1) OVER w AS f1, lead(label, 9) OVER (PARTITION BY row_idx // {CHUNK} ORDER BY row_idx) AS label
  FROM prepared WINDOW w AS (PARTITION BY row_idx // {CHUNK} ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)
),
task_samples AS (
  SELECT t.split, t.task_id, p.part, w.f1, w.label
  FROM or_tasks t, LATERAL (VALUES ('support', s0, s0 + 1199), ('query', s0 + 1200, s0 + 1799)) p(part, lo, hi)
  JOIN wins w ON w.w0 >= p.lo AND w.w0 + 9 <= p.hi AND w.label IS NOT NULL
)"""

OR_FITS_SQL = f"""{OR_SAMPLES_SQL}, fits AS (
  SELECT split, task_id, regr_slope(label, f1) AS slope, regr_intercept(label, f1) AS intercept
  FROM task_samples WHERE part = 'support' GROUP BY ALL
), task_scores AS (
  SELECT f.split, f.task_id, any_value(slope) AS slope, -avg(pow(slope * f1 + intercept - label, 2)) AS mse
  FROM fits f JOIN task_samples s ON s.split = f.split AND s.task_id = f.task_id WHERE part = 'query' GROUP BY ALL
)"""


@register(
    "fit_tasks_long",
    f"""{OR_FITS_SQL} SELECT split, CAST(task_id AS BIGINT) AS task_id, {sql_r6("slope")} AS slope, {sql_r6("mse")} AS mse
        FROM task_scores""",
)
def fit_tasks_long(spark, folder):
    found = walkforward.fit_and_score(order_moments(spark, folder))
    return found.select(
        "split", "task_id", r6(F.col("coefficients")[0]).alias("slope"), r6("mse").alias("mse")
    )


@register(
    "metric_by_split",
    f"""{OR_FITS_SQL} SELECT split, {sql_r6("avg(mse)")} AS mean, {sql_r6("stddev_pop(mse)")} AS spread
        FROM task_scores GROUP BY split""",
)
def metric_by_split(spark, folder):
    scored = walkforward.fit_and_score(order_moments(spark, folder))
    found = metrics.metric_summary(scored, "mse", ["split"])
    return found.select("split", r6("mean").alias("mean"), r6("spread").alias("spread"))


@register(
    "online_pass_long",
    f"""{OR_SAMPLES_SQL}, parts AS (
      SELECT split, task_id, part, count(*) AS n, sum(f1) AS sx, sum(label) AS sy, sum(f1 * f1) AS sxx, sum(f1 * label) AS sxy
      FROM task_samples GROUP BY ALL
    ), prior AS (
      SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy
      FROM parts WHERE split = 'train' AND part = 'query'
    ), steps AS (
      SELECT split, task_id, row_number() OVER (ORDER BY split = 'test', task_id) - 1 AS step
      FROM (SELECT DISTINCT split, task_id FROM parts WHERE split <> 'train')
    ), gathered AS (
      SELECT s.split, s.task_id, CASE WHEN p.part = 'support' THEN 1 ELSE pow(0.9, s.step - 1 - o.step) END AS k,
             p.n, p.sx, p.sy, p.sxx, p.sxy
      FROM steps s JOIN steps o ON o.step <= s.step JOIN parts p ON p.split = o.split AND p.task_id = o.task_id
      WHERE (p.part = 'support' AND o.step = s.step) OR (p.part = 'query' AND o.step < s.step)
      UNION ALL SELECT s.split, s.task_id, pow(0.9, s.step), p.* FROM steps s, prior p
    ), states AS (
      SELECT split, task_id, sum(k * n) AS n, sum(k * sx) AS sx, sum(k * sy) AS sy, sum(k * sxx) AS sxx, sum(k * sxy) AS sxy
      FROM gathered GROUP BY ALL
    ), fits AS (
      SELECT split, task_id, (sxy / n - sx / n * sy / n) / (sxx / n - sx / n * sx / n) AS slope, sx / n AS mx, sy / n AS my
      FROM states
    )
    SELECT f.split, CAST(f.task_id AS BIGINT) AS task_id, {sql_r6("any_value(slope)")} AS slope,
           {sql_r6("-avg(pow(slope * (f1 - mx) + my - label, 2))")} AS mse
    FROM fits f JOIN task_samples s ON s.split = f.split AND s.task_id = f.task_id
    WHERE part = 'query' GROUP BY f.split, f.task_id""",
)
def online_pass_long(spark, folder):
    """Valid then test tasks of one long series, starting from the train tasks."""
    found = order_moments(spark, folder)
    train = found.filter("split = 'train' AND part = 'query'")
    prior = walkforward.merge_moments(train, 2)
    scored = walkforward.online_pass(found, 2, 0.9, prior=prior)
    return scored.select(
        "split", "task_id", r6(F.col("coefficients")[0]).alias("slope"), r6("mse").alias("mse")
    )


def summarised(run):
    return run.summary.select("split", r6("mean").alias("mean"), r6("spread").alias("spread"))


def with_scaled(sql: str, params: str, window: str) -> str:
    """``sql`` with its windows laid over features scaled as ``params`` say."""
    before, _, after = sql.partition("wins AS (")
    return f"{before}{params},\nwins AS ({after.replace(window, window.replace('prepared', 'scaled'), 1)}"


OR_SCALED_SQL = with_scaled(
    OR_FITS_SQL,
    f"""params AS (
  SELECT median(f1) AS m, mad(f1) * 1.4826 AS d FROM prepared, n WHERE row_idx < floor(rows * {TRAIN})
),
scaled AS (
  SELECT row_idx, label, least(greatest((f1 - params.m) / (d + 1e-8), -3.0), 3.0) AS f1 FROM prepared, params
)""",
    "FROM prepared WINDOW",
)


@register(
    "run_orders",
    f"""{OR_SCALED_SQL} SELECT split, {sql_r6("avg(mse)")} AS mean, {sql_r6("stddev_pop(mse)")} AS spread
        FROM task_scores GROUP BY split""",
)
def run_orders(spark, folder):
    """The whole run over one long series, split by chunks."""
    rows = orders(spark, folder).withColumn("f1", F.col("o_totalprice") / 1e5)
    return summarised(
        walk_forward_run(
            rows,
            OR_ORDER,
            "o_totalprice",
            ["f1"],
            OR_SHAPE,
            new_path(spark, "run"),
            ratios=(TRAIN, VALID),
            chunk_rows=CHUNK,
            filter_length=FILTER_LENGTH,
            shift_length=SHIFT,
            part_rows=4096,
        )
    )


EV_SCALED_SQL = with_scaled(
    f"{SAMPLES_SQL}, {FITS_SQL}",
    """params AS (
  SELECT user_id, median(f1) AS m, mad(f1) * 1.4826 AS d FROM prepared GROUP BY user_id
),
scaled AS (
  SELECT user_id, row_idx, label, least(greatest((f1 - m) / (d + 1e-8), -3.0), 3.0) AS f1
  FROM prepared JOIN params USING (user_id)
)""",
    "FROM prepared\n  WINDOW",
)


@register(
    "run_events",
    f"""{EV_SCALED_SQL}, task_scores AS (
          SELECT f.user_id, f.task_id, -avg(pow(slope * f1 + intercept - label, 2)) AS mse
          FROM fits f JOIN task_samples s ON s.user_id = f.user_id AND s.task_id = f.task_id
          WHERE part = 'query' GROUP BY ALL
        )
        SELECT 'all' AS split, {sql_r6("avg(mse)")} AS mean, {sql_r6("stddev_pop(mse)")} AS spread FROM task_scores""",
)
def run_events(spark, folder):
    """The whole run over many short series, each scaled by itself."""
    return summarised(
        walk_forward_run(
            ev(spark, folder).drop("f2", "f3"),
            EV_ORDER,
            "value",
            ["f1"],
            SHAPE,
            new_path(spark, "run"),
            series=EV_SERIES,
            ratios=None,
            filter_length=FILTER_LENGTH,
            shift_length=SHIFT,
        )
    )
