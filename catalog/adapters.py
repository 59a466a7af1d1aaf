"""Adapter, normalisation and classification queries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from catalog.base import EV_SERIES, SEQ, TEMPERATURE, r6, read, register, sql_r6
from catalog.labels import processed_ev
from catalog.tasks import (
    BASE_SQL,
    FEATURES,
    SHAPE,
    TASKS_SQL,
    loss_sql,
    windows_sql,
)
from driftwalk.functions.columns import decay_weights
from driftwalk.operators import adapters, metrics, moments, normalise, splits, tasks, windows

WIDTH, HIDDEN = 64, 4

# Fixed matrices by rule, the same in SQL.


def projection_rule(i, j):
    return math.cos(0.5 * i + 0.1 * j)


def weight_rule(h, i, j):
    return 0.1 * math.sin(h + 2 * i + 3 * j)


def proto_rule(h, f):
    return math.sin(1 + 3 * h + f)


def embeddings(spark, folder, width=WIDTH):
    vector = F.transform(F.slice("embedding", 1, width), lambda v: v.cast("double"))
    return read(spark, folder, "embeddings").select("vec_id", "label", vector.alias("x"))


def label_gate(rows, width=WIDTH, projection=None):
    """Prototypes: the mean vector of each label, in the projected space if any."""
    means = adapters.centroids(rows, "x", "label", width)
    if projection is not None:
        means = means @ projection.T
    return adapters.Gate(means, TEMPERATURE, projection)


def label_adapter(gate):
    heads = np.arange(len(gate.prototypes))
    return adapters.LabelAdapter(gate, 0.8 + 0.04 * heads, np.full(len(heads), 0.125))


def feature_adapter(gate):
    heads = len(gate.prototypes)
    weights = [
        [[weight_rule(h, i, j) for j in range(WIDTH)] for i in range(WIDTH)] for h in range(heads)
    ]
    biases = [[0.01 * (h + i) for i in range(WIDTH)] for h in range(heads)]
    return adapters.FeatureAdapter(gate, np.array(weights), np.array(biases))


def vectors_sql(width=WIDTH) -> str:
    return f"""em AS (
  SELECT vec_id, label, CAST(embedding[1:{width}] AS DOUBLE[]) AS x FROM embeddings
),
cells AS (SELECT label, unnest(range({width})) AS pos, unnest(x) AS v FROM em),
protos AS (
  SELECT label, row_number() OVER (ORDER BY label) - 1 AS head, list(m ORDER BY pos) AS p
  FROM (SELECT label, pos, avg(v) AS m FROM cells GROUP BY label, pos) GROUP BY label
)"""


def gates_sql(width=WIDTH) -> str:
    return f"""{vectors_sql(width)},
sims AS (
  SELECT e.vec_id, e.label AS y, e.x, p.head, list_cosine_similarity(e.x, p.p) AS s FROM em e CROSS JOIN protos p
),
gates AS (
  SELECT vec_id, y, x, head, exp(s / {TEMPERATURE}) / sum(exp(s / {TEMPERATURE})) OVER (PARTITION BY vec_id) AS g
  FROM sims
)"""


GATE_COLUMNS = f"""SELECT vec_id, CAST(head AS INTEGER) AS head, {sql_r6("g")} AS gate FROM gates"""


def long_gates(rows, gate):
    found = rows.select("vec_id", F.posexplode(adapters.gate_column("x", gate)).alias("head", "gate"))
    return found.select("vec_id", "head", r6("gate").alias("gate"))


@register("cosine_gate", f"WITH {gates_sql()} {GATE_COLUMNS}")
def cosine_gate(spark, folder):
    rows = embeddings(spark, folder)
    return long_gates(rows, label_gate(rows))


def projected_sql(value: str) -> str:
    rows = [
        "list_dot_product({v}, [{w}]::DOUBLE[])".format(
            v=value, w=", ".join(repr(projection_rule(i, j)) for j in range(WIDTH))
        )
        for i in range(HIDDEN)
    ]
    return "[" + ", ".join(rows) + "]"


@register(
    "projected_gate",
    f"""WITH {vectors_sql()},
    low AS (SELECT vec_id, {projected_sql("x")} AS v FROM em),
    low_protos AS (SELECT head, {projected_sql("p")} AS p FROM protos),
    sims AS (SELECT vec_id, head, list_cosine_similarity(v, p) AS s FROM low CROSS JOIN low_protos),
    gates AS (
      SELECT vec_id, head, exp(s / {TEMPERATURE}) / sum(exp(s / {TEMPERATURE})) OVER (PARTITION BY vec_id) AS g FROM sims
    ) {GATE_COLUMNS}""",
)
def projected_gate(spark, folder):
    rows = embeddings(spark, folder)
    projection = np.array([[projection_rule(i, j) for j in range(WIDTH)] for i in range(HIDDEN)])
    return long_gates(rows, label_gate(rows, projection=projection))


HEADS = 4
WINDOW_GATE = adapters.Gate(
    np.array([[proto_rule(h, f) for f in range(3)] for h in range(HEADS)]), TEMPERATURE
)

STEP_PROTOS_SQL = "step_protos(head, p) AS (VALUES " + ", ".join(
    f"({h}, [{', '.join(repr(proto_rule(h, f)) for f in range(3))}]::DOUBLE[])" for h in range(HEADS)
) + ")"

DECAY_LIST = "[" + ", ".join(map(repr, decay_weights(SEQ, 0.5))) + "]"


def vector_windows(spark, folder):
    found = windows.sliding_windows(
        processed_ev(spark, folder), FEATURES, "label", SEQ, 1, EV_SERIES
    )
    steps = F.transform("features", lambda s: F.array(*[s[f] for f in FEATURES]))
    return found.withColumn("x", steps)


@register(
    "window_gate",
    f"""{BASE_SQL}, {STEP_PROTOS_SQL},
    steps AS (
      SELECT s.user_id, s.row_idx AS w0, e.row_idx - s.row_idx AS t, [e.f1, e.f2, e.f3] AS x
      FROM prepared s JOIN prepared e ON e.user_id = s.user_id AND e.row_idx BETWEEN s.row_idx AND s.row_idx + {SEQ - 1}
      QUALIFY count(*) OVER (PARTITION BY s.user_id, s.row_idx) = {SEQ}
    ),
    mixed AS (
      SELECT user_id, w0, head, sum(({DECAY_LIST}::DOUBLE[])[t + 1] * list_cosine_similarity(x, p)) AS s
      FROM steps CROSS JOIN step_protos GROUP BY ALL
    )
    SELECT user_id, CAST(w0 AS BIGINT) AS window_start, CAST(head AS INTEGER) AS head,
           {sql_r6(f"exp(s / {TEMPERATURE}) / sum(exp(s / {TEMPERATURE})) OVER (PARTITION BY user_id, w0)")} AS gate
    FROM mixed""",
)
def window_gate(spark, folder):
    """One gate per window: its steps mixed with geometric decay."""
    gates = F.posexplode(adapters.gate_column("x", WINDOW_GATE)).alias("head", "gate")
    found = vector_windows(spark, folder).select("user_id", "window_start", gates)
    return found.select("user_id", "window_start", "head", r6("gate").alias("gate"))


FORWARD = "sum(g * ((0.8 + 0.04 * head + 1e-9) * y + 0.125))"
BACKWARD = "sum(g * ((y - 0.125) / (0.8 + 0.04 * head + 1e-9)))"


@register("adapt_label", f"WITH {gates_sql()} SELECT vec_id, {sql_r6(FORWARD)} AS adapted FROM gates GROUP BY vec_id")
def adapt_label(spark, folder):
    rows = embeddings(spark, folder)
    adapted = adapters.adapt_label("x", "label", label_adapter(label_gate(rows)))
    return rows.select("vec_id", r6(adapted).alias("adapted"))


@register(
    "adapt_label_inverse",
    f"WITH {gates_sql()} SELECT vec_id, {sql_r6(BACKWARD)} AS restored FROM gates GROUP BY vec_id",
)
def adapt_label_inverse(spark, folder):
    rows = embeddings(spark, folder)
    restored = adapters.adapt_label("x", "label", label_adapter(label_gate(rows)), inverse=True)
    return rows.select("vec_id", r6(restored).alias("restored"))


MOVED_SQL = f"""moved AS (
  SELECT vec_id, any_value(y) AS y, i, any_value(x[i + 1]) +
         sum(g * (list_sum(list_transform(range({WIDTH}), lambda j: 0.1 * sin(head + 2 * i + 3 * j) * x[j + 1])) + 0.01 * (head + i))) AS v
  FROM gates, range({WIDTH}) r(i) GROUP BY vec_id, i
)"""


@register(
    "adapt_features",
    f"""WITH {gates_sql()}, {MOVED_SQL}
        SELECT vec_id, CAST(i AS INTEGER) AS pos, {sql_r6("v")} AS value FROM moved""",
)
def adapt_features(spark, folder):
    rows = embeddings(spark, folder)
    moved = adapters.adapt_features(rows, "x", feature_adapter(label_gate(rows)), "moved")
    found = moved.select("vec_id", F.posexplode("moved").alias("pos", "value"))
    return found.select("vec_id", "pos", r6("value").alias("value"))


@register(
    "adapt_window_features",
    f"""{BASE_SQL}, {STEP_PROTOS_SQL},
    steps AS (
      SELECT s.user_id, s.row_idx AS w0, e.row_idx - s.row_idx AS t, [e.f1, e.f2, e.f3] AS x
      FROM prepared s JOIN prepared e ON e.user_id = s.user_id AND e.row_idx BETWEEN s.row_idx AND s.row_idx + {SEQ - 1}
      QUALIFY count(*) OVER (PARTITION BY s.user_id, s.row_idx) = {SEQ}
    ),
    sims AS (SELECT *, exp(list_cosine_similarity(x, p) / {TEMPERATURE}) AS s FROM steps CROSS JOIN step_protos),
    gates AS (SELECT *, s / sum(s) OVER (PARTITION BY user_id, w0, t) AS g FROM sims)
    SELECT user_id, CAST(w0 AS BIGINT) AS window_start, CAST(t AS INTEGER) AS step, CAST(i AS INTEGER) AS pos,
           {sql_r6("any_value(x[i + 1]) + sum(g * (list_sum(list_transform(range(3), lambda j: 0.1 * sin(head + 2 * i + 3 * j) * x[j + 1])) + 0.01 * (head + i)))", 5)} AS value
    FROM gates, range(3) r(i) GROUP BY user_id, w0, t, i""",
)
def adapt_window_features(spark, folder):
    """Each step of a window moved by its own gate."""
    adapter = adapters.FeatureAdapter(
        WINDOW_GATE,
        np.array([[[weight_rule(h, i, j) for j in range(3)] for i in range(3)] for h in range(HEADS)]),
        np.array([[0.01 * (h + i) for i in range(3)] for h in range(HEADS)]),
    )
    moved = adapters.adapt_features(vector_windows(spark, folder), "x", adapter, "moved")
    steps = moved.select("user_id", "window_start", F.posexplode("moved").alias("step", "v"))
    long = steps.select("user_id", "window_start", "step", F.posexplode("v").alias("pos", "value"))
    return long.withColumn("value", r6("value", 5))


def summed(vector):
    return F.aggregate(vector, F.lit(0.0), lambda a, v: a + v)


FORECAST_SQL = f"""WITH {gates_sql()}, {MOVED_SQL},
adapted AS (SELECT vec_id, sum(v) AS raw FROM moved GROUP BY vec_id),
plain AS (SELECT vec_id, list_sum(x) AS raw FROM em)
"""


@register(
    "adapted_forecast",
    FORECAST_SQL
    + f"""SELECT g.vec_id, {sql_r6(FORWARD)} AS adapted_label,
          {sql_r6("sum(g * ((raw - 0.125) / (0.8 + 0.04 * head + 1e-9)))")} AS prediction
          FROM gates g JOIN adapted a ON a.vec_id = g.vec_id GROUP BY g.vec_id""",
)
def adapted_forecast(spark, folder):
    rows = embeddings(spark, folder)
    gate = label_gate(rows)
    found = adapters.adapted_forecast(
        rows, "x", "label", summed, feature_adapter(gate), label_adapter(gate)
    )
    return found.select("vec_id", *[r6(c).alias(c) for c in ("adapted_label", "prediction")])


@register(
    "forecast_features_only",
    FORECAST_SQL
    + f"""SELECT e.vec_id, {sql_r6("e.label")} AS adapted_label, {sql_r6("a.raw")} AS prediction
          FROM em e JOIN adapted a USING (vec_id)""",
)
def forecast_features_only(spark, folder):
    rows = embeddings(spark, folder)
    adapter = feature_adapter(label_gate(rows))
    found = adapters.adapted_forecast(rows, "x", "label", summed, features=adapter)
    return found.select("vec_id", *[r6(c).alias(c) for c in ("adapted_label", "prediction")])


@register(
    "forecast_labels_only",
    FORECAST_SQL
    + f"""SELECT g.vec_id, {sql_r6(FORWARD)} AS adapted_label,
          {sql_r6("sum(g * ((raw - 0.125) / (0.8 + 0.04 * head + 1e-9)))")} AS prediction
          FROM gates g JOIN plain a ON a.vec_id = g.vec_id GROUP BY g.vec_id""",
)
def forecast_labels_only(spark, folder):
    rows = embeddings(spark, folder)
    adapter = label_adapter(label_gate(rows))
    found = adapters.adapted_forecast(rows, "x", "label", summed, labels=adapter)
    return found.select("vec_id", *[r6(c).alias(c) for c in ("adapted_label", "prediction")])


# Labels of the EV samples adapted by the window-mean vector (f1, f2, f3).

EV_ADAPTER = adapters.LabelAdapter(
    WINDOW_GATE, 0.8 + 0.04 * np.arange(HEADS), np.full(HEADS, 0.125)
)

SHIFT_SQL = f"""{BASE_SQL}, {TASKS_SQL}, {windows_sql(FEATURES)}, {STEP_PROTOS_SQL},
sims AS (
  SELECT user_id, w0, label, f1, head, exp(list_cosine_similarity([f1, f2, f3], p) / {TEMPERATURE}) AS s
  FROM wins CROSS JOIN step_protos
),
gated AS (SELECT *, s / sum(s) OVER (PARTITION BY user_id, w0) AS g FROM sims),
shifted AS (
  SELECT user_id, w0, sum(g * ((0.8 + 0.04 * head + 1e-9) * label + 0.125)) AS adapted,
         sum(g * ((f1 - 0.125) / (0.8 + 0.04 * head + 1e-9))) AS restored
  FROM gated GROUP BY user_id, w0
),
placed AS (SELECT s.*, a.adapted, a.restored FROM task_samples s JOIN shifted a USING (user_id, w0))"""


def adapted_samples(spark, folder):
    rows = splits.with_splits(processed_ev(spark, folder), EV_SERIES)
    means = windows.window_means(
        rows, FEATURES, "label", SEQ, series=EV_SERIES, keep=["split", "split_row", "split_rows"]
    ).withColumn("x", F.array(*FEATURES))
    means = means.withColumns(
        {
            "adapted": adapters.adapt_label("x", "label", EV_ADAPTER),
            "restored": adapters.adapt_label("x", "f1", EV_ADAPTER, inverse=True),
        }
    )
    return tasks.assign_tasks(means, SHAPE)


@register(
    "label_shift",
    f"""{SHIFT_SQL} SELECT user_id, CAST(task_id AS BIGINT) AS task_id, {sql_r6("avg(pow(adapted - label, 2))")} AS label_shift
        FROM placed WHERE part = 'support' GROUP BY ALL""",
)
def label_shift(spark, folder):
    rows = adapted_samples(spark, folder).filter("part = 'support'")
    found = adapters.label_shift(rows, "adapted", "label", ["user_id", "task_id"])
    return found.select("user_id", "task_id", r6("label_shift").alias("label_shift"))


@register(
    "task_objective",
    f"""{SHIFT_SQL}, shifts AS (
      SELECT user_id, task_id, avg(pow(adapted - label, 2)) AS shift FROM placed WHERE part = 'support' GROUP BY ALL
    ), sums AS (
      SELECT user_id, task_id, count(*) AS n, sum(label) AS sy, sum(label * label) AS syy,
             sum(restored) AS sx, sum(restored * restored) AS sxx, sum(restored * label) AS sxy,
             sum(f1) AS ox, sum(f1 * f1) AS oxx, sum(f1 * label) AS oxy
      FROM placed WHERE part = 'query' GROUP BY ALL
    ), losses AS (
      SELECT user_id, task_id, {loss_sql()} AS now, {loss_sql(sx="ox", sxx="oxx", sxy="oxy")} AS old FROM sums
    )
    SELECT user_id, CAST(task_id AS BIGINT) AS task_id, {sql_r6("now + shift * 0.5 + shift * (now - old) / 1.0")} AS objective
    FROM losses JOIN shifts USING (user_id, task_id)""",
)
def task_objective(spark, folder):
    """All three terms of a task in one aggregate over its samples."""
    rows = adapted_samples(spark, folder)
    query = F.col("part") == "query"
    now = moments.pair_sums("restored", "label")
    rows = rows.withColumns(
        {c: F.when(query, F.col(c)) for c in ("restored",)}
        | {"old": F.when(query, F.col("f1")), "moved": F.when(~query, F.col("adapted") - F.col("label"))}
    )
    old = moments.pair_sums("old", "label")
    sums = rows.groupBy("user_id", "task_id").agg(
        *[c.alias(n) for n, c in now.items()],
        *[c.alias(f"old_{n}") for n, c in old.items()],
        F.avg(F.col("moved") * F.col("moved")).alias("shift"),
    )
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    objective = adapters.task_objective(
        moments.correlation_loss(*[F.col(n) for n in names]),
        moments.correlation_loss(*[F.col(f"old_{n}") for n in names]),
        F.col("shift"),
    )
    return sums.select("user_id", "task_id", r6(objective).alias("objective"))


@register(
    "two_way_normalize",
    f"""{BASE_SQL},
    cells AS (
      SELECT user_id, row_idx, f, v FROM prepared, LATERAL (VALUES (0, f1), (1, f2), (2, f3)) c(f, v)
    ),
    wide AS (
      SELECT s.user_id, s.row_idx AS w0, c.row_idx - s.row_idx AS t, c.f, c.v
      FROM prepared s JOIN cells c ON c.user_id = s.user_id AND c.row_idx BETWEEN s.row_idx AND s.row_idx + {SEQ - 1}
      QUALIFY count(*) OVER (PARTITION BY s.user_id, s.row_idx) = {SEQ * 3}
    ),
    stats AS (
      SELECT *, avg(v) OVER bf AS mf, stddev_samp(v) OVER bf AS sf, avg(v) OVER bt AS mt, stddev_samp(v) OVER bt AS st
      FROM wide WINDOW bf AS (PARTITION BY user_id, w0, f), bt AS (PARTITION BY user_id, w0, t)
    )
    SELECT user_id, CAST(w0 AS BIGINT) AS window_start, CAST(t AS INTEGER) AS step, CAST(f AS INTEGER) AS feature,
           {sql_r6("0.3 * ((1 + 0.1 * t) * ((v - mt) / CASE WHEN st < 1e-4 THEN 1 ELSE st END) + 0.01 * t) + 0.7 * ((v - mf) / CASE WHEN sf < 1e-4 THEN 1 ELSE sf END - 0.02 * f)")} AS value
    FROM stats""",
)
def two_way_normalize(spark, folder):
    params = normalise.TwoWay(
        0.3,
        0.7,
        step_scale=[1 + 0.1 * t for t in range(SEQ)],
        step_bias=[0.01 * t for t in range(SEQ)],
        feature_bias=[-0.02 * f for f in range(3)],
    )
    found = normalise.two_way_normalize(
        processed_ev(spark, folder), FEATURES, SEQ, EV_SERIES, params
    )
    steps = found.select("user_id", "window_start", F.posexplode("normalized").alias("step", "v"))
    long = steps.select("user_id", "window_start", "step", F.posexplode("v").alias("feature", "value"))
    return long.withColumn("value", r6("value"))


def weight_matrices(spark, folder):
    """Each vector of 64 as an 8 by 8 matrix of weights: rows query, columns key."""
    cells = embeddings(spark, folder).select("vec_id", F.posexplode("x").alias("i", "weight"))
    return cells.select(
        "vec_id",
        F.expr("cast(i div 8 as int)").alias("query"),
        (F.col("i") % 8).alias("key"),
        "weight",
    )


CELLS_SQL = """cells AS (
  SELECT vec_id, unnest(range(64)) // 8 AS q, unnest(range(64)) % 8 AS k, unnest(CAST(embedding AS DOUBLE[])) AS w
  FROM embeddings)"""


@register(
    "attention_distance",
    f"WITH {CELLS_SQL} SELECT vec_id, {sql_r6('sum(abs(w) * abs(q - k)) / 8')} AS mean_distance FROM cells GROUP BY vec_id",
)
def attention_distance(spark, folder):
    found = normalise.attention_distance(weight_matrices(spark, folder), ["vec_id"])
    return found.select("vec_id", r6("mean_distance").alias("mean_distance"))


@register(
    "attention_peaks",
    f"""WITH {CELLS_SQL} SELECT vec_id, CAST(q AS INTEGER) AS query, {sql_r6('max(w)')} AS max_weight,
        CAST(arg_max(k, w) AS INTEGER) AS max_key FROM cells GROUP BY vec_id, q""",
)
def attention_peaks(spark, folder):
    found = normalise.attention_peaks(weight_matrices(spark, folder), ["vec_id"])
    return found.select("vec_id", "query", r6("max_weight").alias("max_weight"), "max_key")


# Classification: labelled documents with a score that falls with their length.


def scored_documents(spark, folder):
    documents = read(spark, folder, "documents").select("doc_id", "n_chars")
    rows = read(spark, folder, "labels").join(documents, "doc_id")
    score = 1 / (1 + F.col("n_chars") / 1000)
    rows = rows.select("doc_id", "toxic", "quality", score.alias("score"))
    return rows.withColumn("pred", metrics.predicted_class("score"))


LB_SQL = """lb AS (
  SELECT doc_id, toxic, quality AS t, 1 / (1 + n_chars / 1000) AS score,
         CASE WHEN 1 / (1 + n_chars / 1000) > 0.5 THEN 1 ELSE 0 END AS p
  FROM labels JOIN documents USING (doc_id)
), cells AS (
  SELECT toxic, sum(p * t) AS tp, sum(p * (1 - t)) AS fp, sum((1 - p) * t) AS fn, sum((1 - p) * (1 - t)) AS tn,
         count(*) AS n FROM lb GROUP BY toxic
)"""

BINARY_SQL = {
    "accuracy": "(tp + tn) / n",
    "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
    "precision": "coalesce(tp / nullif(tp + fp, 0), 0)",
    "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
    "cohen_kappa": "((tp + tn) / n - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n))"
    " / nullif(1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n), 0)",
    "matthews_corr": "(tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0)",
    "specificity": "coalesce(tn / nullif(tn + fp, 0), 0)",
}


def binary_query(name):
    def query(spark, folder):
        rows = scored_documents(spark, folder)
        found = metrics.binary_metrics(rows, "pred", "quality", ["toxic"], [name])
        return found.select("toxic", r6(name).alias(name))

    return query


for metric, expression in BINARY_SQL.items():
    register(
        f"metric_{metric}",
        f"WITH {LB_SQL} SELECT toxic, {sql_r6(expression)} AS {metric} FROM cells",
    )(binary_query(metric))


@register("predicted_class", f"WITH {LB_SQL} SELECT doc_id, CAST(p AS INTEGER) AS pred FROM lb")
def predicted_class(spark, folder):
    return scored_documents(spark, folder).select("doc_id", "pred")


@register(
    "binary_check",
    """SELECT source, count(DISTINCT quality) <= 2 AS is_binary FROM labels JOIN documents USING (doc_id) GROUP BY source""",
)
def binary_check(spark, folder):
    documents = read(spark, folder, "documents").select("doc_id", "source")
    rows = read(spark, folder, "labels").join(documents, "doc_id")
    return metrics.is_binary(rows, "quality", ["source"])


CURVES_SQL = """counts AS (
  SELECT {by}, score, sum(t) AS pos, sum(1 - t) AS neg FROM {source} GROUP BY ALL
), upto AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM counts
  WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)
), curves AS (
  SELECT {by}, sum(neg * (tp - pos / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc,
         sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) AS average_precision
  FROM upto GROUP BY ALL
)"""

PAIRS_SQL = """pairs AS (
  SELECT a.toxic, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auroc
  FROM lb a JOIN lb b ON a.toxic = b.toxic AND a.t = 1 AND b.t = 0 GROUP BY a.toxic
)"""


@register(
    "metric_auroc",
    f"WITH {LB_SQL}, {PAIRS_SQL} SELECT toxic, {sql_r6('auroc')} AS auroc FROM pairs",
)
def metric_auroc(spark, folder):
    found = metrics.ranking_metrics(scored_documents(spark, folder), "score", "quality", ["toxic"])
    return found.select("toxic", r6("auroc").alias("auroc"))


@register(
    "metric_average_precision",
    f"""WITH {LB_SQL}, {CURVES_SQL.format(by='toxic', source='lb')}
        SELECT toxic, {sql_r6('average_precision')} AS average_precision FROM curves""",
)
def metric_average_precision(spark, folder):
    """The path for groups of any size: scores ranked in slices."""
    found = metrics.ranking_metrics(
        scored_documents(spark, folder), "score", "quality", ["toxic"], bounded=False
    )
    return found.select("toxic", r6("average_precision").alias("average_precision"))


def scored_vectors(spark, folder):
    """Vectors scored against each label's mean, in four groups."""
    rows = embeddings(spark, folder)
    scores = adapters.gate_column("x", label_gate(rows))
    rows = rows.withColumn("scores", scores).withColumn("fold", (F.col("vec_id") % 4).cast("int"))
    return rows.withColumn("pred", metrics.predicted_class(scores="scores"))


FOLD_SQL = f"""{gates_sql()},
picked AS (
  SELECT vec_id, CAST(vec_id % 4 AS INTEGER) AS fold, any_value(y) AS t, CAST(arg_max(head, g) AS INTEGER) AS p
  FROM gates GROUP BY vec_id
),
classes AS (SELECT DISTINCT fold, c FROM (SELECT fold, t AS c FROM picked UNION SELECT fold, p FROM picked)),
per_class AS (
  SELECT k.fold, k.c, count(*) FILTER (WHERE p = c AND t = c) AS tp, count(*) FILTER (WHERE p = c) AS pp,
         count(*) FILTER (WHERE t = c) AS tt, count(*) AS n
  FROM classes k JOIN picked USING (fold) GROUP BY ALL
)"""


@register("predicted_class_scores", f"WITH {FOLD_SQL} SELECT vec_id, p AS pred FROM picked")
def predicted_class_scores(spark, folder):
    return scored_vectors(spark, folder).select("vec_id", "pred")


MACRO = ["accuracy", "f1", "precision", "recall", "specificity", "cohen_kappa", "matthews_corr"]


MACRO_SQL = f"""
        {sql_r6("avg(coalesce(tp / nullif(tt, 0), 0))")} AS accuracy,
        {sql_r6("avg(coalesce(2 * tp / nullif(pp + tt, 0), 0))")} AS f1,
        {sql_r6("avg(coalesce(tp / nullif(pp, 0), 0))")} AS precision,
        {sql_r6("avg(coalesce(tp / nullif(tt, 0), 0))")} AS recall,
        {sql_r6("avg(coalesce((n - pp - tt + tp) / nullif(n - tt, 0), 0))")} AS specificity,
        {sql_r6("(sum(tp) / any_value(n) - sum(pp * tt) / pow(any_value(n), 2)) / nullif(1 - sum(pp * tt) / pow(any_value(n), 2), 0)")} AS cohen_kappa,
        {sql_r6("(sum(tp) * any_value(n) - sum(pp * tt)) / nullif(sqrt((pow(any_value(n), 2) - sum(pp * pp)) * (pow(any_value(n), 2) - sum(tt * tt))), 0)")} AS matthews_corr"""


@register("multiclass_metrics", f"WITH {FOLD_SQL} SELECT fold, {MACRO_SQL} FROM per_class GROUP BY fold")
def multiclass_metrics(spark, folder):
    found = metrics.multiclass_metrics(
        scored_vectors(spark, folder), "pred", "label", ["fold"], MACRO
    )
    return found.select("fold", *[r6(m).alias(m) for m in MACRO])


GAPS_SQL = """picked AS (
  SELECT fold, p, t FROM (
    SELECT CAST(doc_id % 3 AS INTEGER) AS fold, CASE WHEN doc_id % 7 <> 0 THEN quality END AS p,
           CASE WHEN doc_id % 5 <> 0 THEN toxic END AS t FROM labels
  ) WHERE p IS NOT NULL AND t IS NOT NULL
),
""" + FOLD_SQL[FOLD_SQL.index("classes AS (") :]


@register(
    "multiclass_metrics_with_gaps",
    f"WITH {GAPS_SQL} SELECT fold, {MACRO_SQL} FROM per_class GROUP BY fold",
)
def multiclass_metrics_with_gaps(spark, folder):
    """Rows without a prediction or a target count nowhere."""
    rows = read(spark, folder, "labels").select(
        (F.col("doc_id") % 3).cast("int").alias("fold"),
        F.when(F.col("doc_id") % 7 != 0, F.col("quality")).alias("p"),
        F.when(F.col("doc_id") % 5 != 0, F.col("toxic")).alias("t"),
    )
    found = metrics.multiclass_metrics(rows, "p", "t", ["fold"], MACRO)
    return found.select("fold", *[r6(m).alias(m) for m in MACRO])


@register(
    "one_vs_rest_metrics",
    f"""WITH {gates_sql()}, hits AS (
          SELECT CAST(vec_id % 4 AS INTEGER) AS fold, head, round(g, 12) AS score, CASE WHEN y = head THEN 1 ELSE 0 END AS t FROM gates
        ), {CURVES_SQL.format(by='fold, head', source='hits')}
        SELECT fold, {sql_r6('avg(auroc)')} AS auroc, {sql_r6('avg(average_precision)')} AS average_precision
        FROM curves GROUP BY fold""",
)
def one_vs_rest_metrics(spark, folder):
    rows = scored_vectors(spark, folder)
    rounded = F.transform("scores", lambda s: F.round(s, 12))
    found = metrics.one_vs_rest_metrics(
        rows.withColumn("scores", rounded), "scores", "label", ["fold"]
    )
    return found.select("fold", *[r6(m).alias(m) for m in ("auroc", "average_precision")])
