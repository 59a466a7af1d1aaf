"""The offline training loop over the tasks of one long series."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import CHUNK, FILTER_LENGTH, OR_ORDER, SHIFT, TRAIN, VALID, r6, read, register, sql_r6
from catalog.tasks import OR_SHAPE
from catalog.walkforward import OR_SAMPLES_SQL, pair_stats
from driftwalk.operators import moments, splits, windows
from driftwalk.plans.prepare import prepare_features_and_labels
from driftwalk.plans.training import offline_training
from driftwalk.staging import stage

PAIR = ["f1", "f2"]
START, INNER, OUTER = (0.5, -0.5), 0.02, 0.05
EPOCHS, PATIENCE, BLOCK, SEED = 3, 2, 8, 5


def pair_moments(spark, folder):
    """Moments of the order tasks with two features."""
    rows = read(spark, folder, "orders").select(
        "o_orderdate",
        "o_orderkey",
        "o_totalprice",
        (F.col("o_totalprice") / 1e5).alias("f1"),
        (F.col("o_orderkey") % 11 / 11.0).alias("f2"),
    )
    table, _, label = prepare_features_and_labels(
        rows,
        OR_ORDER,
        price="o_totalprice",
        features=PAIR,
        filter_length=FILTER_LENGTH,
        shift_length=SHIFT,
        part_rows=4096,
    )
    table = stage(table.withColumnRenamed(label, "label"), "processed")
    placed = splits.with_splits(table, ratios=(TRAIN, VALID), chunk_rows=CHUNK)
    means = windows.window_means(
        placed,
        PAIR,
        "label",
        OR_SHAPE.seq_length,
        chunk_rows=CHUNK,
        keep=["split", "split_row", "split_rows"],
    )
    return stage(moments.task_moments(means, PAIR, "label", OR_SHAPE), "moments")


PAIR_SAMPLES_SQL = (
    OR_SAMPLES_SQL.replace("SELECT i AS row_idx, x / 1e5 AS f1,", "SELECT i AS row_idx, x / 1e5 AS f1, o_orderkey % 11 / 11.0 AS f2,")
    .replace("FROM long_filtered\n),\nkept", "FROM long_filtered JOIN ori ON row_idx = i\n),\nkept")
    .replace("SELECT row_idx, f1, m, greatest", "SELECT row_idx, f1, f2, m, greatest")
    .replace("SELECT row_idx, f1, CASE", "SELECT row_idx, f1, f2, CASE")
    .replace("avg(f1) OVER w AS f1,", "avg(f1) OVER w AS f1, avg(f2) OVER w AS f2,")
    .replace("w.f1, w.label", "w.f1, w.f2, w.label")
)


def _gradient(of: str, w: tuple[str, str]) -> tuple[str, str]:
    """Gradient of the correlation loss by the weights, from statistics of ``of``."""
    a, b = w
    s = {k: f"{of}.{k}" for k in ("s11", "s12", "s22", "c1", "c2", "u")}
    v = f"({a} * {a} * {s['s11']} + 2 * {a} * {b} * {s['s12']} + {b} * {b} * {s['s22']})"
    along = f"({a} * {s['c1']} + {b} * {s['c2']})"

    def entry(moved: str, c: str) -> str:
        return (
            f"CASE WHEN {v} > 0 AND {s['u']} > 0 THEN {along} * ({moved}) / (pow({v}, 1.5) * sqrt({s['u']}))"
            f" - {c} / sqrt({v} * {s['u']}) ELSE 0 END"
        )

    return (
        entry(f"{s['s11']} * {a} + {s['s12']} * {b}", s["c1"]),
        entry(f"{s['s12']} * {a} + {s['s22']} * {b}", s["c2"]),
    )


def _shared(of: str, w: tuple[str, str]) -> tuple[str, str]:
    """Variance of the forecast and its covariance with the target."""
    a, b = w
    variance = f"greatest({a} * {a} * {of}.s11 + 2 * {a} * {b} * {of}.s12 + {b} * {b} * {of}.s22, 0)"
    return variance, f"({a} * {of}.c1 + {b} * {of}.c2)"


def _epoch_sql(epoch: int) -> str:
    """Weights after an epoch: a recursion over the tasks of every block, averaged."""
    before = f"w{epoch - 1}"
    inner = _gradient("s", ("w1", "w2"))
    outer = _gradient("q", ("a1", "a2"))
    variance, shared = _shared("q", ("a1", "a2"))
    judged = _gradient("s", ("w.w1", "w.w2"))
    valid_variance, valid_shared = _shared("q", ("v1", "v2"))
    corr = f"{shared} * 1e4 / sqrt((1e4 * {variance} + 1e-8) * (1e4 * q.u + 1e-8))"
    return f"""
o{epoch} AS (
  SELECT task_id, position // {BLOCK} AS block, position % {BLOCK} AS spot FROM (
    SELECT task_id, row_number() OVER (ORDER BY md5(concat_ws('|', 'train', CAST(task_id AS BIGINT), {epoch}, {SEED})), task_id) - 1
             AS position
    FROM (SELECT DISTINCT task_id FROM sup WHERE split = 'train'))
),
b{epoch} AS (
  SELECT block, CAST(-1 AS BIGINT) AS spot, w1, w2, CAST(0 AS DOUBLE) AS loss FROM {before}, (SELECT DISTINCT block FROM o{epoch})
  UNION ALL
  SELECT block, spot, a0 - {OUTER} * {outer[0].replace("a1", "x.a1").replace("a2", "x.a2")},
         b0 - {OUTER} * {outer[1].replace("a1", "x.a1").replace("a2", "x.a2")},
         1 - greatest(least({corr.replace("a1", "x.a1").replace("a2", "x.a2")}, 1), -1)
  FROM (
    SELECT b.block, o.spot, o.task_id, w1 AS a0, w2 AS b0, w1 - {INNER} * {inner[0]} AS a1, w2 - {INNER} * {inner[1]} AS a2
    FROM b{epoch} b JOIN o{epoch} o ON o.block = b.block AND o.spot = b.spot + 1
    JOIN sup s ON s.split = 'train' AND s.task_id = o.task_id
  ) x JOIN qry q ON q.split = 'train' AND q.task_id = x.task_id
),
w{epoch} AS (
  SELECT sum(w1 * n) / sum(n) AS w1, sum(w2 * n) / sum(n) AS w2, sum(l) / sum(n) AS loss
  FROM (SELECT block, count(*) - 1 AS n, sum(loss) AS l, arg_max(w1, spot) AS w1, arg_max(w2, spot) AS w2 FROM b{epoch} GROUP BY block)
),
v{epoch} AS (
  SELECT avg({valid_shared} / sqrt({valid_variance} * q.u)) AS value FROM (
    SELECT s.task_id, w.w1 - {INNER} * {judged[0]} AS v1, w.w2 - {INNER} * {judged[1]} AS v2
    FROM sup s, w{epoch} w WHERE s.split = 'valid'
  ) JOIN qry q USING (task_id) WHERE q.split = 'valid'
)"""


def _training_sql() -> str:
    found = PAIR_SAMPLES_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    for part, name in (("support", "sup"), ("query", "qry")):
        found += f",\n{pair_stats('task_samples', f'''part = '{part}' ''', name, 'split, task_id')}"
    found += f",\nw0 AS (SELECT CAST({START[0]} AS DOUBLE) AS w1, CAST({START[1]} AS DOUBLE) AS w2)"
    for epoch in range(1, EPOCHS + 1):
        found += f",{_epoch_sql(epoch)}"
    rows = " UNION ALL ".join(
        f"SELECT {e} AS epoch, loss, value, w1, w2 FROM w{e}, v{e}" for e in range(1, EPOCHS + 1)
    )
    return f"""{found},
history AS ({rows}),
judged AS (SELECT *, value > coalesce(max(value) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -9) AS improved FROM history),
waited AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch) AS waited FROM judged),
used AS (SELECT * FROM waited WHERE epoch <= coalesce((SELECT min(epoch) FROM waited WHERE waited >= {PATIENCE}), {EPOCHS}))
SELECT CAST(epoch AS INT) AS epoch, {sql_r6("loss", 5)} AS train_loss, {sql_r6("value", 5)} AS valid_value, {sql_r6("w1", 5)} AS w1,
       {sql_r6("w2", 5)} AS w2, epoch = (SELECT max(epoch) FROM used WHERE improved) AS best
FROM used"""


@register("offline_training", _training_sql())
def offline_training_history(spark, folder):
    """Loss, validation score and weights after each epoch, and which one is kept."""
    found = offline_training(
        pair_moments(spark, folder),
        START,
        EPOCHS,
        INNER,
        OUTER,
        patience=PATIENCE,
        block_tasks=BLOCK,
        seed=SEED,
    )
    return found.history.select(
        "epoch",
        r6("train_loss", 5).alias("train_loss"),
        r6("valid_value", 5).alias("valid_value"),
        r6(F.col("weights")[0], 5).alias("w1"),
        r6(F.col("weights")[1], 5).alias("w2"),
        F.col("epoch").eqNullSafe(F.lit(found.best_epoch)).alias("best"),
    )
