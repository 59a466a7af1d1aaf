"""Regression and classification metrics per group.

Errors are negated so that larger is better. Undefined values are null; an
unknown name is an error. Groups may hold any share of the rows: everything is
reduced by key before a value of the group is formed, and rank-based metrics
use running sums over distinct scores.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftwalk.operators.joins import attach, broadcast_if_small
from driftwalk.operators.ordering import groups_are_bounded, running_sums
from driftwalk.staging import stage

# Fixed value: smallest magnitude a percentage error divides by.
PERCENT_FLOOR = 1.17e-6

# Distinct pairs of one value that a join key may hold, and values that may hold more.
PIECE_ROWS, HEAVY_VALUES = 1 << 20, 50_000


def _ratio(above: Column, below: Column) -> Column:
    return F.try_divide(above, below)


def _concordance(p: Column, t: Column) -> Column:
    a, b = p * 100, t * 100
    spread = F.var_samp(a) + F.var_samp(b) + F.pow(F.avg(a) - F.avg(b), F.lit(2))
    return _ratio(2 * F.covar_samp(a, b), spread)


def _r2(p: Column, t: Column) -> Column:
    return 1 - _ratio(F.sum((t - p) * (t - p)), F.var_pop(t) * F.count(t))


def _pearson(p: Column, t: Column) -> Column:
    return _ratio(F.covar_pop(p, t), F.stddev_pop(p) * F.stddev_pop(t))


REGRESSION: dict[str, Callable[[Column, Column], Column]] = {
    "concordance": _concordance,
    "mse": lambda p, t: -F.avg((p - t) * (p - t)),
    "mae": lambda p, t: -F.avg(F.abs(p - t)),
    "r2": _r2,
    "rmse": lambda p, t: -F.sqrt(F.avg((p - t) * (p - t))),
    "mape": lambda p, t: -F.avg(F.abs(p - t) / F.greatest(F.abs(t), F.lit(PERCENT_FLOOR))),
    "smape": lambda p, t: -F.avg(
        2 * F.abs(p - t) / F.greatest(F.abs(p) + F.abs(t), F.lit(PERCENT_FLOOR))
    ),
    "explained_variance": lambda p, t: 1 - _ratio(F.var_pop(t - p), F.var_pop(t)),
    "pearson": _pearson,
}
RANKED = "spearman"

COUNTED = (
    "accuracy",
    "f1",
    "precision",
    "recall",
    "cohen_kappa",
    "matthews_corr",
    "specificity",
)
SCORED = ("auroc", "average_precision")


def _known_names(metrics: Sequence[str], allowed: Sequence[str]) -> None:
    unknown = [m for m in metrics if m not in allowed]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")


def regression_metrics(
    df: DataFrame,
    pred: str,
    target: str,
    by: Sequence[str],
    metrics: Sequence[str] = tuple(REGRESSION),
    bounded: bool = False,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """One row per group and one column per metric, in a single aggregate.

    Rows with an unknown prediction or target do not count. ``spearman`` adds
    a ranking; ``bounded`` states that groups are short, as tasks are, and
    ``piece_rows`` is how many distinct pairs of a value one join key may hold.
    """
    _known_names(metrics, [*REGRESSION, RANKED])
    by = list(by)
    rows = df.select(*by, F.col(pred).cast("double").alias("p"), F.col(target).cast("double").alias("t"))
    rows = rows.filter(F.col("p").isNotNull() & F.col("t").isNotNull())
    columns = {m: REGRESSION[m](F.col("p"), F.col("t")) for m in metrics if m != RANKED}
    if RANKED not in metrics:
        return rows.groupBy(*by).agg(*[columns[m].alias(m) for m in metrics])
    if bounded:
        rows = _with_ranks(rows, by)
        columns[RANKED] = _pearson(F.col("rank_p"), F.col("rank_t"))
        return rows.groupBy(*by).agg(*[columns[m].alias(m) for m in metrics])
    ranked = _rank_correlation(rows, by, piece_rows)
    if columns:
        found = rows.groupBy(*by).agg(*[c.alias(m) for m, c in columns.items()])
        if by:
            ranked = attach(found, ranked, by)
        else:
            ranked = found.withColumn(RANKED, ranked.select(RANKED).scalar())
    return ranked.select(*by, *metrics)


def _with_ranks(rows: DataFrame, by: list[str]) -> DataFrame:
    """Average ranks of both columns in their short group."""
    for name in ("p", "t"):
        order = Window.partitionBy(*by).orderBy(name)
        ties = Window.partitionBy(*by, name)
        rank = F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2
        rows = rows.withColumn(f"rank_{name}", rank)
    return rows


def _rank_correlation(rows: DataFrame, by: list[str], piece_rows: int) -> DataFrame:
    """``spearman`` per group from its distinct pairs, each counted once.

    However many rows a pair has, it is one row from the first partial count on.
    """
    pairs = rows.groupBy(*by, "p", "t").agg(F.count(F.lit(1)).alias("rows"))
    pairs = stage(pairs, "pairs")
    # Ranks of n rows have the mean (n + 1) / 2, about which they are summed.
    middles = pairs.groupBy(*by).agg(((F.sum("rows") + 1) / 2).alias("__middle"))
    piece = max(piece_rows, -(-pairs.count() // HEAVY_VALUES))
    tables = {name: _rank_table(pairs, by, name, piece) for name in ("p", "t")}
    for name, (ranks, heavy) in tables.items():
        keys, other = [*by, name], "t" if name == "p" else "p"
        salt = F.pmod(F.xxhash64(other), F.coalesce("__pieces", F.lit(1))).cast("int")
        pairs = attach(pairs, heavy, keys, "left").withColumn("__salt", salt).drop("__pieces")
        pairs = attach(pairs, ranks, [*keys, "__salt"]).drop("__salt")
    if by:
        pairs = attach(pairs, middles, by)
    else:
        pairs = pairs.withColumn("__middle", middles.scalar())
    n = F.col("rows").cast("double")
    p, t = (F.col(f"rank_{c}") - F.col("__middle") for c in "pt")
    spread = F.sqrt(F.sum(n * p * p)) * F.sqrt(F.sum(n * t * t))
    return pairs.groupBy(*by).agg(_ratio(F.sum(n * p * t), spread).alias(RANKED))


def _rank_table(
    pairs: DataFrame, by: list[str], name: str, piece: int
) -> tuple[DataFrame, DataFrame]:
    """Ranks of the distinct values, and the values in more than ``piece`` pairs.

    A heavy value has many rows in ``pairs``: its rank is there once for each of the
    ``__pieces`` that a hash of the partner splits it into. A piece holds a fixed share
    of the pairs at least, so no more than ``HEAVY_VALUES`` values can be heavy.
    """
    counts = pairs.groupBy(*by, name).agg(
        F.sum("rows").alias("ties"), F.count(F.lit(1)).alias("partners")
    )
    counts = stage(counts, "values")
    pieces = F.expr(f"cast(partners div {piece}L + 1 as int)").alias("__pieces")
    heavy = counts.filter(F.col("partners") > piece).select(*by, name, pieces)
    heavy = broadcast_if_small(heavy)
    upto = running_sums(counts, by, [name], {"upto": F.col("ties")})
    rank = F.col("upto") - (F.col("ties") - 1) / 2
    upto = attach(upto.select(*by, name, rank.alias(f"rank_{name}")), heavy, [*by, name], "left")
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1))
    return upto.withColumn("__salt", salts).drop("__pieces"), heavy


def predicted_class(score: str | None = None, scores: str | None = None, binary: bool = True) -> Column:
    """Class of the largest score, a score over one half, or the nearest integer."""
    if scores is not None:
        return (F.array_position(F.col(scores), F.array_max(scores)) - 1).cast("int")
    if score is None:
        raise ValueError("give a score or an array of scores")
    if binary:
        return F.when(F.col(score) > 0.5, 1).otherwise(0)
    return F.rint(score).cast("int")


def softmax(scores: Column) -> Column:
    """Exponentials of an array over their sum, shifted by the largest."""
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    norm = F.aggregate(raised, F.lit(0.0), lambda a, s: a + s)
    return F.transform(raised, lambda s: s / norm)


def is_binary(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Whether each group has at most two distinct targets."""
    return (
        df.select(*by, target)
        .distinct()
        .groupBy(*by)
        .agg((F.count(target) <= 2).alias("is_binary"))
    )


def confusion(df: DataFrame, pred: str, target: str, by: Sequence[str]) -> DataFrame:
    """Rows per group, predicted and true class; rows that lack either count nowhere."""
    pairs = df.select(*by, F.col(pred).cast("int").alias("pred"), F.col(target).cast("int").alias("target"))
    pairs = pairs.filter(F.col("pred").isNotNull() & F.col("target").isNotNull())
    return pairs.groupBy(*by, "pred", "target").agg(F.count(F.lit(1)).alias("rows"))


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _binary(name: str) -> Column:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    if name == "accuracy":
        return _ratio(tp + tn, n)
    if name == "f1":
        return _zero(_ratio(2 * tp, 2 * tp + fp + fn))
    if name == "precision":
        return _zero(_ratio(tp, tp + fp))
    if name == "recall":
        return _zero(_ratio(tp, tp + fn))
    if name == "specificity":
        return _zero(_ratio(tn, tn + fp))
    if name == "cohen_kappa":
        chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
        return _ratio((tp + tn) / n - chance, 1 - chance)
    spread = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return _ratio(tp * tn - fp * fn, F.sqrt(spread))


def binary_metrics(
    df: DataFrame,
    pred: str,
    target: str,
    by: Sequence[str],
    metrics: Sequence[str] = COUNTED,
) -> DataFrame:
    """Metrics of a 0/1 prediction per group, from four counts."""
    _known_names(metrics, COUNTED)
    p, t = F.col(pred) == 1, F.col(target) == 1
    cells = {"tp": p & t, "fp": p & ~t, "fn": ~p & t, "tn": ~p & ~t}
    counts = df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
    return counts.select(*by, *[_binary(m).alias(m) for m in metrics])


def multiclass_metrics(
    df: DataFrame,
    pred: str,
    target: str,
    by: Sequence[str],
    metrics: Sequence[str] = COUNTED,
) -> DataFrame:
    """Macro averages over the classes that occur, and whole-table agreement.

    Works on the confusion table; each step groups rows of that table only.
    """
    _known_names(metrics, COUNTED)
    by = list(by)
    table = confusion(df, pred, target, by)
    # Each cell counts for its predicted and its true class.
    sides = F.array(
        F.struct(F.col("pred").alias("class"), F.lit(True).alias("as_pred")),
        F.struct(F.col("target").alias("class"), F.lit(False).alias("as_pred")),
    )
    rows = F.col("rows")
    per_class = (
        table.select(*by, "pred", "target", "rows", F.inline(sides))
        .groupBy(*by, "class")
        .agg(
            F.sum(F.when(F.col("as_pred") & (F.col("pred") == F.col("target")), rows).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("as_pred"), rows).otherwise(0)).alias("predicted"),
            F.sum(F.when(~F.col("as_pred"), rows).otherwise(0)).alias("actual"),
        )
    )
    # One row per class: a group's total beside each, and all counts as doubles, whose
    # products cannot overflow.
    total = F.sum("actual").over(Window.partitionBy(*by))
    per_class = per_class.withColumns(
        {c: v.cast("double") for c, v in (("n", total), *((c, F.col(c)) for c in ("tp", "predicted", "actual")))}
    )
    tp, predicted, actual = F.col("tp"), F.col("predicted"), F.col("actual")
    negatives = F.col("n") - actual
    sums = per_class.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.sum("tp").alias("right"),
        F.sum(predicted * actual).alias("cross"),
        F.sum(predicted * predicted).alias("predicted_2"),
        F.sum(actual * actual).alias("actual_2"),
        F.avg(_zero(_ratio(tp, actual))).alias("recall"),
        F.avg(_zero(_ratio(tp, predicted))).alias("precision"),
        F.avg(_zero(_ratio(2 * tp, predicted + actual))).alias("f1"),
        F.avg(_zero(_ratio(negatives - predicted + tp, negatives))).alias("specificity"),
    )
    n, right, cross = F.col("n"), F.col("right"), F.col("cross")
    columns = {
        "accuracy": F.col("recall"),
        "recall": F.col("recall"),
        "precision": F.col("precision"),
        "f1": F.col("f1"),
        "specificity": F.col("specificity"),
        "cohen_kappa": _ratio(right / n - cross / (n * n), 1 - cross / (n * n)),
        "matthews_corr": _ratio(
            right * n - cross,
            F.sqrt((n * n - F.col("predicted_2")) * (n * n - F.col("actual_2"))),
        ),
    }
    return sums.select(*by, *[columns[m].alias(m) for m in metrics])


def ranking_metrics(
    df: DataFrame,
    score: str,
    target: str,
    by: Sequence[str],
    bounded: bool | None = None,
) -> DataFrame:
    """Area under ROC and average precision of a 0/1 target per group.

    Scores are first counted by value; both metrics then are sums over distinct
    scores in falling order.
    """
    by = list(by)
    positive = F.col(target) == 1
    counts = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    counts = counts.withColumn("falling", -F.col("score"))
    if bounded is None:
        bounded = groups_are_bounded(counts, by)
    upto = running_sums(
        counts, by, ["falling"], {"all_pos": F.col("pos"), "all_neg": F.col("neg")}, bounded
    )
    # A negative is beaten by the positives above it and by half of those tied.
    beaten = F.col("neg") * (F.col("all_pos") - F.col("pos") / 2)
    precise = F.col("pos") * _ratio(F.col("all_pos"), F.col("all_pos") + F.col("all_neg"))
    pos, neg = F.sum("pos"), F.sum("neg")
    return upto.groupBy(*by).agg(
        _ratio(F.sum(beaten), pos * neg.cast("double")).alias("auroc"),
        _ratio(F.sum(precise), pos).alias("average_precision"),
    )


def one_vs_rest_metrics(
    df: DataFrame,
    scores: str,
    target: str,
    by: Sequence[str],
    bounded: bool | None = None,
    logits: bool = False,
) -> DataFrame:
    """``ranking_metrics`` of every class against the rest, averaged over classes.

    Classes without both kinds of rows are left out of the average. With
    ``logits`` the scores of a row become probabilities first.
    """
    by = list(by)
    values = softmax(F.col(scores)) if logits else F.col(scores)
    long = df.select(*by, target, F.posexplode(values).alias("class", "score"))
    long = long.withColumn("hit", (F.col(target) == F.col("class")).cast("int"))
    per_class = ranking_metrics(long, "score", "hit", [*by, "class"], bounded)
    return per_class.groupBy(*by).agg(
        F.avg("auroc").alias("auroc"), F.avg("average_precision").alias("average_precision")
    )


def metric_summary(history: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean and population spread of a metric over tasks."""
    return history.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread")
    )


def running_mean(
    history: DataFrame,
    value: str,
    by: Sequence[str],
    order: Sequence[str],
    bounded: bool | None = None,
) -> DataFrame:
    """Mean of a metric over the tasks so far, in order."""
    sums = {"__so_far": F.col(value).cast("double"), "__tasks": F.col(value).isNotNull().cast("bigint")}
    sums["__so_far"] = F.coalesce(sums["__so_far"], F.lit(0.0))
    found = running_sums(history, by, order, sums, bounded)
    mean = _ratio(F.col("__so_far"), F.col("__tasks"))
    return found.withColumn("running_mean", mean).drop("__so_far", "__tasks")


def early_stop(
    history: DataFrame, epoch: str, value: str, patience: int, by: Sequence[str] = ()
) -> DataFrame:
    """Best epoch and stopping epoch of each run's metric history.

    An epoch improves when it beats all before it; after ``patience`` epochs in
    a row without improvement the run stops, and later epochs do not count. A
    history has one row per epoch of one run.
    """
    if patience <= 0:
        raise ValueError("patience must be positive")
    run = Window.partitionBy(*(by or [F.lit(0)])).orderBy(epoch)
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.max(value).over(earlier)
    rows = history.withColumns(
        {
            "__improved": F.coalesce(F.col(value) > best_before, F.col(value).isNotNull()),
            "__number": F.row_number().over(run),
        }
    )
    last = F.last(F.when(F.col("__improved"), F.col("__number")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("__waited", F.col("__number") - F.coalesce(last, F.lit(0)))
    stops = F.when(F.col("__waited") >= patience, F.col("__number"))
    rows = rows.withColumn("__first_stop", F.min(stops).over(Window.partitionBy(*(by or [F.lit(0)]))))
    used = F.col("__first_stop").isNull() | (F.col("__number") <= F.col("__first_stop"))
    improving = F.when(used & F.col("__improved"), F.col("__number"))
    return rows.groupBy(*by).agg(
        F.max_by(epoch, improving).alias("best_epoch"),
        F.max_by(value, improving).alias("best_value"),
        F.max(F.when(F.col("__number") == F.col("__first_stop"), F.col(epoch))).alias("stop_epoch"),
    )
