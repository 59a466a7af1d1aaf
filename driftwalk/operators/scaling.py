"""Robust scaling by median and median absolute deviation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftwalk.functions.columns import clip, known
from driftwalk.operators.joins import attach, broadcast_if_small
from driftwalk.operators.ordering import ROW, attach_by_part, series_lengths
from driftwalk.operators.selection import MEDIAN_CELLS, medians, series_medians
from driftwalk.staging import stage

# Deviation to standard deviation, guard of the divisor, clip bound.
MAD_SCALE = 1.4826
EPSILON = 1e-8
CLIP = 3.0

PARAMS_SCHEMA = "feature string, median double, mad double, clip boolean"


@dataclass
class RobustScaler:
    """``(x - median) / (mad + 1e-8)``, clipped to [-3, 3] if asked.

    The parameters are two numbers per column, so they travel as literals.
    """

    clip_outlier: bool = True
    params: dict[str, tuple[float, float]] = field(default_factory=dict)

    def is_fitted(self) -> bool:
        return bool(self.params)

    def fit(
        self,
        df: DataFrame,
        columns: Sequence[str],
        approximate: bool = False,
        accuracy: int = 10_000,
        median_cells: int = MEDIAN_CELLS,
    ) -> RobustScaler:
        """Medians and deviations of the columns, ignoring null and NaN.

        Exact at any size; ``approximate`` uses quantile sketches instead, with
        a rank error of one in ``accuracy``.
        """
        if approximate:
            def middle(values: dict[str, Column]) -> dict[str, float | None]:
                sketches = [
                    F.percentile_approx(known(c.cast("double")), 0.5, accuracy).alias(n)
                    for n, c in values.items()
                ]
                return df.agg(*sketches).first().asDict()
        else:
            rows = df.count()

            def middle(values: dict[str, Column]) -> dict[str, float | None]:
                return medians(df, values, rows, median_cells)

        centres = middle({c: F.col(c) for c in columns})
        centres = {c: math.nan if m is None else m for c, m in centres.items()}
        spreads = middle({c: F.abs(F.col(c) - F.lit(centres[c])) for c in columns})
        self.params = {
            c: (centres[c], math.nan if spreads[c] is None else spreads[c] * MAD_SCALE)
            for c in columns
        }
        return self

    def _fitted(self) -> dict[str, tuple[float, float]]:
        if not self.is_fitted():
            raise ValueError("scaler is not fitted")
        return self.params

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {}
        for name, (median, mad) in self._fitted().items():
            value = (F.col(name).cast("double") - F.lit(median)) / F.lit(mad + EPSILON)
            scaled[name] = clip(value, -CLIP, CLIP) if self.clip_outlier else value
        return df.withColumns(scaled)

    def fit_transform(self, df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
        return self.fit(df, columns, **options).transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """``z * mad + median``; clipping is not undone."""
        return df.withColumns(
            {
                name: F.col(name) * F.lit(mad) + F.lit(median)
                for name, (median, mad) in self._fitted().items()
            }
        )

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n, m, d, self.clip_outlier) for n, (m, d) in self._fitted().items()]
        return spark.createDataFrame(rows, PARAMS_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RobustScaler:
        """One small row per column, in the order saved."""
        rows = spark.read.schema(PARAMS_SCHEMA).parquet(path).collect()
        if not rows:
            raise ValueError(f"no scaler parameters at {path}")
        return cls(rows[0]["clip"], {r["feature"]: (r["median"], r["mad"]) for r in rows})


@dataclass
class SeriesScaler:
    """A ``RobustScaler`` of its own for every series.

    ``params`` has a row per series and feature, and stays a table: there may be as
    many series as there are users. A series unseen when fitted is scaled to null.
    """

    series: Sequence[str]
    clip_outlier: bool = True
    params: DataFrame | None = None

    def fit(
        self, df: DataFrame, columns: Sequence[str], bounded: bool | None = None
    ) -> SeriesScaler:
        """Exact medians and deviations per series, ignoring null and NaN."""
        series = list(self.series)
        centres = series_medians(df, {c: F.col(c) for c in columns}, series, bounded)
        centres = stage(centres, "medians")
        apart = attach(df, broadcast_if_small(self._wide(centres, ["median"], columns)), series)
        deviations = {c: F.abs(F.col(c) - F.col(_named("median", c))) for c in columns}
        spreads = series_medians(apart, deviations, series, bounded)
        spreads = spreads.withColumn("mad", F.col("median") * MAD_SCALE).drop("median")
        self.params = stage(attach(centres, spreads, [*series, "feature"], "left"), "params")
        return self

    def _wide(self, params: DataFrame, names: Sequence[str], columns: Sequence[str]) -> DataFrame:
        """A row per series with a column for each number of each feature."""
        found = [
            F.max(F.when(F.col("feature") == c, F.col(n))).alias(_named(n, c))
            for c in columns
            for n in names
        ]
        return params.groupBy(*self.series).agg(*found)

    def _with_params(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        if self.params is None:
            raise ValueError("scaler is not fitted")
        # As many names as the table has features.
        columns = sorted(r[0] for r in self.params.select("feature").distinct().collect())
        wide = self._wide(self.params, ["median", "mad"], columns)
        return attach(df, broadcast_if_small(wide), list(self.series), "left"), columns

    def transform(self, df: DataFrame) -> DataFrame:
        rows, columns = self._with_params(df)
        scaled = {}
        for c in columns:
            apart = F.col(c).cast("double") - F.col(_named("median", c))
            value = apart / (F.col(_named("mad", c)) + EPSILON)
            scaled[c] = clip(value, -CLIP, CLIP) if self.clip_outlier else value
        return rows.withColumns(scaled).select(df.columns)

    def fit_transform(self, df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
        return self.fit(df, columns, **options).transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """``z * mad + median``; clipping is not undone."""
        rows, columns = self._with_params(df)
        back = {c: F.col(c) * F.col(_named("mad", c)) + F.col(_named("median", c)) for c in columns}
        return rows.withColumns(back).select(df.columns)

    def save(self, path: str) -> None:
        if self.params is None:
            raise ValueError("scaler is not fitted")
        flagged = self.params.withColumn("clip", F.lit(self.clip_outlier))
        flagged.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, series: Sequence[str]) -> SeriesScaler:
        saved = spark.read.parquet(path)
        first = saved.select("clip").first()
        if first is None:
            raise ValueError(f"no scaler parameters at {path}")
        return cls(series, first["clip"], saved.drop("clip"))


def _named(number: str, column: str) -> str:
    return f"__{number}_{column}"


def training_head(
    df: DataFrame,
    ratio: float,
    rows: int | None = None,
    index_col: str = ROW,
    series: Sequence[str] = (),
    lengths: DataFrame | None = None,
) -> DataFrame:
    """The first ``int(rows * ratio)`` rows by index, or all when that is none.

    With ``series`` the rows of each series count for themselves; ``lengths`` are its
    ``series_lengths`` where they are known already.
    """
    if not 0 < ratio <= 1:
        raise ValueError("ratio must lie in (0, 1]")
    if rows is not None and not series:
        head = int(rows * ratio)
        return df.filter(F.col(index_col) < head) if head > 0 else df
    if lengths is None:
        lengths = series_lengths(df, series, index_col)
    lengths = lengths.withColumn("__head", F.floor(F.col("num_rows") * F.lit(ratio)))
    rows_of = attach_by_part(df, lengths, series, index_col)
    kept = rows_of.filter((F.col(index_col) < F.col("__head")) | (F.col("__head") == 0))
    return kept.select(df.columns)
