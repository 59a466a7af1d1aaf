"""The high-pass filter and the trend labels on streams.

Two ways, equal to the batch operators row by row, null and NaN included.
``stream_filter`` and ``stream_labels`` keep a few numbers per series as keyed
state: right for many series. ``FilteredBatches`` and ``LabelledBatches`` run the
batch operator on every micro-batch together with the stored tails of its series:
right when a few series carry much of the stream, since the batch operator splits
a series into parts.

Rows of one micro-batch may come in any order; across micro-batches a series
must arrive in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from driftwalk.operators.joins import attach, broadcast_if_small
from driftwalk.operators.labels import trend_labels
from driftwalk.operators.ordering import PART_ROWS, ROW, index_rows
from driftwalk.operators.recurrence import HighPass, high_pass_filter
from driftwalk.staging import new_path, remove
from driftwalk.streaming.tails import TailStore

PRICE, MISSING = "__price", "__missing"

STATE_SCHEMA = (
    "seen bigint, x1 double, x2 double, even double, odd double, "
    "even_before double, odd_before double, waiting array<double>"
)


@dataclass(frozen=True)
class FilterState:
    """What the filter remembers of a series.

    The rows seen, the last two inputs (0 for a null), and the two running sums of the
    block and of the block before: the same sums over the same blocks of rows as in the
    batch operator, so that a NaN ends where it ends there.
    """

    seen: int = 0
    x1: float = 0.0
    x2: float = 0.0
    even: float = 0.0
    odd: float = 0.0
    even_before: float = 0.0
    odd_before: float = 0.0


def advance(
    shape: HighPass, prices: np.ndarray, state: FilterState, missing: np.ndarray | None = None
) -> tuple[np.ndarray, FilterState]:
    """Residuals of the next prices, and the state after them.

    ``missing`` marks null prices, whose residuals mean nothing.
    """
    if missing is None:
        missing = np.zeros(len(prices), dtype=bool)
    residuals = np.empty(len(prices))
    start = 0
    while start < len(prices):
        stop = start + shape.block_rows - state.seen % shape.block_rows
        block = slice(start, stop)
        residuals[block], state = _within_block(shape, prices[block], missing[block], state)
        start = stop
    return residuals, state


def _within_block(
    shape: HighPass, prices: np.ndarray, missing: np.ndarray, state: FilterState
) -> tuple[np.ndarray, FilterState]:
    w, rows = shape.rate, shape.block_rows
    if state.seen % rows == 0:
        state = replace(
            state, even=0.0, odd=0.0, even_before=state.even, odd_before=state.odd
        )
    x = np.where(missing, 0.0, prices)
    steps = state.seen % rows + np.arange(len(x))
    past = np.concatenate([[state.x2, state.x1], x])
    bend = np.where(missing, 0.0, past[2:] - 2 * past[1:-1] + past[:-2])
    growth = np.exp(w * steps)
    even = np.cumsum(np.concatenate([[state.even], growth * np.cos(w * steps) * bend]))
    odd = np.cumsum(np.concatenate([[state.odd], growth * np.sin(w * steps) * bend]))

    def response(ages: np.ndarray, evens, odds) -> np.ndarray:
        turn = w * (ages + 1)
        return np.exp(-w * ages) * (np.sin(turn) * evens - np.cos(turn) * odds)

    both = response(steps, even[1:], odd[1:])
    both = both + response(steps + rows, state.even_before, state.odd_before)
    after = replace(
        state,
        seen=state.seen + len(x),
        x1=float(past[-1]),
        x2=float(past[-2]),
        even=float(even[-1]),
        odd=float(odd[-1]),
    )
    return both * (shape.coefficients[0] / math.sin(w)), after


def _key_fields(stream: DataFrame, series: Sequence[str]) -> StructType:
    return StructType([stream.schema[c] for c in series])


def _doubles(values: np.ndarray, missing: np.ndarray) -> pd.Series:
    """A column in which null and NaN stay apart."""
    return pd.Series(pd.arrays.FloatingArray(values, missing))


def _stateful(stream: DataFrame, series, order, price, shape, shift, output: StructType) -> DataFrame:
    series, order = list(series), list(order)

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *numbers, waiting = state.get if state.exists else (*astuple(FilterState()), [])
        before = FilterState(*numbers)
        # One series' share of a micro-batch, which the trigger bounds: order and price.
        rows = pd.concat(list(frames)).sort_values(order, ignore_index=True)
        prices = rows[PRICE].to_numpy(dtype=np.float64)
        missing = rows[MISSING].to_numpy(dtype=bool)
        with np.errstate(invalid="ignore", over="ignore"):
            residuals, after = advance(shape, prices, before, missing)
            filtered = prices - residuals
        if shift is None:
            out = rows[order].assign(
                row_idx=before.seen + np.arange(len(rows)),
                filtered_price=_doubles(filtered, missing),
                residual=_doubles(residuals, missing),
            )
            waiting = []
        else:
            # Prices whose label needs a later row wait in the state, nulls as None.
            first = before.seen - len(waiting)
            absent = np.concatenate([[p is None for p in waiting], missing]).astype(bool)
            held = np.array([math.nan if p is None else p for p in waiting], dtype=np.float64)
            held = np.concatenate([held, prices])
            ready = max(len(held) - shift, 0)
            tail = slice(len(filtered) - ready, None)
            ahead, unknown = filtered[tail], missing[tail]
            current, void = held[:ready], absent[:ready]
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                label = (ahead - current) / current
            out = pd.DataFrame(
                {
                    "row_idx": first + np.arange(ready),
                    "price": _doubles(current, void),
                    "future_filtered_price": _doubles(ahead, unknown),
                    "l_value": _doubles(label, void | unknown | (current == 0)),
                }
            )
            left = zip(held[ready:], absent[ready:])
            waiting = [None if gone else float(p) for p, gone in left]
        state.update((*astuple(after), waiting))
        for name, value in zip(series, key):
            out.insert(0, name, value)
        if len(out):
            yield out[[f.name for f in output]]

    value = F.col(price).cast("double")
    kept = stream.select(*series, *order, value.alias(PRICE), value.isNull().alias(MISSING))
    return kept.groupBy(*series).applyInPandasWithState(
        handle, output, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def stream_filter(
    stream: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    price: str,
    filter_length: float = 10.0,
) -> DataFrame:
    """Filtered price and residual of every arriving row."""
    output = _key_fields(stream, [*series, *order])
    output = output.add(ROW, "long").add("filtered_price", "double").add("residual", "double")
    return _stateful(stream, series, order, price, HighPass(filter_length), None, output)


def stream_labels(
    stream: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    price: str,
    filter_length: float = 10.0,
    shift_length: int = 10,
) -> DataFrame:
    """The label of a row, once its row ``shift_length`` ahead has arrived."""
    if shift_length < 0:
        raise ValueError("shift length must not be negative")
    output = _key_fields(stream, series).add(ROW, "long").add("price", "double")
    output = output.add("future_filtered_price", "double").add("l_value", "double")
    return _stateful(stream, series, order, price, HighPass(filter_length), shift_length, output)


@dataclass
class _TailedBatches:
    """Micro-batches joined to the stored tail of their series.

    The tails lie in ``buckets`` folders by a hash of the series (the number must stay
    the same as long as the stream lives). A micro-batch reads and replaces only the
    buckets its series fall into. A batch run again after a failure reads the tails of
    before it and overwrites what it wrote, so results do not change.
    """

    path: str
    series: Sequence[str]
    order: Sequence[str]
    price: str
    filter_length: float = 10.0
    part_rows: int = field(default=PART_ROWS, kw_only=True)
    buckets: int = field(default=64, kw_only=True)

    @property
    def tail_rows(self) -> int:
        return HighPass(self.filter_length).warm_up

    def _numbered(self, batch: DataFrame) -> DataFrame:
        keys = list(self.series)
        rows = batch.select(*keys, *self.order, F.col(self.price).cast("double").alias("price"))
        return index_rows(rows, self.order, keys)

    def _with_tails(self, rows: DataFrame, tail: DataFrame | None) -> DataFrame:
        """New rows numbered on from the tails, and the tails; ``length`` is the rows
        that were known of a series before."""
        none = F.lit(0).cast("bigint")
        if tail is None:
            return rows.withColumn("length", none)
        keys = list(self.series)
        ends = broadcast_if_small(tail.groupBy(*keys).agg((F.max(ROW) + 1).alias("length")))
        moved = attach(rows, ends, keys, "left")
        moved = moved.withColumn(ROW, F.col(ROW) + F.coalesce("length", none)).drop("length")
        known = attach(tail.unionByName(moved, allowMissingColumns=True), ends, keys, "left")
        return known.withColumn("length", F.coalesce("length", none))

    def _results(self, known: DataFrame) -> DataFrame:
        """Rows of this batch's result, from the ``known`` rows with ``length``."""
        raise NotImplementedError

    def _ends(self, known: DataFrame) -> DataFrame:
        return broadcast_if_small(known.groupBy(*self.series).agg(F.max(ROW).alias("last")))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        keys, spark = list(self.series), batch.sparkSession
        store = TailStore(spark, f"{self.path}/tail", self.buckets)
        rows = self._numbered(batch)
        schema = rows.select(*keys, ROW, "price").schema
        touched = store.touched(batch.select(*keys), keys)
        tail = store.read(schema, touched, batch_id)
        place = new_path(spark, "batch")
        joined = self._with_tails(rows, tail)
        joined.write.parquet(place)
        known = spark.read.schema(joined.schema).parquet(place)
        results = self._results(known)
        results.write.mode("overwrite").parquet(f"{self.path}/{self.folder}/{batch_id}")
        kept = attach(known, self._ends(known), keys)
        kept = kept.filter(F.col(ROW) > F.col("last") - self.tail_rows)
        store.replace(kept.select(*keys, ROW, "price"), keys, touched, batch_id)
        remove(spark, place)


@dataclass
class FilteredBatches(_TailedBatches):
    """``foreachBatch`` writer that filters micro-batches with the batch operator.

    Writes the filtered price and the residual of every arriving row to a folder
    ``filtered`` named after the batch.
    """

    folder = "filtered"

    def _results(self, known: DataFrame) -> DataFrame:
        found = high_pass_filter(
            known, "price", self.filter_length, list(self.series), residual="residual", part_rows=self.part_rows
        )
        new = found.filter(F.col(ROW) >= F.col("length"))
        return new.select(*self.series, *self.order, ROW, "filtered_price", "residual")


@dataclass
class LabelledBatches(_TailedBatches):
    """``foreachBatch`` writer that labels micro-batches with the batch operator.

    Writes the rows that got their label to a folder ``labels`` named after the batch.
    """

    shift_length: int = 10
    folder = "labels"

    @property
    def tail_rows(self) -> int:
        return HighPass(self.filter_length).warm_up + self.shift_length

    def _results(self, known: DataFrame) -> DataFrame:
        keys = list(self.series)
        known = attach(known, self._ends(known), keys)
        labelled = trend_labels(
            known, "price", self.filter_length, self.shift_length, keys, part_rows=self.part_rows
        )
        reached = F.col(ROW) + self.shift_length <= F.col("last")
        done = reached & (F.col(ROW) >= F.col("length") - self.shift_length)
        out = labelled.filter(done)
        return out.select(*keys, ROW, "price", "future_filtered_price", "l_value")
