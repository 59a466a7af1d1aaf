"""Nearest neighbours by a block matrix join of int8 codes.

Vectors are scaled to length one and rounded to int8, with the exact length of the
rounding error beside them. Blocks of queries meet blocks of candidates; a tile's
integer products give every similarity with a bound of its error. Only candidates
whose upper bound reaches the k-th best lower bound of a query survive; heaps merge
them over the tiles of a task, a ranked window over tasks, and the survivors' cosines
are computed from the original vectors. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftwalk.llm.base import column, read, register
from driftwalk.staging import stage

NEAREST = 5
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
# Covers rounding in the bounds themselves, far below the error of the codes.
SLACK = 1e-6

_BLOCK = "ids binary, codes binary, scales binary, errors binary"


def _quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error lengths of vectors brought to length one."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scales = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scales[:, None])
    rest = unit - codes * scales[:, None]
    return codes.astype(np.int8), scales, np.sqrt((rest * rest).sum(axis=1))


def _packed(ids: Column, vectors: Column) -> Column:
    """A block of ids and equally long vectors as binary matrices."""

    def batches(blocks: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for each_ids, each_vectors in blocks:
            rows = []
            for one, many in zip(each_ids, each_vectors):
                flat = many.values.flatten().to_numpy(zero_copy_only=False)
                codes, scales, errors = _quantised(
                    flat.reshape(len(one.values), -1).astype(np.float64)
                )
                rows.append(
                    {
                        "ids": one.values.to_numpy(zero_copy_only=False).tobytes(),
                        "codes": codes.tobytes(),
                        "scales": scales.tobytes(),
                        "errors": errors.tobytes(),
                    }
                )
            kind = pa.struct([(n, pa.binary()) for n in ("ids", "codes", "scales", "errors")])
            yield pa.array(rows, kind)

    return F.arrow_udf(batches, _BLOCK)(ids, vectors)


def _blocks(rows: DataFrame, size: int, prefix: str) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows by a hash of the id, and blocks per dimension."""
    most = rows.groupBy("dim").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // size))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    grouped = rows.groupBy("dim", part.alias(f"{prefix}_part")).agg(
        F.collect_list("id").alias("ids"), F.collect_list("vector").alias("vectors")
    )
    block = _packed(F.col("ids"), F.col("vectors")).alias(prefix)
    return grouped.select("dim", f"{prefix}_part", block), parts


def _survivors(k: int):
    """Over a task's tiles in order of their queries: (query, candidate, lower, upper)."""

    def unpacked(block: dict) -> tuple[np.ndarray, ...]:
        ids = np.frombuffer(block["ids"], np.int64)
        codes = np.frombuffer(block["codes"], np.int8).reshape(len(ids), -1)
        return (
            ids,
            codes.astype(np.float64 if codes.shape[1] > 1000 else np.float32),
            np.frombuffer(block["scales"]),
            np.frombuffer(block["errors"]),
        )

    def flushed(queries, heaps, found) -> pa.RecordBatch:
        rows = [
            (query, one, low, high)
            for query, best, some in zip(queries, heaps, found)
            for low, high, one in some
            if len(best) < k or high >= best[0]
        ]
        columns = list(zip(*rows)) if rows else [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)],
            ["query_id", "vec_id", "lower", "upper"],
        )

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, heaps, found = None, (), [], []
        for batch in batches:
            for tile in batch.to_pylist():
                key = (tile["dim"], tile["query_part"])
                if key != at:
                    if at is not None:
                        yield flushed(queries, heaps, found)
                    at = key
                    queries, q_codes, q_scales, q_errors = unpacked(tile["query"])
                    heaps, found = [[] for _ in queries], [[] for _ in queries]
                ids, codes, scales, errors = unpacked(tile["candidate"])
                products = (q_codes @ codes.T) * np.outer(q_scales, scales)
                e, f = q_errors[:, None], errors[None, :]
                bound = e * (1 + f) + f * (1 + e) + e * f + SLACK
                lower = products - bound
                lower[queries[:, None] == ids[None, :]] = -np.inf
                upper = np.where(np.isinf(lower), -np.inf, products + bound)
                if len(ids) > k:
                    least = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k]
                else:
                    least = np.full(len(queries), -np.inf)
                floor = [best[0] if len(best) == k else -np.inf for best in heaps]
                least = np.maximum(least, floor)
                for q, c in zip(*np.nonzero((upper >= least[:, None]) & np.isfinite(upper))):
                    low, best = lower[q, c], heaps[q]
                    found[q].append((low, upper[q, c], ids[c]))
                    if len(best) < k:
                        heapq.heappush(best, low)
                    elif low > best[0]:
                        heapq.heapreplace(best, low)
                for q, some in enumerate(found):
                    if len(some) > 8 * k:
                        found[q] = [x for x in some if x[1] >= heaps[q][0]]
        if at is not None:
            yield flushed(queries, heaps, found)

    return tiles


def _usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    return (
        vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )


def _scaled(vector: Column) -> Column:
    """Doubles divided by a power of two where squares would leave the double range."""
    largest = F.aggregate(vector, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    by = F.when(
        (largest > 1e100) | (largest < 1e-100), F.pow(F.lit(2.0), F.floor(F.log2(largest)))
    ).otherwise(F.lit(1.0))
    return F.transform(vector, lambda x: x / by)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = NEAREST,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The ``k`` candidates of largest cosine for every query, all compared.

    Result: query_id, rank (from 1), vec_id, score; equal scores by smaller id; fewer
    than ``k`` rows where there are fewer candidates. Null ids, null or zero vectors
    and those with null or non-finite components take no part. Rows of one id are one
    item with the least of their vectors; an item is no neighbour of itself. Vectors
    of different lengths are never compared. Of equal vectors only the ``k + 1``
    smallest ids can be among the nearest, so only these become candidates. Empty
    tables give an empty table.
    """

    def items(rows: DataFrame) -> DataFrame:
        numbers = column(vector).cast("array<double>")
        chosen = rows.select(column(vec_id).cast("long").alias("id"), numbers.alias("vector"))
        chosen = chosen.where(F.col("id").isNotNull() & _usable(F.col("vector")))
        chosen = chosen.groupBy("id").agg(F.min("vector").alias("vector"))
        return chosen.select("id", _scaled(F.col("vector")).alias("vector"), F.size("vector").alias("dim"))

    every, asked = items(vectors), items(queries)
    copies = Window.partitionBy("vector").orderBy("id")
    candidates = every.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    q_blocks, q_parts = _blocks(asked, QUERY_BLOCK, "query")
    c_blocks, c_parts = _blocks(candidates.drop("copy"), CANDIDATE_BLOCK, "candidate")
    keys = ["dim", "query_part", "candidate_part"]
    tiles = q_blocks.withColumn(
        "candidate_part", F.explode(F.sequence(F.lit(0), F.lit(c_parts - 1)))
    ).join(
        c_blocks.withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1)))), keys
    )
    found = tiles.sortWithinPartitions("dim", "query_part").mapInArrow(
        _survivors(k), "query_id long, vec_id long, lower double, upper double"
    )
    found = stage(found, "survivors")  # read twice below
    # The k-th best lower bound over all tasks; what cannot reach it goes.
    by_lower = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    floors = (
        found.withColumn("place", F.row_number().over(by_lower))
        .where(F.col("place") <= k)
        .groupBy("query_id")
        .agg(F.when(F.count("*") == k, F.min("lower")).alias("floor"))
    )
    pairs = found.join(floors, "query_id").where(
        F.col("floor").isNull() | (F.col("upper") >= F.col("floor"))
    )
    left = asked.select(F.col("id").alias("query_id"), F.col("vector").alias("a"))
    right = every.select(F.col("id").alias("vec_id"), F.col("vector").alias("b"))
    lengths = F.sqrt(_dot(F.col("a"), F.col("a"))) * F.sqrt(_dot(F.col("b"), F.col("b")))
    scored = (
        pairs.select("query_id", "vec_id")
        .join(left, "query_id")
        .join(right, "vec_id")
        .select("query_id", "vec_id", (_dot(F.col("a"), F.col("b")) / lengths).alias("score"))
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        scored.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"


@register(
    "op5_nearest_neighbours",
    f"""
WITH items AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
),
lengths AS (SELECT vec_id, v, sqrt({_DOT.format("v", "v")}) AS n FROM items),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, {_DOT.format("q.v", "c.v")} / (q.n * c.n) AS score
  FROM lengths q JOIN lengths c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 AND q.n > 0 AND c.n > 0
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
    AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {NEAREST}
""",
)
def op5_nearest_neighbours(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))
