"""Connected components of a link table, by star contraction on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftwalk.staging import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u and all its neighbours in ``edges``.

    The least is summed before it moves and joined back, so that a node with very
    many neighbours is split like any other skewed join key.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("w"))
    least = least.select("u", F.least("u", "w").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node it knows."""
    found = _with_least(_both_ways(edges)).where(F.col("v") > F.col("u"))
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down)
    links = found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
        found.select("u", F.col("m").alias("v"))
    )
    return links.where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (u long, v long): the least reachable.

    Links to itself and repeated links change nothing; an empty table gives an empty
    one. Rounds double the reach of a node, and each round's edges are written to the
    shared folder, so a lost executor costs the current round only.
    """
    edges = stage(links.where("u <> v").select("u", "v").distinct(), "links")
    before = None
    while True:
        now = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("print"),
        ).first()
        if now == before or not now["n"]:
            break
        before = now
        edges = stage(_small_star(_large_star(edges)), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
