"""Shards by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size. In turns,
shards claim the next free slot of their permutation until all slots are taken. A
row's key hashes to a slot and the slot names the shard: one lookup per row, shards
of near equal size, and few rows move when a shard joins or leaves.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from driftwalk.llm.base import HELPER, column, read, register, text_or_empty

SHARDS = 64
SLOTS = 65_537  # prime
MAX_SLOTS = 1_000_003  # the table is broadcast, so its size has a bound


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that holds each slot.

    Shard k prefers slots offset, offset + skip, ... (mod ``slots``), both from
    hashes of its name; as ``slots`` is prime that is a permutation.
    """
    if not _is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}, not {slots}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards need distinct names, no more than there are slots")
    at = [_number(f"offset {name}") % slots for name in shards]
    skip = [_number(f"skip {name}") % (slots - 1) + 1 for name in shards]
    table, left = [-1] * slots, slots
    while True:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % slots
            table[at[shard]] = shard
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a string key: 60 bits of its md5, modulo the table size."""
    return F.pmod(
        F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(slots)
    ).cast("int")


def place_rows(
    rows: DataFrame,
    shards: list[str],
    key: str = "doc_id",
    fallback: str = "text",
    slots: int = SLOTS,
) -> DataFrame:
    """``rows`` with ``slot``, ``shard`` (its number) and ``shard_name``.

    Rows of equal keys share a shard. A row whose key is null is placed by its
    ``fallback`` column instead, so that missing keys do not meet in one shard; if
    that is null too, by the empty text. An empty table stays empty. The broadcast
    table has ``slots`` rows, at most ``MAX_SLOTS``.
    """
    spark, at = rows.sparkSession, f"{HELPER}slot"
    table = spark.createDataFrame(
        [(slot, shard, shards[shard]) for slot, shard in enumerate(lookup_table(shards, slots))],
        f"{at} int, shard int, shard_name string",
    )
    by = F.coalesce(column(key).cast("string"), text_or_empty(fallback))
    placed = rows.drop("shard", "shard_name").withColumn(at, slot_of(by, slots))
    return placed.join(F.broadcast(table), at).withColumn("slot", F.col(at)).drop(at)


def write_shards(placed: DataFrame, path: str) -> None:
    """Write placed rows as Parquet, a folder per shard.

    Rows are not moved: each task adds its rows to the folder of every shard it
    holds rows of, so a large shard is no single task's work.
    """
    placed.write.partitionBy("shard").parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


@register("op10_sharding")
def op10_sharding(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return place_rows(docs, shard_names()).select("doc_id", "slot", "shard", "shard_name")
