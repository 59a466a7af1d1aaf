"""The last rows of every series, kept between micro-batches.

Tails lie in a fixed number of buckets by a hash of the series. ``<batch>/bucket=<b>``
holds what bucket ``b`` held after that batch. A batch writes a new version of the
buckets it touches and leaves the others where they are, so its cost follows the
series that arrive and not those ever seen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from driftwalk.staging import folders_in, remove

BUCKET = "bucket__"


class TailStore:
    """Versions of tail buckets under ``path``; at most two are kept of each."""

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        if buckets < 1:
            raise ValueError("a store needs a bucket")
        self.spark, self.path, self.buckets = spark, path, buckets

    def bucket_of(self, series: Sequence[str]) -> Column:
        """Bucket of a row; a null in the series counts as a value."""
        known = [c for s in series for c in (F.col(s), F.col(s).isNull())]
        return F.pmod(F.xxhash64(F.lit(0), *known), F.lit(self.buckets)).cast("int")

    def touched(self, batch: DataFrame, series: Sequence[str]) -> list[int]:
        """Buckets that rows of the batch fall into, at most as many as there are."""
        found = batch.select(self.bucket_of(series).alias(BUCKET)).distinct().collect()
        return sorted(r[0] for r in found)

    def versions(self) -> dict[int, list[int]]:
        """Batches that wrote each bucket, oldest first."""
        found: dict[int, list[int]] = {}
        for batch in sorted(int(name) for name in folders_in(self.spark, self.path)):
            for name in folders_in(self.spark, f"{self.path}/{batch}"):
                if name.startswith(f"{BUCKET}="):
                    found.setdefault(int(name.split("=")[1]), []).append(batch)
        return found

    def _folder(self, batch: int, bucket: int) -> str:
        return f"{self.path}/{batch}/{BUCKET}={bucket}"

    def read(self, schema: StructType, buckets: Iterable[int], before: int) -> DataFrame | None:
        """Rows of the buckets as they were before a batch; None where nothing was."""
        versions = self.versions()
        paths = []
        for bucket in buckets:
            earlier = [b for b in versions.get(bucket, []) if b < before]
            if earlier:
                paths.append(self._folder(earlier[-1], bucket))
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def replace(
        self, rows: DataFrame, series: Sequence[str], buckets: Iterable[int], batch: int
    ) -> None:
        """Write the buckets as they are after a batch; drop versions nothing reads.

        The version before stays for a batch that is run again. A bucket is one file:
        take as many buckets as keep that small.
        """
        placed = rows.withColumn(BUCKET, self.bucket_of(series))
        placed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(
            f"{self.path}/{batch}"
        )
        versions = self.versions()
        for bucket in buckets:
            earlier = [b for b in versions.get(bucket, []) if b < batch]
            for old in earlier[:-1]:
                remove(self.spark, self._folder(old, bucket))
        live = {b for found in self.versions().values() for b in found}
        for old in folders_in(self.spark, self.path):
            if int(old) < batch and int(old) not in live:
                remove(self.spark, f"{self.path}/{old}")
