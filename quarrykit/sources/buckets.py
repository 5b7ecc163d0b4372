"""Live tables in hash buckets: an upsert rewrites the buckets that its keys fall into, and nothing else.

A table is a folder with ``data/v=<batch>/bucket=<b>`` (rows of a bucket as that batch left it) and ``manifest/v=<batch>`` (for every
bucket the batch that wrote it last). A batch first writes its buckets, then its manifest, which makes it visible. It starts from the latest
manifest of an earlier batch, so a repeated batch overwrites its own output and nothing else, and batch ids may have gaps. All
access goes through Spark's readers and writers, so the folder may lie in any store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, release

BUCKETS = 256


@dataclass(frozen=True)
class Live:
    """``schema``: DDL of the rows; ``key``: the column whose hash chooses the bucket. A key is unique in the table."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    buckets: int = BUCKETS

    def bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(self.buckets)).cast("int")

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """{bucket: the batch that wrote it} as of the last batch (before ``before``); at most a row a bucket reaches the driver."""
        if not self.exists():
            return {}
        rows = self.spark.read.schema("bucket int, written long, v long").parquet(f"{self.path}/manifest")
        rows = rows if before is None else rows.where(F.col("v") < before)
        last = rows.agg(F.max("v")).first()[0]
        return {} if last is None else {r["bucket"]: r["written"] for r in rows.where(F.col("v") == last).collect()}

    def _rows(self, written: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(written.items())]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def exists(self) -> bool:
        try:
            self.spark.read.schema("v long").parquet(f"{self.path}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def read(self, before: int | None = None) -> DataFrame:
        return self._rows(self.manifest(before))

    def upsert(self, changes: DataFrame, batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame], also: Iterable[int] = ()) -> list[int]:
        """Replace the buckets of the changes' keys by ``merge`` (their rows so far, the changes); returns these buckets.

        The buckets ``also`` are rewritten as well (as in a sweep). ``merge`` must keep every row whose key it does not mean to change. Rows that it leaves out are gone.
        """
        kept = durable(changes.withColumn("bucket", self.bucket()))
        touched = sorted(r["bucket"] for r in kept.select("bucket").distinct().collect())  # at most one row a bucket
        known = self.manifest(batch)
        touched = sorted({*touched, *(b for b in also if b in known)})
        if touched:
            old = self._rows({b: known[b] for b in touched if b in known})
            new = merge(old, kept.drop("bucket")).select(*old.columns)
            new.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={batch}")
            filled = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/data/v={batch}").select("bucket").distinct()
            known = {b: v for b, v in known.items() if b not in touched} | {r["bucket"]: batch for r in filled.collect()}
        release(kept)
        rows = self.spark.createDataFrame(sorted(known.items()), "bucket int, written long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={batch}")  # a row a bucket
        return touched


def replaced(key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Merge: changed rows replace those of their key, new ones are added."""
    return lambda old, changes: old.join(changes.select(key), key, "left_anti").unionByName(changes)


def replaced_or_removed(key: str, removed: str = "removed") -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The same, and changes whose column ``removed`` is true take their row away."""
    return lambda old, changes: old.join(changes.select(key), key, "left_anti").unionByName(changes.where(~F.col(removed)).drop(removed))
