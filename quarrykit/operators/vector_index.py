"""A vector index that outlives a query: stored inverted lists under centres of two levels, read through partition pruning.

Layout below ``path``: ``centres`` (list, cell, centre), ``rows/v=<batch>/cell=<c>`` (list, id, embedding), each cell's files in order of the list.
Lists are as many as the root of the number of vectors (32 to 16,384), so they grow in number with the table; their centres are fitted in two
levels, cells first and then the lists of each cell, on a sample of at most ``SAMPLE`` vectors, or ``A_LIST`` a list where that is
more, drawn by a hash of the id. Every vector is indexed, under the nearest list; ``extend`` adds vectors to the lists there are.

A query scores the ``probes`` lists of the nearest centres exactly. Their number is set when the index is built, so that the sample's own
neighbours are found at ``recall``: few on clustered vectors, most of them where there is no structure. Only the files of probed cells are
read, and of those the row groups of probed lists. A list of more than ``BLOCK`` vectors is met in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach, durable
from .neighbors import BLOCK, best_of_blocks, drawn, kmeans, matrix, ranked, unit, upto

SAMPLE, A_LIST, MOST_LISTS, RECALL = 5000, 8, 1 << 14, 0.94


def two_levels(x: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres of about ``lists`` lists and each one's cell."""
    cells = kmeans(x, max(1, round(lists**0.5)))
    near = (x @ cells.T).argmax(axis=1)
    centres, owner = [], []
    for c in range(len(cells)):
        own = x[near == c]
        if len(own):
            found = kmeans(own, max(1, round(lists * len(own) / len(x))))
            centres.append(found)
            owner += [c] * len(found)
    return np.concatenate(centres), np.array(owner)


def probes_for(x: np.ndarray, centres: np.ndarray, place: np.ndarray, k: int, recall: float, queries: int = 300) -> int:
    """Lists to look into so that the share ``recall`` of the sample's own k nearest neighbours lies in them."""
    if len(x) <= k:
        return len(centres)
    q = x[np.random.default_rng(5).choice(len(x), min(queries, len(x)), replace=False)]
    found = np.argsort(-(q @ x.T), axis=1)[:, 1 : k + 1]  # the first is the query itself
    rank = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)
    return int(np.quantile(np.take_along_axis(rank, place[found], axis=1), recall, method="higher")) + 1


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = attach(spark), path
        rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["list"])  # at most MOST_LISTS
        self.centres, self.cells = np.array([r["centre"] for r in rows]), np.array([r["cell"] for r in rows])
        self.probes = rows[0]["probes"]

    @staticmethod
    def build(vectors: DataFrame, path: str, k: int = 10, recall: float = RECALL, lists: int | None = None) -> VectorIndex:
        """Index all of ``vectors`` (vec_id, embedding); ``k`` and ``recall`` set the number of lists that queries look into."""
        kept = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
        total = kept.count()
        lists = lists or max(32, min(MOST_LISTS, int(total**0.5)))
        x = unit(drawn(kept, total, max(SAMPLE, A_LIST * lists)))[0] if total else np.zeros((1, 1))
        centres, owner = two_levels(x, lists)
        probes = probes_for(x, centres, _places(x, centres), k, recall)
        rows = [(i, int(c), [float(v) for v in centre], probes) for i, (c, centre) in enumerate(zip(owner, centres, strict=True))]
        vectors.sparkSession.createDataFrame(rows, "list int, cell int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")
        index = VectorIndex(vectors.sparkSession, path)
        index.extend(vectors, 0)
        return index

    def extend(self, vectors: DataFrame, batch: int) -> None:
        """Add vectors to the lists there are; a repeated batch overwrites itself."""
        centres, cells = self.centres, self.cells

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):
                    place = _places(unit(matrix(part.column(1)))[0], centres)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(place, pa.int32()), pa.array(cells[place], pa.int32())], ["id", "embedding", "list", "cell"])

        rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>")).where("embedding IS NOT NULL")
        placed = rows.mapInArrow(assign, "id long, embedding array<float>, list int, cell int")
        placed.repartition("cell", "list").sortWithinPartitions("cell", "list", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows/v={batch}")

    def rows(self) -> DataFrame:
        return self.spark.read.schema("id long, embedding array<float>, list int, v long, cell int").parquet(f"{self.path}/rows")

    def probed(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """id, embedding, block (a list to look into) of each query."""
        many, centres = probes or self.probes, self.centres

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                    near = np.argsort(-(unit(matrix(part.column(1)))[0] @ centres.T), axis=1, kind="stable")[:, :many]
                    at = pa.array(np.repeat(np.arange(part.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(near.ravel(), pa.int64())], ["id", "embedding", "block"])

        rows = queries.select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<float>"))
        return rows.mapInArrow(nearest, "id long, embedding array<float>, block long")

    def members(self, lists: list[int]) -> DataFrame:
        """The indexed vectors of these lists: other cells' files are never opened, other lists' row groups skipped."""
        cells = sorted({int(self.cells[i]) for i in lists})
        return self.rows().where(F.col("cell").isin(cells)).where(F.col("list").isin(lists)) if lists else self.rows().limit(0)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, vec_id, score, rank. ``queries``: query_id, embedding."""
        asked = durable(self.probed(queries, probes))
        lists = sorted(r["block"] for r in asked.select("block").distinct().collect())  # at most MOST_LISTS
        sizes = durable(self.members(lists).groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts")))
        parts = F.broadcast(sizes.select(F.col("list").cast("long").alias("block"), "parts"))  # at most MOST_LISTS rows
        q = asked.join(parts, "block").select("id", "embedding", F.lit(0).alias("side"), "block", F.explode(upto(F.col("parts"))).alias("part"))
        v = self.members(lists).withColumn("block", F.col("list").cast("long")).join(parts, "block").select("id", "embedding", F.lit(1).alias("side"), "block", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
        return ranked(best_of_blocks(q.unionByName(v), k, None), k)


def _places(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest list to each vector."""
    return (x @ centres.T).argmax(axis=1)
