"""A keyword index that outlives a query: stored postings, extended by new documents alone.

Layout below ``path``: ``postings/v=<batch>/bucket=<b>`` (term, doc_id, tf, n; the bucket is the term's hash), ``lengths/v=<batch>`` (doc_id, n) and
``totals/v=<batch>`` (documents, those with a text, and tokens so far), the last of which makes a batch visible. A repeated batch overwrites itself.
A document is indexed once: ids that the index has are left out, so a changed text needs a new id.

A search reads the buckets of its terms only and tokenises nothing but the queries. What is left of them is laid by document once, so scores
are summed without a further shuffle. Results are those of ``retrieval.bm25``.

Defined cases: null texts count as documents, but not in the mean length; null ids are not indexed; of repeated ids the longest text (then the first in order) counts;
an empty index gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import attach, durable, partitions_for, release
from .retrieval import B, K1, top

BUCKETS = 64
#: Query terms that are sent to every task.
FEW = 1_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, term, tf, first: a row for each term of a document (doc_id, tokens), one without a term if it has none; ``first`` marks one
    row of each document."""
    for batch in batches:
        ids, tokens = batch.column(0), batch.column(1)
        n = pc.list_value_length(tokens)
        coded = tokens.flatten().dictionary_encode()
        many = len(coded.dictionary) + 1
        of = np.repeat(np.arange(len(ids)), pc.fill_null(n, 0).to_numpy(zero_copy_only=False))
        key, tf = np.unique(of * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        bare = np.setdiff1d(np.arange(len(ids)), of)
        row, code = np.concatenate([key // many, bare]), np.concatenate([key % many, np.full(len(bare), -1)])
        first = np.zeros(len(row), bool)
        first[np.unique(row, return_index=True)[1]] = True
        term = coded.dictionary.take(pa.array(code, mask=code < 0))
        columns = [ids.take(pa.array(row)), n.take(pa.array(row)).cast("int64"), term, pa.array(np.concatenate([tf, np.zeros(len(bare), np.int64)])), pa.array(first)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "term", "tf", "first"])


class Postings:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = attach(spark), path, buckets

    def _bucket(self, term: str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _read(self, part: str, schema: str) -> DataFrame:
        last = self._totals()
        rows = self.spark.read.schema(f"{schema}, v long").parquet(f"{self.path}/{part}") if last else self.spark.createDataFrame([], f"{schema}, v long")
        return rows.where(F.col("v") <= (last["v"] if last else -1))

    def _totals(self, before: int | None = None) -> dict | None:
        try:
            rows = self.spark.read.schema("documents long, texts long, tokens long, v long").parquet(f"{self.path}/totals")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        found = rows.where(F.col("v") < before) if before is not None else rows
        last = found.agg(F.max(F.struct("v", "documents", "texts", "tokens"))).first()[0]  # a row a batch
        return None if last is None else last.asDict()

    def extend(self, docs: DataFrame, batch: int) -> int:
        """Index the documents (doc_id, text) that are new; batches come in order. Returns how many there were."""
        before = self._totals(batch)
        single = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(-F.coalesce(F.length("text"), F.lit(-1)), "text")).alias("one")).select("doc_id", F.col("one.text").alias("text"))
        if before is not None:
            known = self.spark.read.schema("doc_id long, n long, v long").parquet(f"{self.path}/lengths").where(F.col("v") <= before["v"])
            single = single.join(known.select("doc_id"), "doc_id", "left_anti")
        tokens = single.select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
        counted = durable(tokens.mapInArrow(_counted, "doc_id long, n long, term string, tf long, first boolean"))
        sized = counted.where("first").select("doc_id", "n")
        sized.write.mode("overwrite").parquet(f"{self.path}/lengths/v={batch}")
        terms = counted.where("term IS NOT NULL").select("doc_id", "n", "term", "tf", self._bucket("term").alias("bucket"))
        parts = partitions_for(counted, 32)  # a bucket is written by as many tasks as its share of the terms needs
        dealt = terms.repartition(parts, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, parts // self.buckets))))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/v={batch}")
        added = sized.agg(F.count(F.lit(1)).alias("documents"), F.count("n").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
        release(counted)
        total = tuple((before[c] if before else 0) + added[c] for c in ("documents", "texts", "tokens"))
        self.spark.createDataFrame([total], "documents long, texts long, tokens long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/v={batch}")
        return added["documents"]

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score, rank, as ``retrieval.bm25`` over all indexed documents. ``queries``: query_id, text."""
        terms = durable(queries.select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term")).distinct())
        wanted = terms.select("term").distinct()
        few = wanted.count() <= FEW
        buckets = sorted(r["bucket"] for r in wanted.select(self._bucket("term").alias("bucket")).distinct().collect())  # at most all buckets
        rows = self._read("postings", "term string, doc_id long, n long, tf long, bucket int").where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        met = durable(rows.join(F.broadcast(wanted) if few else wanted, "term", "left_semi").select("term", "doc_id", "n", "tf"))
        totals = self._totals() or {"documents": 0, "texts": 0, "tokens": 0}
        mean = totals["tokens"] / totals["texts"] if totals["tokens"] else 1.0
        found = met.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        asked = durable(terms.join(found, "term").select("query_id", "term", F.log((F.lit(float(totals["documents"])) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf")))
        share = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(float(mean))))
        weighed = met.repartition(partitions_for(met), "doc_id").join(F.broadcast(asked) if few else asked, "term").select("query_id", "doc_id", share.alias("share"))
        scored = weighed.groupBy("query_id", "doc_id").agg(F.round(F.sum("share"), 6).alias("score"))
        return top(scored.where("score > 0"), "query_id", [F.desc("score"), F.asc("doc_id")], k)
