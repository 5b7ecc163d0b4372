"""Keyword and vector retrieval for tables of queries: BM25, exact and approximate nearest neighbours, fusion, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import durable, partitions_for, scratch
from .neighbors import knn, similar_best, similar_links, similar_pairs  # noqa: F401
from .vector_index import RECALL, VectorIndex

K1, B, RRF = 1.5, 0.75, 60
#: Query terms that are sent to every task.
FEW = 1_000_000
MIN_CONFIDENCE, MAX_SOURCES, SATURATION, EXCERPT = 0.35, 3, 5.0, 300


def top(df: DataFrame, group: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group (Spark keeps k per task before the shuffle: window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank. ``queries``: query_id, text; ``docs``: doc_id, text.

    Documents are tokenised once: their postings are cut down to the queries' terms before any shuffle of them, and what is left of a
    document (no term) carries the statistics, which cover all documents. Postings then lie by document, so scores need no shuffle.
    """
    terms = durable(queries.select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term")))
    few = terms.count() <= FEW
    wanted = terms.select("term").distinct().withColumn("known", F.lit(True))
    tokens = docs.select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    words = tokens.select("doc_id", F.size("tokens").alias("n"), F.posexplode_outer("tokens").alias("at", "term")).join(F.broadcast(wanted) if few else wanted, "term", "left")
    kept = words.groupBy("doc_id", "n", F.when(F.col("known"), F.col("term")).alias("term"))
    postings = durable(kept.agg(F.count(F.lit(1)).alias("tf"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("rows")))
    sized = F.when(F.col("n").isNotNull(), F.col("rows"))
    stats = postings.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"), (F.sum(F.col("n") * F.col("rows")) / F.nullif(F.sum(sized), F.lit(0))).alias("mean"))
    postings = postings.where("term IS NOT NULL").drop("rows")
    asked = terms.join(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
    weighed = postings.repartition(partitions_for(postings), "doc_id").join(F.broadcast(asked) if few else asked, "term").crossJoin(F.broadcast(stats))  # one row of totals
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    idf = F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / mean))
    scored = weighed.select("query_id", "doc_id", part.alias("part")).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return top(scored.where("score > 0"), "query_id", [F.desc("score"), F.asc("doc_id")], k)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; of unit vectors, the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ann(queries: DataFrame, vectors: DataFrame, k: int, lists: int | None = None, probes: int | None = None, recall: float = RECALL) -> DataFrame:
    """Approximate ``knn``: an index of all vectors is stored in the session's folder and searched once (``vector_index`` keeps one for longer)."""
    return VectorIndex.build(vectors, scratch(vectors.sparkSession, "index"), k, recall, lists).search(queries, k, probes)


def fuse(keyword: DataFrame, semantic: DataFrame, k: int, constant: int = RRF) -> DataFrame:
    """query_id, doc_id, score, semantic_score, keyword_score, rank by reciprocal rank fusion; ties as in the semantic list, then the keyword list."""
    s = semantic.select("query_id", "doc_id", "rank", F.lit(0).alias("list"), F.col("score").alias("semantic_score"), F.lit(None).cast("double").alias("keyword_score"))
    w = keyword.select("query_id", "doc_id", "rank", F.lit(1).alias("list"), F.lit(None).cast("double").alias("semantic_score"), F.col("score").alias("keyword_score"))
    fused = s.unionByName(w).groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"),
        F.max("semantic_score").alias("semantic_score"),
        F.max("keyword_score").alias("keyword_score"),
        F.min(F.struct("list", "rank")).alias("first"),
    )
    return top(fused, "query_id", [F.desc("score"), F.asc("first")], k).drop("first")


def search(queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, vectors: DataFrame, k: int, mode: str = "hybrid") -> DataFrame:
    """keyword, semantic or hybrid; hybrid widens each side to max(3k, k + 10) before fusion. Vector ids are document ids."""
    wide = max(3 * k, k + 10)
    if mode == "keyword":
        return bm25(queries, docs, k)
    near = knn(query_vectors, vectors, k if mode == "semantic" else wide).withColumnRenamed("vec_id", "doc_id")
    return near if mode == "semantic" else fuse(bm25(queries, docs, wide), near, k)


def grounded_answers(queries: DataFrame, hits: DataFrame, floor: float = MIN_CONFIDENCE, sources: int = MAX_SOURCES) -> DataFrame:
    """One row per query: answered, reason kind, confidence and sources (one per URL, best first).

    ``hits``: query_id, doc_id, content, url, confidence, semantic_score, keyword_score.
    """
    relevance = (
        F.when(F.col("semantic_score").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "semantic_score")))
        .when(F.col("keyword_score").isNotNull(), F.col("keyword_score") / (F.col("keyword_score") + SATURATION))
        .otherwise(0.5)
    )
    body = T.trim_spaces(F.col("content"))
    excerpt = F.when(F.length(body) <= EXCERPT, body).otherwise(F.concat(T.trim_spaces(F.left(body, F.lit(EXCERPT))), F.lit("...")))
    scored = hits.withColumn("combined", F.round(relevance * F.col("confidence"), 6)).withColumn("excerpt", excerpt)
    best = scored.groupBy("query_id").agg(F.max("combined").alias("best"))
    passing = scored.where(F.col("combined") >= floor)
    once = passing.withColumn("u", F.row_number().over(Window.partitionBy("query_id", "url").orderBy(F.desc("combined"), "doc_id"))).where("u = 1")
    few = top(once, "query_id", [F.desc("combined"), F.asc("doc_id")], sources)
    cited = few.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "url", "excerpt"))).alias("cited"), F.max("combined").alias("confidence"))
    rows = queries.select("query_id").join(best, "query_id", "left").join(cited, "query_id", "left")
    return rows.select(
        "query_id",
        F.col("cited").isNotNull().alias("answered"),
        F.when(F.col("best").isNull(), "no_match").when(F.col("cited").isNull(), "below_floor").otherwise("grounded").alias("reason"),
        "confidence",
        F.transform("cited", lambda c: c["doc_id"]).alias("doc_ids"),
        F.transform("cited", lambda c: c["excerpt"]).alias("excerpts"),
    )
