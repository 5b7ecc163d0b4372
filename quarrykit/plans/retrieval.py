"""Queries over retrieval and vectors, with their SQL. Query sets are the benchmark, or every id divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators.components import components
from ..operators.postings import Postings
from ..session import durable, release, scratch, table
from ..sources.buckets import Live, replaced, replaced_or_removed
from .text import SP, trim, words_in

QUERIES, ORACLE = {}, {}
#: Largest cosine between two test vectors is about 0.5; thresholds of trained encoders would select nothing.
NEAR = 0.40

_toks = rf"list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda w: w NOT IN {words_in(T.STOPWORDS)})"


def _bm25_sql(docs: str = "documents", queries: str = "SELECT item_id AS query_id, text FROM benchmark", k: int = 10) -> str:
    return f"""
  (WITH dt AS (SELECT doc_id, {_toks} AS tk FROM {docs}), dl AS (SELECT doc_id, len(tk) AS n FROM dt),
  st AS (SELECT count(*) AS total, avg(n) AS mean FROM dl), qt AS (SELECT DISTINCT query_id, unnest({_toks}) AS term FROM ({queries})),
  p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tk) AS term FROM dt) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  s AS (SELECT query_id, doc_id, round(sum(ln((total - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 6) AS score
    FROM qt JOIN p USING (term) JOIN f USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {k})"""


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(s, d, "embeddings")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select("vec_id", "embedding")


QUERIES["t2_bm25"] = lambda s, d: R.bm25(_items(s, d), _docs(s, d), 10)
ORACLE["t2_bm25"] = f"SELECT * FROM {_bm25_sql()}"



def _stored(s: SparkSession, d: str) -> DataFrame:
    """Two batches of documents indexed one after the other, then searched."""
    docs, index = _docs(s, d), Postings(s, scratch(s, "postings"), 8)
    index.extend(docs.where("doc_id % 3 <> 0"), 0)
    index.extend(docs, 1)
    return index.search(_items(s, d), 10)


QUERIES["t2_stored_postings"] = _stored
ORACLE["t2_stored_postings"] = ORACLE["t2_bm25"]

_dot = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
QUERIES["t3_cosine"] = lambda s, d: (lambda v: v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2")), "vec_id").select("vec_id", F.round(R.dot(F.col("embedding"), F.col("e2")), 6).alias("cosine")))(table(s, d, "embeddings"))
ORACLE["t3_cosine"] = f"SELECT a.vec_id, {_dot} AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _knn_sql(k: int) -> str:
    return f"""(SELECT a.vec_id AS query_id, b.vec_id, {_dot} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_dot} DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_dot} DESC, b.vec_id) <= {k})"""


QUERIES["t4_knn"] = lambda s, d: R.knn(*_vectors(s, d), 10)
ORACLE["t4_knn"] = f"SELECT * FROM {_knn_sql(10)}"
QUERIES["t5_ann"] = lambda s, d: R.ann(*_vectors(s, d), 10)


def _semantic(s: SparkSession, d: str, k: int) -> DataFrame:
    """Neighbours of query vectors, keyed like benchmark items (query vector 20 i belongs to item i)."""
    q, v = _vectors(s, d)
    return R.knn(q.withColumn("query_id", (F.col("query_id") / 20).cast("long")), v, k).withColumnRenamed("vec_id", "doc_id")


def _fuse_sql(k: int, wide: int) -> str:
    return f"""(SELECT query_id, doc_id, score, semantic_score, keyword_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list, first) AS rank FROM (
    SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, max(CASE WHEN list = 0 THEN s END) AS semantic_score, max(CASE WHEN list = 1 THEN s END) AS keyword_score,
      min(list) AS list, min_by(rank, list) AS first FROM (
      SELECT query_id // 20 AS query_id, vec_id AS doc_id, score AS s, rank, 0 AS list FROM {_knn_sql(wide)} UNION ALL SELECT query_id, doc_id, score, rank, 1 FROM {_bm25_sql(k=wide)})
    GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, list, first) <= {k})"""


QUERIES["t6_fuse_rankings"] = lambda s, d: R.fuse(R.bm25(_items(s, d), _docs(s, d), 10), _semantic(s, d, 10), 10)
ORACLE["t6_fuse_rankings"] = f"SELECT * FROM {_fuse_sql(10, 10)}"


def _search(s: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(s, d)
    return R.search(_items(s, d), _docs(s, d), q.withColumn("query_id", (F.col("query_id") / 20).cast("long")), v, 5)


QUERIES["t7_search"] = _search
ORACLE["t7_search"] = f"SELECT * FROM {_fuse_sql(5, 15)}"


def _answers(s: SparkSession, d: str) -> DataFrame:
    hits = R.bm25(_items(s, d), _docs(s, d), 20)
    docs = _docs(s, d).select("doc_id", F.col("text").alias("content"), F.concat(F.lit("https://s/"), F.col("doc_id") % 50).alias("url"), (0.5 + F.col("doc_id") % 5 / 10).alias("confidence"))
    rows = hits.join(docs, "doc_id").select("query_id", "doc_id", "content", "url", "confidence", F.lit(None).cast("double").alias("semantic_score"), F.col("score").alias("keyword_score"))
    found = R.grounded_answers(_items(s, d), rows, floor=0.6)
    return found.select("query_id", "answered", "reason", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce(F.array_join(F.col("doc_ids").cast("array<string>"), ","), F.lit("")).alias("doc_ids"), F.coalesce(F.sha2(F.array_join("excerpts", "|"), 256), F.lit("")).alias("excerpts"))


QUERIES["t8_grounded_answer"] = _answers
ORACLE["t8_grounded_answer"] = f"""
WITH h AS (SELECT query_id, doc_id, round(score / (score + 5) * (0.5 + doc_id % 5 / 10), 6) AS c, 'https://s/' || doc_id % 50 AS url, {trim('text')} AS b
  FROM {_bm25_sql(k=20)} JOIN (SELECT doc_id, text FROM documents) USING (doc_id)),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY c DESC, doc_id) AS rn FROM h WHERE c >= 0.6),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS r FROM u WHERE rn = 1),
x AS (SELECT query_id, max(c) AS confidence, string_agg(doc_id::VARCHAR, ',' ORDER BY r) AS doc_ids,
  sha256(string_agg(CASE WHEN length(b) <= 300 THEN b ELSE {trim('left(b, 300)')} || '...' END, '|' ORDER BY r)) AS excerpts FROM k WHERE r <= 3 GROUP BY 1)
SELECT q.item_id AS query_id, x.query_id IS NOT NULL AS answered,
  CASE WHEN q.item_id NOT IN (SELECT query_id FROM h) THEN 'no_match' WHEN x.query_id IS NULL THEN 'below_floor' ELSE 'grounded' END AS reason,
  coalesce(confidence, 0) AS confidence, coalesce(doc_ids, '') AS doc_ids, coalesce(excerpts, '') AS excerpts
FROM benchmark q LEFT JOIN x ON q.item_id = x.query_id"""


BONUS = 0.05


def related(pairs: DataFrame, attributes: DataFrame, k: int, least: float, bonus: float = BONUS) -> DataFrame:
    """id, other, score, rank: similar items, ``bonus`` for a common attribute, at most 1; ``attributes``: id, tags (array)."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "score"))
    return best_related(both, attributes, k, least, bonus)


def best_related(both: DataFrame, attributes: DataFrame, k: int, least: float, bonus: float = BONUS) -> DataFrame:
    """The same from pairs that stand both ways (id, other, score), as those of ``similar_best``."""
    tagged = both.join(attributes, "id").join(attributes.select(F.col("id").alias("other"), F.col("tags").alias("tags2")), "other")
    score = F.round(F.least(F.lit(1.0), F.col("score") + F.when(F.arrays_overlap("tags", "tags2"), bonus).otherwise(0.0)), 6)
    return R.top(tagged.select("id", "other", score.alias("score")).where(F.col("score") >= least), "id", [F.desc("score"), F.asc("other")], k)


def _tags(s: SparkSession, d: str, several: bool) -> DataFrame:
    v = table(s, d, "embeddings")
    one = F.array("label") if not several else F.array(F.col("label") % 3, F.col("label") % 5 + 10)
    return v.select(F.col("vec_id").alias("id"), one.alias("tags"))


def _related_sql(tags: str) -> str:
    return f"""
WITH t AS (SELECT vec_id, embedding, {tags} AS tags FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS other, round(least(1.0, {_dot} + CASE WHEN list_has_any(a.tags, b.tags) THEN 0.05 ELSE 0 END), 6) AS score
  FROM t a, t b WHERE a.vec_id <> b.vec_id AND {_dot} >= {NEAR - 0.05})
SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM p WHERE score >= {NEAR} QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 5"""


QUERIES["t9_related_products"] = lambda s, d: best_related(R.similar_best(_vectors(s, d)[1], NEAR - BONUS, 5, BONUS, 1.0), _tags(s, d, False), 5, NEAR)
ORACLE["t9_related_products"] = _related_sql("[label]")
QUERIES["t10_related_services"] = lambda s, d: best_related(R.similar_best(_vectors(s, d)[1], NEAR - BONUS, 5, BONUS, 1.0), _tags(s, d, True), 5, NEAR)
ORACLE["t10_related_services"] = _related_sql("[label % 3, label % 5 + 10]")


def similar_and_related(pairs: DataFrame, clusters: DataFrame, k: int, similar: float, low: float) -> DataFrame:
    """id, band (similar or related), other, score, rank: pairs of different clusters in two bands of similarity."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "score"))
    rows = both.join(clusters, "id").join(clusters.select(F.col("id").alias("other"), F.col("cluster").alias("c2")), "other").where("cluster <> c2")
    band = F.when(F.col("score") >= similar, "similar").otherwise("related")
    ranked = rows.where(F.col("score") >= low).select("id", band.alias("band"), "other", "score")
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("id", "band").orderBy(F.desc("score"), "other"))).where(F.col("rank") <= k)


QUERIES["t11_similar_and_related_faqs"] = lambda s, d: similar_and_related(R.similar_pairs(_vectors(s, d)[1], 0.35), table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster")), 5, NEAR, 0.35)
ORACLE["t11_similar_and_related_faqs"] = f"""
SELECT *, row_number() OVER (PARTITION BY id, band ORDER BY score DESC, other) AS rank FROM (
  SELECT a.vec_id AS id, CASE WHEN {_dot} >= {NEAR} THEN 'similar' ELSE 'related' END AS band, b.vec_id AS other, {_dot} AS score
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.label <> b.label AND {_dot} >= 0.35)
QUALIFY row_number() OVER (PARTITION BY id, band ORDER BY score DESC, other) <= 5"""


def merge_plan(faqs: DataFrame) -> DataFrame:
    """cluster, faq_id, keeper, merged: structured sources first, then the longest answer, then the smallest id."""
    order = [F.when(F.col("source_kind") == "structured", 0).otherwise(1), F.desc("answer_length"), F.asc("faq_id")]
    best = faqs.groupBy("cluster").agg(F.min(F.struct(order[0].alias("s"), (-F.col("answer_length")).alias("n"), F.col("faq_id").alias("keeper"))).alias("b"), F.count(F.lit(1)).alias("size"))
    return faqs.join(best, "cluster").where("size > 1").select("cluster", "faq_id", F.col("b.keeper").alias("keeper"), (F.col("faq_id") != F.col("b.keeper")).alias("merged"))


QUERIES["t12_faq_merge_plan"] = lambda s, d: merge_plan(table(s, d, "documents").select(T.content_hash(F.col("text")).alias("cluster"), F.col("doc_id").alias("faq_id"), F.when(F.col("doc_id") % 3 == 0, "structured").otherwise("heuristic").alias("source_kind"), F.length("text").alias("answer_length")))
ORACLE["t12_faq_merge_plan"] = f"""
WITH f AS (SELECT sha256({trim(f"regexp_replace(lower(text), '{SP}+', ' ', 'g')")}) AS cluster, doc_id AS faq_id, doc_id % 3 = 0 AS st, length(text) AS n FROM documents)
SELECT cluster, faq_id, first_value(faq_id) OVER w AS keeper, faq_id <> first_value(faq_id) OVER w AS merged FROM f
WINDOW w AS (PARTITION BY cluster ORDER BY st DESC, n DESC, faq_id) QUALIFY count(*) OVER (PARTITION BY cluster) > 1"""

QUERIES["j8_similar_pairs"] = lambda s, d: R.similar_pairs(_vectors(s, d)[1], NEAR)
ORACLE["j8_similar_pairs"] = f"SELECT a.vec_id AS a, b.vec_id AS b, {_dot} AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_dot} >= {NEAR}"


QUERIES["j8_banded_pairs"] = lambda s, d: R.similar_pairs(_vectors(s, d)[1], NEAR, recall=0.95)


def duplicate_clusters(items: DataFrame, threshold: float, recall: float | None = None) -> DataFrame:
    """id, cluster (smallest reachable id). ``items``: id, text, embedding. Equal contents, equal vectors and similar vectors link.

    Only one item of each content, and of those one of each vector, is compared with others; with ``recall`` by bands of signatures."""
    hashed = durable(items.select("id", F.col("embedding").cast("array<float>").alias("embedding"), T.content_hash(F.col("text")).alias("h")))
    reps = hashed.groupBy("h").agg(F.min("id").alias("rep"))
    vectors = durable(hashed.join(reps.select("rep"), F.col("id") == F.col("rep"), "left_semi").select(F.col("id").alias("vec_id"), "embedding").where("embedding IS NOT NULL"))
    classes = durable(vectors.groupBy("embedding").agg(F.min("vec_id").alias("first")))
    copies = vectors.join(classes, "embedding").where("vec_id <> first").select(F.col("vec_id").alias("a"), F.col("first").alias("b"))
    alike = classes.select(F.col("first").alias("vec_id"), "embedding")
    pairs = R.similar_links(alike, threshold) if recall is None else R.similar_pairs(alike, threshold, recall).select("a", "b")
    groups = components(copies.unionByName(pairs))
    for used in (vectors, classes):
        release(used)
    labelled = reps.join(groups, F.col("rep") == F.col("node"), "left").select("h", F.coalesce("component", "rep").alias("cluster"))
    return hashed.select("id", "h").join(labelled, "h").select("id", "cluster")


def _items_with_vectors(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.join(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


QUERIES["a3_duplicate_clusters"] = lambda s, d: duplicate_clusters(_items_with_vectors(s, d), NEAR)
ORACLE["a3_duplicate_clusters"] = f"""
WITH RECURSIVE t AS (SELECT doc_id AS id, {trim(f"regexp_replace(lower(text), '{SP}+', ' ', 'g')")} AS body, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
r AS (SELECT body, min(id) AS rep FROM t GROUP BY 1), v AS (SELECT rep AS vec_id, embedding FROM r JOIN t ON t.id = r.rep WHERE embedding IS NOT NULL),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b WHERE a.vec_id <> b.vec_id AND {_dot} >= {NEAR}),
c AS (SELECT rep AS node, rep AS root FROM r UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.node),
m AS (SELECT node, min(root) AS cluster FROM c GROUP BY 1)
SELECT id, cluster FROM t JOIN r USING (body) JOIN m ON m.node = r.rep"""
QUERIES["a5_duplicate_faqs"] = lambda s, d: duplicate_clusters(_items_with_vectors(s, d).withColumn("text", F.concat(F.lit("q"), F.col("id") % 7, F.lit("\n"), "text")), NEAR)
ORACLE["a5_duplicate_faqs"] = ORACLE["a3_duplicate_clusters"].replace("lower(text)", "lower('q' || doc_id % 7 || chr(10) || text)")


def vector_stats(vectors: DataFrame) -> DataFrame:
    """namespace, live vectors, dimension; mixed dimensions raise an error."""
    stats = vectors.groupBy("namespace").agg(F.count(F.lit(1)).alias("live"), F.min(F.size("embedding")).alias("dimension"), F.max(F.size("embedding")).alias("most"))
    same = F.assert_true(F.col("dimension") == F.col("most"), "mixed dimensions in one namespace")
    return stats.select("namespace", "live", F.coalesce(same.cast("int"), F.col("dimension")).alias("dimension"))


QUERIES["a30_vector_stats"] = lambda s, d: vector_stats(table(s, d, "embeddings").withColumnRenamed("label", "namespace"))
ORACLE["a30_vector_stats"] = "SELECT label AS namespace, count(*) AS live, min(len(embedding)) AS dimension FROM embeddings GROUP BY 1"


def upsert_vectors(stored: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """Stored vectors without removed ids, replaced or extended by changed ones."""
    left = stored.join(removed, "vec_id", "left_anti").join(changed.select("vec_id"), "vec_id", "left_anti")
    return left.unionByName(changed.join(removed, "vec_id", "left_anti"))


QUERIES["k2_upsert_vectors"] = lambda s, d: (lambda v: upsert_vectors(v.where("vec_id % 3 <> 0"), v.where("vec_id % 4 = 0").withColumn("label", F.lit(99)), v.where("vec_id % 10 = 1").select("vec_id")).select("vec_id", "label"))(table(s, d, "embeddings").select("vec_id", "embedding", "label"))
ORACLE["k2_upsert_vectors"] = "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 99 ELSE label END AS label FROM embeddings WHERE vec_id % 10 <> 1 AND (vec_id % 3 <> 0 OR vec_id % 4 = 0)"



def _stored_vectors(s: SparkSession, d: str) -> DataFrame:
    """The same on a stored table, whose second batch holds changed and removed vectors."""
    v = table(s, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("int").alias("label"))
    live = Live(s, scratch(s, "vectors"), "vec_id long, embedding array<float>, label int", "vec_id", 16)
    live.upsert(v.where("vec_id % 3 <> 0"), 0, replaced("vec_id"))
    gone = F.col("vec_id") % 10 == 1
    live.upsert(v.where((F.col("vec_id") % 4 == 0) | gone).withColumn("label", F.lit(99)).withColumn("removed", gone), 1, replaced_or_removed("vec_id"))
    return live.read().select("vec_id", "label")


QUERIES["k2_upsert_buckets"] = _stored_vectors
ORACLE["k2_upsert_buckets"] = ORACLE["k2_upsert_vectors"]
QUERIES["j9_hydrate_hits"] = lambda s, d: R.bm25(_items(s, d), _docs(s, d), 3).join(table(s, d, "documents").select("doc_id", "source", "n_chars"), "doc_id").select("query_id", "doc_id", "rank", "source", "n_chars")
ORACLE["j9_hydrate_hits"] = f"SELECT query_id, doc_id, rank, source, n_chars FROM {_bm25_sql(k=3)} JOIN documents USING (doc_id)"
