"""Queries over file sources, crawls with their children and the totals of a training run, with their SQL."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rules
from ..session import scratch, table
from .inputs import derive
from .pages import _cat as _categories

QUERIES, ORACLE = {}, {}


def load_crawl(pages: DataFrame, documents: DataFrame, faqs: DataFrame, job: int) -> DataFrame:
    """kind, id, page_id: the pages of a job that were read and are no copies, with its documents and FAQs that are no copies."""
    own = pages.where((F.col("job_id") == job) & (F.col("status") == "SUCCESS") & ~F.col("is_duplicate")).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "page_id")
    docs = documents.where((F.col("job_id") == job) & ~F.col("is_duplicate")).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "page_id")
    asked = faqs.where(~F.col("is_duplicate")).join(pages.where(F.col("job_id") == job).select("page_id"), "page_id", "left_semi").select(F.lit("faq").alias("kind"), F.col("item_id").alias("id"), "page_id")
    return own.unionByName(docs).unionByName(asked)


def _crawl(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    pages = table(s, d, "pages").select(k, (k % 3).alias("job_id"), F.when(k % 7 == 0, "FAILED").otherwise("SUCCESS").alias("status"), (k % 5 == 0).alias("is_duplicate"))
    docs = table(s, d, "documents").select("doc_id", F.col("doc_id").alias("page_id"), (F.col("doc_id") % 3).alias("job_id"), (F.col("doc_id") % 4 == 0).alias("is_duplicate"))
    faqs = table(s, d, "benchmark").select("item_id", (F.col("item_id") * 2).alias("page_id"), (F.col("item_id") % 6 == 0).alias("is_duplicate"))
    return load_crawl(pages, docs, faqs, 1)


QUERIES["s1_crawl_with_children"] = _crawl
ORACLE["s1_crawl_with_children"] = """SELECT 'page' AS kind, page_id AS id, page_id FROM pages WHERE page_id % 3 = 1 AND page_id % 7 <> 0 AND page_id % 5 <> 0
UNION ALL SELECT 'document', doc_id, doc_id FROM documents WHERE doc_id % 3 = 1 AND doc_id % 4 <> 0
UNION ALL SELECT 'faq', item_id, item_id * 2 FROM benchmark WHERE item_id % 6 <> 0 AND item_id * 2 IN (SELECT page_id FROM pages WHERE page_id % 3 = 1)"""


def markdown_links(text: Column) -> Column:
    """array<struct<text, url>>: ``[text](http...)`` links in order."""
    names, urls = (F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]\((https?://[^)\s]+)\)"), group) for group in (1, 2))
    return F.transform(F.arrays_zip(names.alias("text"), urls.alias("url")), lambda x: F.struct(x["text"].alias("text"), x["url"].alias("url")))


_linked = lambda: F.concat(F.lit("See [the guide](https://g.example/a?b=1), [no link](/local) and ![img](http://i.example/p.png).\n"), "text", F.lit("\n[end]("), F.lit("https://e.example/"), F.col("doc_id"), F.lit(")"))
QUERIES["s5_markdown_links"] = lambda s, d: table(s, d, "documents").select("doc_id", F.explode(markdown_links(_linked())).alias("l")).select("doc_id", "l.text", "l.url")
ORACLE["s5_markdown_links"] = "SELECT doc_id, unnest(['the guide', 'img', 'end']) AS text, unnest(['https://g.example/a?b=1', 'http://i.example/p.png', 'https://e.example/' || doc_id]) AS url FROM documents"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: the folder keys of its path and its whole text, trimmed."""
    return spark.read.text(path, wholetext=True).withColumn("value", T.trim_spaces(F.col("value")))


def _files(s: SparkSession, d: str) -> DataFrame:
    """Suppliers' names in one file a nation, read back whole."""
    path = scratch(s, "files")
    rows = table(s, d, "supplier").select("s_nationkey", "s_suppkey", "s_name").repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    rows.select("s_nationkey", F.concat(F.lit(" "), "s_name", F.lit(" ")).alias("value")).write.partitionBy("s_nationkey").text(path)
    return read_text(s, path).select(F.col("s_nationkey").cast("long").alias("s_nationkey"), F.sha2("value", 256).alias("text_sha256"))


QUERIES["s6_read_whole_files"] = _files
ORACLE["s6_read_whole_files"] = "SELECT s_nationkey::BIGINT AS s_nationkey, sha256(trim(string_agg(' ' || s_name || ' ', chr(10) ORDER BY s_suppkey))) AS text_sha256 FROM supplier GROUP BY 1"


def training_report(chunks: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: chunks, tally of categories, mean confidence (0 without chunks), errors and warnings. chunks: category, confidence; issues: issue, severity."""
    tally = chunks.groupBy("category").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat("category", F.lit("="), "n"))), ",").alias("categories"))
    total = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("mean_confidence"))
    named = lambda severity: F.array_join(F.array_sort(F.collect_list(F.when(F.col("severity") == severity, F.concat("issue", F.lit("="), "n")))), ",")
    found = issues.groupBy("severity", "issue").agg(F.count(F.lit(1)).alias("n")).agg(named("error").alias("errors"), named("warning").alias("warnings"))
    return total.crossJoin(tally).crossJoin(found)  # one row each


def _report(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    issues = table(s, d, "documents").select(F.when(k % 31 == 0, "empty_chunk").when(k % 29 == 0, "low_confidence").when(k % 6 == 0, "missing_category").alias("issue")).where("issue IS NOT NULL")
    return training_report(rules.categorize(derive(s, d, "chunks")), issues.withColumn("severity", F.when(F.col("issue") == "empty_chunk", "error").otherwise("warning")))


QUERIES["a9_training_totals"] = _report
ORACLE["a9_training_totals"] = f"""SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT round(avg(confidence), 4) FROM {_categories}) AS mean_confidence, (SELECT string_agg(category || '=' || n, ',' ORDER BY category || '=' || n) FROM (SELECT category, count(*) AS n FROM {_categories} GROUP BY 1)) AS categories,
  (SELECT coalesce(string_agg('empty_chunk=' || n, ','), '') FROM (SELECT count(*) AS n FROM documents WHERE doc_id % 31 = 0) WHERE n > 0) AS errors,
  (SELECT coalesce(string_agg(i || '=' || n, ',' ORDER BY i), '') FROM (SELECT CASE WHEN doc_id % 29 = 0 THEN 'low_confidence' ELSE 'missing_category' END AS i, count(*) AS n FROM documents WHERE doc_id % 31 <> 0 AND (doc_id % 29 = 0 OR doc_id % 6 = 0) GROUP BY 1)) AS warnings"""
