"""Registered queries against their SQL, and operators, on rows that the given tables lack: repeated URLs, several amounts, numbers in front."""

import math
import re

import duckdb
from pyspark.sql import functions as F

from quarrykit import registry
from quarrykit.operators import retrieval as R
from quarrykit.plans.knowledge import phrases
from quarrykit.sources.pages import clean_text
from quarrykit.sources.sitemaps import sitemap_urls

Q, ORACLE = registry.queries(), registry.oracle_sql()


def same_as_sql(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = Q[name](spark, str(folder))
    found = con.execute(ORACLE[name])
    at = [[x[0] for x in found.description].index(c) for c in got.columns]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    assert want
    return sorted((tuple(r) for r in got.collect()), key=repr) == want


PAGES = [(i, f"https://p.example/{i % 23}", "<html></html>") for i in range(400)]


def test_sitemap_changes_of_repeated_urls(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "a13_sitemap_changes", "pages", PAGES, "page_id long, url string, html string")


def test_amounts_in_any_order(spark, tmp_path):
    rows = [(9, "It costs $9.10, then $8.20 and again $9.10.", "en", "web"), (19, "From \u20ac5 to $3", "en", "web"), (29, "none", "en", "web")]
    assert same_as_sql(spark, tmp_path, "l15_grounding_audit", "documents", rows, "doc_id long, text string, lang string, source string")


def test_phrases_keep_their_numbers(spark, tmp_path):
    rows = [(i, f"Sent at. {n} enjoy this now please.", "en", "web") for i, n in enumerate(("33.122.173.101", "4 4", "13"))]
    assert same_as_sql(spark, tmp_path, "l10_benefits", "documents", rows, "doc_id long, text string, lang string, source string")
    got = spark.createDataFrame([("One. Two. Three.   3 helps you a lot.  ",)], "t string").select(phrases(F.col("t"), "helps").alias("p")).first().p
    assert got == ["3 helps you a lot."]


def test_clean_text_keeps_its_numbers(spark):
    page = "struct<title:string,headings:array<struct<level:int,text:string>>,paragraphs:array<string>,lists:array<struct<ordered:boolean,items:array<string>>>,tables:array<struct<headers:array<string>,rows:array<array<string>>>>>"
    rows = [((("0 title", [(1, "1 head 1")], ["2", " 3 left "], [(False, ["4"])], [([], [["5", "55"]])])),)]
    assert spark.createDataFrame(rows, f"page {page}").select(clean_text(F.col("page")).alias("t")).first().t == "0 title\n\n1 head 1\n\n2\n\n3 left\n\n4\n\n5 | 55"


def test_sitemaps_of_repeated_urls(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "s8_sitemap_indexes", "pages", PAGES, "page_id long, url string, html string")


def test_sitemaps_without_a_bound(spark):
    body = "<urlset>" + "".join(f"<url><loc>https://p.example/{i}</loc></url>" for i in (1, 2, 1, 3)) + "</urlset>"
    roots, bodies = spark.createDataFrame([(1, "r")], "site long, url string"), spark.createDataFrame([("r", body)], "url string, body string")
    named = lambda **more: [r.url[-1] for r in sitemap_urls(roots, bodies, **more).orderBy("place").collect()]
    assert (named(), named(urls=2), named(urls=None, repeats=True)) == (["1", "2", "3"], ["1", "2"], ["1", "2", "1", "3"])


def test_bm25_keeps_a_document_together(spark):
    """Scores are summed where a document's postings lie, and documents are tokenised once, before the plan that is returned."""
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "beta alpha"), (2, None), (None, "alpha gamma"), (None, "alpha"), (3, ""), (5, "beta beta zeta")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "gamma")], "query_id long, text string")
    found = R.bm25(queries, docs, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\w+, doc_id#\w+", plan)
    assert "regexp_extract_all" not in plan
    total, mean = 7, 10 / 6
    df = {"alpha": 3, "beta": 2, "gamma": 1}
    part = lambda term, tf, n: math.log((total - df[term] + 0.5) / (df[term] + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))
    expected = {
        (1, 1): part("alpha", 2, 2) + part("beta", 2, 2), (1, None): part("alpha", 1, 2) + part("alpha", 1, 1), (1, 5): part("beta", 2, 3), (3, None): part("gamma", 1, 2),
    }
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in found.collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[key] - expected[key]) < 1e-6 for key in got)
