"""The pipeline keeps clean documents, applies each stage's decisions and packs what is left."""

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from quarrykit.llm import decontaminate, language_id, line_dedup, packing, simhash_dedup
from quarrykit.session import table

SF = "/root/testdata/sf0.001"


def test_clashing_columns_nulls_and_empty_tables(spark):
    plain = table(spark, SF, "documents").limit(40)
    odd = spark.createDataFrame([(None, "some plain words here", None, None, None), (7, "", None, None, None), (None, None, None, None, None)], plain.schema)
    docs = plain.unionByName(odd)
    for k, name in enumerate(["language", "leaks", "line_dedup", "component_id", "fp", "id", "rest", "body", "keep_id", "key", "rank", "length"]):
        docs = docs.withColumn(name, F.when(F.col("doc_id") % 2 == 0, k))
    for now in (docs.cache(), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns
        assert packing.pack(now).count() >= now.count()


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame([(90_000, None, None, None, None), (90_001, "12 34 !!", "en", "s", 8)], docs.schema)
    now = docs.unionByName(extra).cache()
    before = {r.doc_id: r for r in now.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF).cache()
        assert after.columns == docs.columns
        rows = {r.doc_id: r for r in after.collect()}
        gone = before.keys() - rows.keys()
        if name == "language_id":
            assert gone == {90_000, 90_001}
        elif name == "line_dedup":
            assert not gone and all(r.n_chars == len(r.text) for r in rows.values())
        elif name == "simhash_dedup":
            groups = defaultdict(set)
            for r in simhash_dedup.near_groups(now, 5).collect():
                groups[r.component_id].add(r.doc_id)
            assert rows.keys() == groups.keys()
        else:
            assert gone == {r.doc_id for r in decontaminate.digest(now, table(spark, SF, "benchmark")).collect()} and len(gone) < 20
        now, before = after, rows
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in pieces.collect()} == before.keys()
    again = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in again.collect()} <= {r.doc_id for r in docs.collect()}
    assert language_id.UNDETERMINED == "und" and packing.CAPACITY == 2048 and line_dedup.WINDOW == 3
