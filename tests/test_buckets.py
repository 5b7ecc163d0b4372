"""Bucketed live tables: only touched buckets are written, repeated batches change nothing, gaps in batch ids."""

from pyspark.sql import functions as F

from quarrykit.session import scratch
from quarrykit.sources.buckets import Live, replaced, replaced_or_removed
from quarrykit.streaming import events as E


def files(spark, live, batch):
    rows = spark.read.schema(f"{live.schema}, bucket int").parquet(f"{live.path}/data/v={batch}")
    return {r.bucket for r in rows.select("bucket").distinct().collect()}, rows.count()


def test_upserts_write_touched_buckets_only(spark):
    live = Live(spark, scratch(spark, "live"), "id long, text string", "id", 32)
    assert live.read().count() == 0 and not live.exists()
    live.upsert(spark.range(2000).select("id", F.lit("a").alias("text")), 0, replaced("id"))
    change = spark.createDataFrame([(5, "b"), (6, "b"), (5000, "new")], "id long, text string")
    for _ in range(2):  # the batch comes again
        touched = live.upsert(change, 7, replaced("id"))
    buckets, written = files(spark, live, 7)
    assert set(touched) == buckets and len(buckets) <= 3 and written < 2000 * 3 / 32 * 1.5
    rows = {r.id: r.text for r in live.read().collect()}
    assert len(rows) == 2001 and rows[5] == rows[6] == "b" and rows[5000] == "new" and rows[7] == "a"
    assert {r.id: r.text for r in live.read(before=7).collect()} == {i: "a" for i in range(2000)}
    gone = spark.createDataFrame([(i, None, True) for i in range(2000)], "id long, text string, removed boolean")
    live.upsert(gone, 9, replaced_or_removed("id"))
    assert {r.id for r in live.read().collect()} == {5000}
    live.upsert(gone.limit(0).drop("removed"), 12, replaced("id"))  # an empty batch
    assert {r.id for r in live.read().collect()} == {5000}


def test_versioned_changes(spark):
    folder = scratch(spark, "changes")
    live = Live(spark, f"{folder}/live", "chunk_id long, text string, version int", "chunk_id", 16)
    run = E.apply_changes(live, f"{folder}/archive")
    kind = "chunk_id long, text string, seq int"
    run(spark.createDataFrame([(1, "a", 0), (2, "b", 0), (2, "c", 1)], kind), 3)
    run(spark.createDataFrame([(2, " C ", 0), (1, "new", 2), (4, None, 0)], kind), 8)
    run(spark.createDataFrame([(2, " C ", 0), (1, "new", 2), (4, None, 0)], kind), 8)
    assert {(r.chunk_id, r.text, r.version) for r in live.read().collect()} == {(1, "new", 2), (2, "c", 1), (4, None, 0)}
    assert {(r.chunk_id, r.text, r.version) for r in spark.read.parquet(f"{folder}/archive").collect()} == {(1, "a", 1)}
