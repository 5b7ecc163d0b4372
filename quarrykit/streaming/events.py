"""Structured Streaming twins: first occurrences, sessions, rate limits, repeats, outages, metrics, versioned upserts.

Late data: a watermark of one hour on ``ts``; rows behind it are dropped. Each job reads its source with availableNow
in the queries, so a finished stream equals its batch twin. State and output live in the shared checkpoint folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.folds import Machine, fold, microseconds
from ..operators.health import request_histogram
from ..session import attach, durable, release, scratch
from ..sources.buckets import Live

WATERMARK = "1 hour"
#: Seconds by which rows may be late.
LATE = 3600.0


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder (a glob fits both), at most some 1 GB of them a batch."""
    attach(spark)
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(1 << 30)).parquet(f"{sf_dir}/{name}.parque[t]")


def finish(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over what there is and read its output."""
    spark = df.sparkSession
    folder = scratch(spark, "stream")
    query = df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def first_seen(docs: DataFrame) -> DataFrame:
    """One row per content hash."""
    return docs.withColumn("content_hash", T.content_hash(F.col("text"))).dropDuplicates(["content_hash"]).select("content_hash")


def repeats(rows: DataFrame, bound: str = "30 minutes") -> DataFrame:
    """content_hash, first_at, repeats: first occurrences with how often they come again, each within ``bound`` of the one before.

    ``rows``: text, ts. A hash is held until the watermark passes its last occurrence by ``bound``, then given out; so state follows the
    hashes of that time, and an occurrence after it is a first one again.
    """
    grouped = timed(rows).groupBy(T.content_hash(F.col("text")).alias("content_hash"), F.session_window("ts", bound).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("content_hash", F.col("w.start").alias("first_at"), (F.col("n") - 1).alias("repeats"))


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, started, n: sessions that end after ``gap`` without an event."""
    grouped = timed(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("started"), "n")


def request_metrics(requests: DataFrame, width: str = "1 hour") -> DataFrame:
    found = request_histogram(timed(requests).withColumn("w", F.window("ts", width)), "w")
    return found.withColumn("hour", F.col("w.start")).drop("w")


def fold_batch(states: Live, out: str, key: str, machine: Machine, late: float = LATE, sweep: int = 16) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: a batch of (key, at, event_id, the machine's inputs) through the machine from where earlier batches left each key.

    Outcomes go to the batch's own folder below ``out`` and states to ``states`` (key, state, at), both once per batch id. Time is that of the
    events: a state that a fresh key would have as well ``late`` seconds before the batch's last event is dropped. Buckets that the batch does not
    touch are swept in turn, each at least every ``sweep`` batches, so states of keys that never come again go too.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows = durable(batch)
        last = rows.agg(F.max("at")).first()[0] or 0
        before = states.read(number).select(F.col(key).alias("__key"), "state")
        outcomes, after = fold(rows.join(before, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key"), key, machine, state="state")
        outcomes.write.mode("overwrite").parquet(f"{out}/batch={number}")

        @F.udf("boolean", useArrow=True)
        def idle(state: str, now: int) -> bool:
            return machine.fresh(json.loads(state), now)

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            rest = old.join(new.select(F.col(key).alias("__key")), F.col(key).eqNullSafe(F.col("__key")), "left_anti")
            return rest.unionByName(new.select(*old.columns)).where(~idle("state", F.lit(last - round(late * 1e6))))

        states.upsert(after, number, merge, also=range(number % sweep, states.buckets, sweep))
        release(rows)

    return run


def folded(rows: DataFrame, key: str, machine: Machine, late: float = LATE, buckets: int = 32) -> tuple[DataFrame, Live]:
    """Run the stream (key, at, event_id, the machine's inputs) over what there is: its outcomes, and the states that are left."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    folder = scratch(spark, "folds")
    states = Live(spark, f"{folder}/states", f"{key} {kind}, state string, at long", key, buckets)
    run = fold_batch(states, f"{folder}/out", key, machine, late)
    rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    schema = f"event_id long, {key} {kind}, {machine.outcomes}"
    found = spark.read.schema(schema).parquet(f"{folder}/out").drop("batch") if states.exists() else spark.createDataFrame([], schema)
    return found, states


def timed_rows(events: DataFrame) -> DataFrame:
    """``events`` with ``at`` (microseconds) for ``ts``."""
    return events.withColumn("at", microseconds(F.col("ts"))).drop("ts")


def latest(changes: DataFrame) -> DataFrame:
    """A batch's last text of each chunk; ``changes``: chunk_id, text, seq."""
    return changes.groupBy("chunk_id").agg(F.max_by("text", F.struct("seq", "text")).alias("text"))


def apply_changes(live: Live, archive: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: versioned upsert of (chunk_id, text, seq) into the live table (chunk_id, text, version), once per batch id.

    Only the buckets of a batch's chunks are written again. Texts that a batch replaces go to its own folder of the archive.
    """

    # Equal texts need no hash to be known as unchanged.
    differs = F.when(F.col("text") == F.col("old"), F.lit(False)).otherwise(T.content_hash(F.col("text")) != T.content_hash(F.col("old")))

    def run(batch: DataFrame, number: int) -> None:
        new = durable(latest(batch))
        old = live.read(number).join(new.select("chunk_id"), "chunk_id", "left_semi")
        rows = old.select("chunk_id", F.col("text").alias("old"), "version").join(new, "chunk_id")
        rows.where(differs).select("chunk_id", F.col("old").alias("text"), "version").write.mode("overwrite").parquet(f"{archive}/v={number}")

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            rows = old.select("chunk_id", F.col("text").alias("old"), "version").join(new, "chunk_id", "full_outer")
            changed = F.col("text").isNotNull() & (F.col("version").isNull() | differs)
            return rows.withColumn("changed", changed).select("chunk_id", F.when(F.col("changed"), F.col("text")).otherwise(F.col("old")).alias("text"), (F.coalesce("version", F.lit(0)) + F.col("changed").cast("int")).alias("version"))

        live.upsert(new, number, merge)
        release(new)

    return run
