r"""Mixing sources to target weights by hash-threshold histograms.

``targets``: sources in code point order (null last) take the weights in turn; together they get ``share`` times all words, each at most
``most`` times its own, and what lies above is shared again by weight among the others until none is above.

``mix``: a row's 64-bit hash (of all its columns) is its place in an endless order of its source. The mix makes ``most`` passes over a source:
the k-th takes the words of the target beyond k - 1 whole sources, so the budgets are nested and a row is taken once for
every pass whose threshold lies above its hash. A threshold is found without sorting: words are summed by source and the hash's first
``BITS`` bits, the bucket in which the budget ends is split by the next bits, and that one by whole hashes. Rows equal in every column share a hash;
where a budget ends among them, so many of them are taken as come nearest to it (they are counted, not told apart). So a
source's words differ from its target by at most half a row's a pass.

Only keys (source, hash, size) are written and summed; sums combine before the shuffle, so a hot source costs no more than its buckets.
Thresholds reach the rows by a broadcast up to ``FEW`` sources, by a join that Spark may split beyond.

Defined cases: a null text has no words; rows without words are never taken (0 words) and shape no target; a source without words has target 0; null
is a source of its own; repeated rows are rows like others; ids play no part but in the hash; an empty table gives an empty
result; other columns may have any name but ``into``'s, which is replaced. Columns of a map type cannot be compared and raise an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Bits of the hash that one histogram looks at: 4096 sums a source meet in the task that finds its threshold.
BITS = 12
#: Sources whose thresholds are sent to every task.
FEW = 100_000
#: Equal rows that one task writes out at a time.
CHUNK = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _key(source: str) -> Column:
    """A source's name that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, key, words, target of the table (source, key, words), a row per source.

    Ranks come from ranges of sources, each counted for itself. A round of sharing fixes the sources above their bound; it ends when none is.
    """
    session = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    ranges = durable(sizes.repartitionByRange(int(session.conf.get("spark.sql.shuffle.partitions")), order).withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("range", F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # one row a range
    rank = F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = durable(ranges.join(before, "range").select("source", "key", "words", weight.alias("weight")))
    total = rows.agg(F.sum("words")).first()[0] or 0
    rate, bound = math.inf, most * F.col("words")
    while True:  # the rate only rises from the first sharing on, and each round but the last fixes a source
        fixed = bound <= F.lit(rate) * F.col("weight") if rate < math.inf else F.lit(False)
        held, open_weight = rows.agg(F.sum(F.when(fixed, bound).otherwise(0.0)), F.sum(F.when(fixed, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        now = (share * total - held) / open_weight
        if now == rate:
            break
        rate = now
    return rows.select("source", "key", "words", F.least(bound, F.lit(rate) * F.col("weight")).cast("double").alias("target"))


def _ends(hist: DataFrame, budgets: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """The bucket in which each budget ends: ``hist`` (keys, bucket, w, n) has as many rows a budget as there are buckets at most."""
    reach = hist.withColumn("upto", F.sum("w").over(Window.partitionBy(*keys).orderBy(bucket)))
    met = reach.join(budgets, keys).where((F.col("upto") - F.col("w") <= F.col("left")) & (F.col("left") < F.col("upto")))
    return met.withColumn("left", F.col("left") - (F.col("upto") - F.col("w"))).drop("upto")


def thresholds(keys: DataFrame, found: DataFrame, most: float = MOST) -> DataFrame:
    """key, pass, hash, copies: what the pass takes of a source are the rows below the hash and ``copies`` of those at it.

    ``keys``: key, hash, size; ``found``: key, words, target. Passes that take all or nothing have no row.
    """
    passes = F.explode(F.sequence(F.lit(1), F.lit(math.ceil(most)))).alias("pass")
    left = F.least(F.greatest(F.col("target") - (F.col("pass") - 1) * F.col("words"), F.lit(0.0)), F.col("words").cast("double"))
    budgets = found.select("key", "words", "target", passes).select("key", "pass", left.alias("left"), "words").where("left > 0 AND left < words").drop("words")
    budgets = durable(budgets)
    first = F.shiftright("hash", 64 - BITS).alias("b1")
    hist = keys.groupBy("key", first).agg(F.sum("size").alias("w"))
    ends = durable(_ends(hist, budgets, ["key"], "b1").select("key", "pass", "b1", "left"))
    few = ends.count() <= math.ceil(most) * FEW
    sent = lambda df: F.broadcast(df) if few else df
    inner = keys.withColumn("b1", first).join(sent(ends.select("key", "pass", "b1")), ["key", "b1"])
    second = F.shiftright("hash", 64 - 2 * BITS).alias("b2")
    ends = durable(_ends(inner.groupBy("key", "pass", second).agg(F.sum("size").alias("w")), ends.select("key", "pass", "left"), ["key", "pass"], "b2").select("key", "pass", "b2", "left"))
    last = keys.withColumn("b2", second).join(sent(ends.select("key", "pass", "b2")), ["key", "b2"])
    whole = last.groupBy("key", "pass", "hash").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
    at = _ends(whole, ends.select("key", "pass", "left"), ["key", "pass"], "hash")
    return durable(at.select("key", "pass", "hash", F.round(F.col("left") * F.col("n") / F.col("w")).cast("long").alias("copies")))


def mix(
    rows: DataFrame, size: str = "size", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, into: str = "mix"
) -> DataFrame:
    """``rows``' columns and a struct ``into`` (source_size, target, times): how often the mix takes each row. ``size`` is a column of longs."""
    base = rows.drop(into)
    own = {"key": _key(source), "hash": F.xxhash64(*[F.col(f"`{c}`") for c in base.columns]), "size": F.col(f"`{size}`")}
    keys = durable(base.select(*[c.alias(n) for n, c in own.items()], F.col(source).alias("source")))
    sizes = keys.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    found = durable(targets(sizes, weights, share, most))
    ends = thresholds(keys.drop("source"), found, most).groupBy("key").agg(F.collect_list(F.struct("pass", "hash", "copies")).alias("ends"))  # at most ceil(most)
    whole = F.filter(F.sequence(F.lit(1), F.lit(math.ceil(most))), lambda k: F.col("target") >= k * F.col("words"))
    plan = durable(found.join(ends, "key", "left").select("key", F.struct("words", "target", F.size(whole).alias("whole"), F.coalesce("ends", F.array().cast("array<struct<pass:int,hash:bigint,copies:bigint>>")).alias("ends")).alias("plan")))
    plan = F.broadcast(plan.withColumnRenamed("key", "__key")) if plan.count() <= FEW else plan.withColumnRenamed("key", "__key")
    place = base.select("*", own["key"].alias("__key"), own["hash"].alias("__hash"))
    met = place.join(plan, "__key").drop("__key")
    below = lambda copy: F.col("plan.whole") + F.size(F.filter("plan.ends", lambda e: (F.col("__hash") < e["hash"]) | ((F.col("__hash") == e["hash"]) & (copy < e["copies"]))))
    tied = F.exists("plan.ends", lambda e: F.col("__hash") == e["hash"])
    shape = lambda df, copy: df.select(*[f"`{c}`" for c in base.columns], F.struct(F.col("plan.words").alias("source_size"), F.col("plan.target").alias("target"), below(copy).alias("times")).alias(into))
    # rows equal in all columns at a threshold: counted, then written out in numbered chunks
    equal = met.where(tied).groupBy(*[f"`{c}`" for c in base.columns], "__hash", "plan").agg(F.count(F.lit(1)).alias("__n"))
    chunks = equal.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(CHUNK).cast("long"))))
    copies = chunks.withColumn("__copy", F.explode(F.sequence("__from", F.least(F.col("__from") + CHUNK, F.col("__n")) - 1)))
    return shape(met.where(~tied), F.lit(0)).unionByName(shape(copies, F.col("__copy")))


def mixed(docs: DataFrame, text_col: str = "text", into: str = "mix", **options) -> DataFrame:
    """The mix itself: documents in order of nothing, each as often as it is taken."""
    sized = "__mix_words"
    found = mix(docs.withColumn(sized, words(text_col)), sized, into=into, **options)
    return found.where(f"{into}.times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col(f"{into}.times")))).drop(sized, "__copy", into)


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns: doc_id, size, source_size, target, taken."""
    rows = durable(docs.select("doc_id", "source", words("text").alias("size")))
    return mix(rows).select("doc_id", "size", F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target"), (F.col("size") * F.col("mix.times")).alias("taken"))
