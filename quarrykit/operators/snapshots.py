"""Snapshot comparison, versioning, upserts and reports over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def snapshot_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """url, change: new, modified (another hash, or none on a side), unchanged or deleted. Inputs: url, content_hash."""
    p, c = prev.select("url", F.col("content_hash").alias("old"), F.lit(True).alias("was")), cur.select("url", F.col("content_hash").alias("hash"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(F.col("old") == F.col("hash"), "unchanged").otherwise("modified")
    return p.join(c, "url", "full_outer").select("url", change.alias("change"))


def recrawl_summary(diff: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("change") == k).alias(k) for k in ("new", "modified", "unchanged", "deleted")]
    before, now = F.col("modified") + F.col("unchanged") + F.col("deleted"), F.col("modified") + F.col("unchanged") + F.col("new")
    ratio = (F.col("new") + F.col("modified") + F.col("deleted")) / F.greatest(before, now, F.lit(1))
    return diff.agg(*counts).withColumn("ratio", F.round(ratio, 6))


def match_existing(new: DataFrame, old: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """new_id, old_id: the i-th new row of a key (nulls equal) takes the i-th old row; new rows without one have no old_id."""
    order = Window.partitionBy(*keys).orderBy(id_col)
    n = new.select(*keys, F.col(id_col).alias("new_id"), F.row_number().over(order).alias("i"))
    o = old.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col(id_col).alias("old_id"), F.row_number().over(order).alias("oi"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys])
    return n.join(o, same & (F.col("i") == F.col("oi")), "left").select("new_id", "old_id")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return source.unionByName(target.join(source.select(*keys), keys, "left_anti"))


def version_update(old: DataFrame, new: DataFrame) -> DataFrame:
    """chunk_id, action (create, update, untouched), version: changed exactly if the content hash differs. Inputs: chunk_id, text, version (old only)."""
    o = old.select("chunk_id", T.content_hash(F.col("text")).alias("was"), "version")
    n = new.select("chunk_id", T.content_hash(F.col("text")).alias("now"))
    action = F.when(F.col("was").isNull(), "create").when(F.col("was") != F.col("now"), "update").otherwise("untouched")
    version = F.when(F.col("was").isNull(), 1).otherwise(F.col("version") + (F.col("was") != F.col("now")).cast("int"))
    return n.join(o, "chunk_id", "left").select("chunk_id", action.alias("action"), version.alias("version"))


def rollback_plan(requests: DataFrame, current: DataFrame, history: DataFrame) -> DataFrame:
    """chunk_id, target, error, restored_version. current: chunk_id, version; history: chunk_id, version, content."""
    rows = requests.join(current, "chunk_id", "left").join(history.select("chunk_id", F.col("version").alias("target"), F.lit(True).alias("known")), ["chunk_id", "target"], "left")
    error = F.when(F.col("version").isNull(), "unknown chunk").when(F.col("target") == F.col("version"), "already current").when(F.col("known").isNull(), "unknown version")
    return rows.select("chunk_id", "target", error.alias("error"), F.when(error.isNull(), F.col("version") + 1).alias("restored_version"))


def rollback_run(live: DataFrame, archive: DataFrame) -> DataFrame:
    """chunk_id, action: chunks that the run archived are restored to their latest archived version, its other chunks go."""
    latest = archive.groupBy("chunk_id").agg(F.max("version").alias("restored_version"))
    return live.join(latest, "chunk_id", "left").select("chunk_id", F.when(F.col("restored_version").isNull(), "delete").otherwise("restore").alias("action"), "restored_version")


def incremental_plan(prev: DataFrame | None, cur: DataFrame, chunks: DataFrame) -> DataFrame:
    """kind (process or remove), item: URLs to process and chunks of deleted URLs. Without an earlier run, every URL."""
    if prev is None:
        return cur.select(F.lit("process").alias("kind"), F.col("url").alias("item"))
    diff = snapshot_diff(prev, cur)
    gone = chunks.join(diff.where("change = 'deleted'"), "url", "left_semi")
    return diff.where("change IN ('new', 'modified')").select(F.lit("process").alias("kind"), F.col("url").alias("item")).unionByName(gone.select(F.lit("remove").alias("kind"), F.col("chunk_id").cast("string").alias("item")))


def entity_changes(prev: DataFrame, cur: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """key, change (added, removed, changed), significant, changed fields. ``fields``: name to whether a change is significant."""
    p = prev.select(key, F.struct(*fields).alias("old"))
    c = cur.select(key, F.struct(*fields).alias("now"))
    diffs = F.array_compact(F.array(*[F.when(~F.col("old")[f].eqNullSafe(F.col("now")[f]), F.struct(F.lit(f).alias("field"), F.lit(s).alias("significant"))) for f, s in fields.items()]))
    change = F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    rows = p.join(c, key, "full_outer").select(key, change.alias("change"), F.when(change == "changed", diffs).otherwise(F.array().cast("array<struct<field:string,significant:boolean>>")).alias("diffs"))
    kept = rows.where((F.col("change") != "changed") | (F.size("diffs") > 0))
    return kept.select(key, "change", ((F.col("change") != "changed") | F.exists("diffs", lambda d: d["significant"])).alias("significant"), F.transform("diffs", lambda d: d["field"]).alias("fields"))


def ranked_changes(changes: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """The first ``limit`` changes: significant ones first, then by number of fields, then by key."""
    return changes.orderBy(F.desc("significant"), F.desc(F.size("fields")), key).limit(limit)


def broken_references(chunks: DataFrame) -> DataFrame:
    """Duplicates that point at no chunk, at themselves or at nothing."""
    ids = chunks.select(F.col("chunk_id").alias("duplicate_of"))
    lost = chunks.where("is_duplicate AND duplicate_of IS NOT NULL AND duplicate_of <> chunk_id").join(ids, "duplicate_of", "left_anti").select("chunk_id", F.lit("missing_target").alias("issue"))
    own = chunks.where("is_duplicate AND (duplicate_of IS NULL OR duplicate_of = chunk_id)")
    return lost.unionByName(own.select("chunk_id", F.when(F.col("duplicate_of").isNull(), "no_target").otherwise("self_reference").alias("issue")))


def broken_relationships(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with an endpoint (type, id) that no entity has; type Category is exempt."""
    known = entities.select("type", "id")
    out = []
    for end in ("source", "target"):
        e = edges.withColumnRenamed(f"{end}_type", "type").withColumnRenamed(f"{end}_id", "id").where("type <> 'Category'")
        out.append(e.join(known, ["type", "id"], "left_anti").select("edge_id", F.lit(end).alias("end")))
    return out[0].unionByName(out[1])


def quality_issues(chunks: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """item, issue: empty_chunk, invalid_confidence, low_confidence, missing_category, broken references and edges."""
    c = F.col("confidence")
    found = F.array_compact(F.array(
        F.when(F.length(T.trim_spaces(F.col("content"))) == 0, "empty_chunk"),
        F.when(c.isNull() | (c < 0) | (c > 1), "invalid_confidence"),
        F.when((c >= 0) & (c < 0.4), "low_confidence"),
        F.when(F.col("category").isNull(), "missing_category"),
    ))
    own = chunks.select(F.col("chunk_id").cast("string").alias("item"), F.explode(found).alias("issue"))
    refs = broken_references(chunks).select(F.col("chunk_id").cast("string").alias("item"), F.concat(F.lit("broken_reference:"), "issue").alias("issue"))
    rels = broken_relationships(edges, entities).select(F.col("edge_id").cast("string").alias("item"), F.concat(F.lit("broken_relationship:"), "end").alias("issue"))
    return own.unionByName(refs).unionByName(rels)


def set_differences(prev: DataFrame, cur: DataFrame, column: str) -> DataFrame:
    """value, change: added, removed or common values of two snapshots."""
    p, c = prev.select(column).distinct(), cur.select(column).distinct()
    both = p.select(column, F.lit(1).alias("p")).join(c.select(column, F.lit(1).alias("c")), column, "full_outer")
    return both.select(F.col(column).alias("value"), F.when(F.col("p").isNull(), "added").when(F.col("c").isNull(), "removed").otherwise("common").alias("change"))


def technology_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """page_id, added, removed: names of technologies that only one of two detections has (pages without a change are left out)."""
    names = lambda df, as_: df.groupBy("page_id").agg(F.collect_set("name").alias(as_))
    both = names(old, "old").join(names(new, "new"), "page_id", "full_outer")
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    added, removed = (F.array_sort(F.array_except(none(F.col(x)), none(F.col(y)))) for x, y in (("new", "old"), ("old", "new")))
    return both.select("page_id", F.array_join(added, ",").alias("added"), F.array_join(removed, ",").alias("removed")).where("added <> '' OR removed <> ''")


def robots_changed(old: Column, new: Column) -> Column:
    """Whether the rules differ but for the space around them and the kind of line ends."""
    plain = lambda c: F.replace(T.trim_spaces(F.coalesce(c, F.lit(""))), F.lit("\r\n"), F.lit("\n"))
    return plain(old) != plain(new)


def evaluate_access(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """request_id, allowed, reason: an ACTIVE grant of the same scope and connector (null equals null)."""
    g = grants.where("status = 'ACTIVE'").select(F.col("scope").alias("gs"), F.col("connector").alias("gc")).distinct()
    rows = requests.join(g, (F.col("scope") == F.col("gs")) & F.col("connector").eqNullSafe(F.col("gc")), "left")
    allowed = F.col("gs").isNotNull()
    return rows.select("request_id", allowed.alias("allowed"), F.when(allowed, "granted").otherwise(F.concat(F.lit("no active grant for "), F.col("scope"))).alias("reason"))


def authorized_rows(rows: DataFrame, mapping: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows whose category's scope is granted; categories without a scope pass. mapping: category, scope; grants: scope."""
    allowed = mapping.join(grants.select("scope").distinct(), "scope", "left_anti").select("category")
    return rows.join(allowed, "category", "left_anti")


def crawl_frontier(seeds: DataFrame, links: DataFrame, disallowed: DataFrame, max_depth: int, max_pages: int, durable) -> DataFrame:
    """url, depth, skipped: breadth-first reach from the seeds. links: source, target. Disallowed URLs are reported and not followed.

    Each level joins the frontier with the links and drops what was visited; levels are cut into the shared folder. Of the
    last level's URLs the first in order fill up ``max_pages``.
    """
    level = durable(seeds.select("url").distinct().join(disallowed, "url", "left_anti").withColumn("depth", F.lit(0)).withColumn("skipped", F.lit(False)))
    seen = level.unionByName(seeds.select("url").distinct().join(disallowed, "url", "left_semi").withColumn("depth", F.lit(0)).withColumn("skipped", F.lit(True)))
    count = level.count()
    for depth in range(1, max_depth + 1):
        if count >= max_pages or level.isEmpty():
            break
        found = links.join(level.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct()
        fresh = found.join(seen.select("url"), "url", "left_anti")
        blocked = fresh.join(disallowed, "url", "left_semi").withColumn("depth", F.lit(depth)).withColumn("skipped", F.lit(True))
        level = durable(fresh.join(disallowed, "url", "left_anti").orderBy("url").limit(max_pages - count).withColumn("depth", F.lit(depth)).withColumn("skipped", F.lit(False)))
        seen = durable(seen.unionByName(level).unionByName(blocked))
        count += level.count()
    return seen
