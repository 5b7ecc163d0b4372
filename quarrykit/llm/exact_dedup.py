"""Exact deduplication by 128-bit content hash, with a byte comparison inside each hash group.

Texts are compared after every run of ASCII white space (space, tab to carriage return) became one space.
Grouping on (hash, text) is the comparison: Spark's aggregate compares the key's bytes, so two texts that share a
hash form two groups. Copies collapse on the map side, so a text that makes up a third of the corpus costs one row
per task. Members find their group again by (MD5, SHA-256), rows of about 100 bytes in a join that may be split.

Defined cases: a null text counts as empty; rows that repeat a doc_id with the same text are each returned, each
counts in ``group_size`` and all of them carry ``kept`` if that id is the smallest; a null doc_id is never the one
that stays unless the whole group has none, when ``keep_id`` is null and every member is kept; other columns,
whatever their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: md5, text_sha256, keep_id, group_size."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    return (
        rows.groupBy(F.md5("body").alias("md5"), "body")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("md5", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256."""
    body = normalised(F.col(text_col))
    members = docs.select(
        F.col(id_col).alias("id"), F.md5(body).alias("md5"), F.sha2(body, 256).alias("text_sha256")
    )
    joined = members.join(exact_groups(docs, id_col, text_col), ["md5", "text_sha256"])
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW g AS (PARTITION BY body)
"""
