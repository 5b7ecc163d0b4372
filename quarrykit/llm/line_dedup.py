r"""Line deduplication over content-defined chunks of lines, in DataFrame functions only.

A text is split at "\n". Each line gets a 32-bit hash (the head of its MD5), and a rolling hash over the last
``WINDOW`` line hashes, h[i] + 31 h[i-1] + 961 h[i-2], ends a chunk wherever it is divisible by ``divisor`` and at
the last line. A boundary depends on three lines alone, so after an insertion or removal the boundaries fall into step
again within a few lines. A chunk of two lines or more whose text occurs more than once in the corpus stays at its first
place (smallest doc_id, then text hash, then first line) and is removed everywhere else.

Byte comparison: chunks are grouped by (MD5, text), which compares bytes; an MD5 that two different texts share
removes nothing. Copies collapse on the map side before the shuffle. The text itself moves twice: once for that
comparison and once to meet the decisions. The list of repeated chunks is written to the shared folder, so that the
places of a very common chunk meet it in a join of two plain exchanges, which Spark may split.

Defined cases: a null text stays null and counts no line; an empty text has one empty line; a text that loses all
its chunks becomes empty and its row stays; rows repeating doc_id and text are one document (same decisions, counted as
repeats of each other only with other documents' rows); null ids order first; further columns pass through unchanged
(``n_chars`` follows the new text where the table has it); helper columns live in one struct that is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: Lines under the rolling hash.
WINDOW = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunk_spans(text: Column, divisor: int) -> Column:
    """array<struct<start, n, body>>: the chunks of one text, ``start`` counted in lines from 0."""
    at = lambda xs, i: F.coalesce(F.get(xs, i), F.lit(0).cast("long"))

    def cut(lines: Column) -> Column:
        rolling = let(
            F.transform(lines, line_hash),
            lambda hs: F.transform(
                hs, lambda h, i: h + F.lit(31) * at(hs, i - F.lit(1)) + F.lit(961) * at(hs, i - F.lit(2))
            ),
        )
        ends = let(
            rolling,
            lambda rs: F.filter(
                F.sequence(F.lit(0), F.size(rs) - F.lit(1)),
                lambda i: (i == F.size(rs) - F.lit(1)) | (F.get(rs, i) % F.lit(divisor) == 0),
            ),
        )

        def spans(es: Column) -> Column:
            def span(end: Column, k: Column) -> Column:
                start = F.coalesce(F.get(es, k - F.lit(1)) + F.lit(1), F.lit(0))
                n = end - start + F.lit(1)
                return F.struct(
                    start.alias("start"),
                    n.alias("n"),
                    F.array_join(F.slice(lines, start + F.lit(1), n), "\n").alias("body"),
                )

            return F.transform(es, span)

        return let(ends, spans)

    return let(F.split(text, "\n", -1), cut)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("body")
    ).where(F.col("body").isNotNull())


def line_chunks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 4
) -> DataFrame:
    """One row per chunk: id, text_hash, start, n, body."""
    rows = _keyed(docs, id_col, text_col)
    return rows.select("id", "text_hash", F.inline(chunk_spans(F.col("body"), divisor)))


def repeated_chunks(chunks: DataFrame, min_lines: int = 2) -> DataFrame:
    """md5 and first place of each chunk text of ``min_lines`` lines or more that occurs more than once."""
    exact = (
        chunks.where(F.col("n") >= min_lines)
        .groupBy(F.md5("body").alias("md5"), "body")
        .agg(F.min(F.struct("id", "text_hash", "start")).alias("first"), F.count(F.lit(1)).alias("times"))
    )
    return (
        exact.groupBy("md5")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.max("times").alias("times"))
        .where("texts = 1 AND times > 1")
        .select("md5", "first")
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    divisor: int = 4,
    min_lines: int = 2,
    into: str = "line_dedup",
) -> DataFrame:
    """``docs`` with ``text_col`` shortened, and a struct column ``into`` (n_lines, n_removed)."""
    chunks = line_chunks(docs, id_col, text_col, divisor)
    places = chunks.where(F.col("n") >= min_lines).select(
        F.md5("body").alias("md5"), F.struct("id", "text_hash", "start").alias("place")
    )
    removals = (
        places.join(durable(repeated_chunks(chunks, min_lines)), "md5")
        .where(F.col("place") != F.col("first"))
        .groupBy(F.col("place.id").alias("__id"), F.col("place.text_hash").alias("__text_hash"))
        .agg(F.collect_set("place.start").alias("__starts"))
    )
    text = docs[text_col]
    joined = docs.join(
        removals, docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__text_hash")), "left"
    )
    cut = F.filter(chunk_spans(text, divisor), lambda c: ~F.array_contains(F.col("__starts"), c["start"]))
    kept = F.when(F.col("__starts").isNull(), text).otherwise(
        F.array_join(F.transform(cut, lambda c: c["body"]), "\n")
    )
    gone = F.coalesce(
        F.aggregate(
            F.filter(chunk_spans(text, divisor), lambda c: F.array_contains(F.col("__starts"), c["start"])),
            F.lit(0),
            lambda total, c: total + c["n"],
        ),
        F.lit(0),
    )
    columns = [docs[c] if c != text_col else kept.alias(c) for c in docs.columns]
    lines = F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0))
    lines = F.when(text.isNull(), F.lit(0)).otherwise(lines)
    return joined.select(
        *columns,
        F.struct(
            lines.cast("long").alias("n_lines"),
            F.when(F.col("__starts").isNull(), F.lit(0)).otherwise(gone).cast("long").alias("n_removed"),
        ).alias(into),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns: doc_id, n_lines, n_removed, kept_sha256."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("line_dedup.n_lines").alias("n_lines"),
        F.col("line_dedup.n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, md5(text) AS th, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l),
r AS (
  SELECT *, (h + 31 * coalesce(lag(h, 1) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % 4 = 0 AS cut
  FROM h WINDOW w AS (PARTITION BY doc_id, th ORDER BY i)),
c AS (
  SELECT *, coalesce(sum(CASE WHEN cut THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id, th ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
  FROM r),
chunk AS (
  SELECT doc_id, th, k, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body
  FROM c GROUP BY ALL),
ranked AS (
  SELECT *, CASE WHEN n >= 2 THEN row_number() OVER (PARTITION BY body, n >= 2 ORDER BY doc_id, start) ELSE 1 END AS rn
  FROM chunk),
kept AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines,
         CAST(sum(CASE WHEN rn > 1 THEN n ELSE 0 END) AS BIGINT) AS n_removed,
         sha256(coalesce(string_agg(body, chr(10) ORDER BY start) FILTER (WHERE rn = 1), '')) AS kept_sha256
  FROM ranked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
