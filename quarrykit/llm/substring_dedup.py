r"""Removal of repeated token windows by Rabin-Karp hashes counted in Spark.

Tokens are the words ``[^\x20\x09-\x0D]+``. Every window of ``size`` consecutive words of every text gets a polynomial
hash modulo 2^64 over the words' XXH64. A window is repeated if its hash also starts earlier (smaller id, or the same
document further left); repeated windows merge into maximal intervals, whose words go. Windows are judged on the
input, not on what is left of it.

How the hashes travel: a task sorts its windows by hash, settles copies that it holds itself (all but the earliest are
repeated, so a passage in a third of the corpus sends one row per task) and sends the rest as packed blobs by bucket.
The bucket is taken from the smallest hash of the ``INNER``-word runs inside the window. It depends on the window alone,
so equal windows meet; and neighbouring windows mostly share it, so positions pack as runs and answers return as
intervals. The number of buckets follows the input's size. A run of words that very many different windows share would fill one bucket:
a first pass counts all windows by run, in slots (``SLOTS`` at least, and no fewer than buckets), and windows of heavy slots take their bucket from a second hash of their own.

Hashes stand for word sequences here. Different windows are taken for equal only if they agree in 64 bits and in the bucket, which comes
from other bits, so for n windows in buckets of m about n m / 2^65 pairs are expected to: 10^-6 for 10^8 windows, 0.2 for 100 TB of text.

Defined cases: a null or empty text has no words; texts of fewer than ``size`` words stay whole; a null id orders before
all others and null ids count as one document; rows that repeat an id and text are one document, judged against others
only; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach, partitions_for
from ._sums import summed
from ._text import byte_texts

SIZE, INNER = 20, 10
#: Slots of the counts by run, and how far above a bucket's mean (in halves) or a slot's mean a heavy one lies.
SLOTS, HEAVY = 1 << 18, 4
#: Windows that a task gathers before it packs and sends them.
FLUSH = 1_000_000
BASE = 0x9E3779B97F4A7C15 | 1
NO_ID = -(1 << 63)


class Powers:
    """Powers of a base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    @staticmethod
    def series(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 12, 2 * n)
            self.up, self.down = (self.series(b, size) for b in (self.base, pow(self.base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_powers, _other = Powers(BASE), Powers(0xC2B2AE3D27D4EB4F)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    return _powers.get(n)


def rolling(words: np.ndarray, size: int, base: Powers = _powers) -> np.ndarray:
    """Hashes of all windows of ``size`` words: differences of prefix sums, shifted back to power zero, then mixed."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = base.get(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def runs(ids: np.ndarray, at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First indices and lengths of stretches of consecutive positions of one document (and equal in ``same``)."""
    cut = (ids[1:] != ids[:-1]) | (at[1:] != at[:-1] + 1)
    for x in same:
        cut |= x[1:] != x[:-1]
    first = np.concatenate(([0], np.flatnonzero(cut) + 1)) if len(ids) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(ids)))


def split_repeated(hashes: np.ndarray, ids: np.ndarray, at: np.ndarray, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the earliest window of each hash (and bucket, if given), and of those that repeat it elsewhere."""
    order = np.lexsort((at, ids, hashes) if where is None else (at, ids, where, hashes))
    h = hashes[order]
    start = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
    if where is not None:
        start[1:] |= where[order][1:] != where[order][:-1]
    first = order[start][np.cumsum(start) - 1]
    elsewhere = (ids[first] != ids[order]) | (at[first] != at[order])
    return order[start], order[elsewhere]


def intervals(ids: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, start, stop) in words of stretches of repeated windows."""
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    first, length = runs(ids, at)
    return ids[first], at[first], at[first] + length - 1 + size


def run_keys(words: np.ndarray, size: int) -> np.ndarray:
    """For each window, the smallest hash of the runs inside it, mixed."""
    inner = min(INNER, size)
    small = np.lib.stride_tricks.sliding_window_view(rolling(words, inner), size - inner + 1).min(axis=1)
    return small * np.uint64(0xA0761D6478BD642F)


def heavy_slots(docs: DataFrame, size: int, buckets: int) -> np.ndarray:
    """Whether a slot of run keys holds so many windows that they must be dealt out one by one.

    Every bucket has as many slots as any other, at least one, so what is left in a bucket is bounded by its mean at every size.
    """
    slots = buckets * max(1, -(-SLOTS // buckets))

    def count(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        found = np.zeros(slots)
        for _, bodies in byte_texts(batches):
            for body in bodies:
                words = word_hashes(body.split())
                if len(words) >= size:
                    np.add.at(found, slot_of(run_keys(words, size), slots), 1)
        return [found]

    return heavy(summed(docs, count, np.float32).get(0, np.zeros(slots)), buckets)


def heavy(counts: np.ndarray, buckets: int) -> np.ndarray:
    """Slots of over half a bucket's mean, or of over ``HEAVY`` times the slots' mean where that is more."""
    total = counts.sum()
    return counts > max(1000.0, total / (2 * buckets), HEAVY * total / len(counts))


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    """A slot's number modulo the buckets is its bucket."""
    return ((keys >> np.uint64(23)) % np.uint64(slots)).astype(np.int64)


def window_blobs(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """bucket, settled, ids, starts, lengths, hashes: runs of windows, or (settled) intervals found to be repeated."""
    dealt_out = heavy_slots(docs, size, buckets)

    def send(hashes: np.ndarray, keys: np.ndarray, ids: np.ndarray, at: np.ndarray, turn: int) -> pa.RecordBatch:
        first, repeated = split_repeated(hashes, ids, at, keys)
        rows: list[tuple] = []
        if len(repeated):
            i, start, stop = intervals(ids[repeated], at[repeated], size)
            rows.append((turn % buckets, True, i.tobytes(), start.astype("<i4").tobytes(), stop.astype("<i4").tobytes(), b""))
        order = first[np.lexsort((at[first], ids[first], keys[first]))]
        hashes, keys, ids, at = hashes[order], keys[order], ids[order], at[order]
        begin, length = runs(ids, at, keys)
        cuts = np.flatnonzero(np.diff(keys[begin])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(begin)], strict=True):
            if a < b:
                lo, hi = begin[a], begin[b] if b < len(begin) else len(keys)
                rows.append((
                    int(keys[lo]), False, ids[begin[a:b]].tobytes(), at[begin[a:b]].astype("<i4").tobytes(),
                    length[a:b].astype("<i4").tobytes(), hashes[lo:hi].tobytes(),
                ))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["bucket", "settled", "ids", "starts", "lengths", "hashes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = turn = 0
        for part, bodies in byte_texts(batches):
            for key, body in zip(part.column(0).to_pylist(), bodies, strict=True):
                words = word_hashes(body.split())
                h = rolling(words, size)
                if not len(h):
                    continue
                keys = run_keys(words, size)
                slot = slot_of(keys, len(dealt_out))
                where = slot % buckets
                if (dealt := dealt_out[slot]).any():
                    where[dealt] = (rolling(words, size, _other)[dealt] >> np.uint64(23)) % np.uint64(buckets)
                held.append((h, where.astype(np.int32), np.full(len(h), key, np.int64), np.arange(len(h))))
                count += len(h)
                if count >= FLUSH:
                    turn += 1
                    yield send(*(np.concatenate(c) for c in zip(*held, strict=True)), turn)
                    held, count = [], 0
        if held:
            yield send(*(np.concatenate(c) for c in zip(*held, strict=True)), turn)

    return docs.mapInArrow(run, "bucket int, settled boolean, ids binary, starts binary, lengths binary, hashes binary")


def repeated_intervals(
    docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None
) -> DataFrame:
    """id, start, stop: stretches of words covered by repeated windows (they may overlap); null ids appear as NO_ID."""
    attach(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("body"))
    blobs = window_blobs(rows, size, buckets or 4 * partitions_for(docs))

    def settle(table: pa.Table) -> pa.Table:
        found = []
        held: list[tuple[np.ndarray, ...]] = []
        for settled, ids, starts, lengths, hashes in zip(*(table.column(c).to_pylist() for c in ("settled", "ids", "starts", "lengths", "hashes")), strict=True):
            ids, starts, lengths = np.frombuffer(ids, np.int64), np.frombuffer(starts, "<i4"), np.frombuffer(lengths, "<i4")
            if settled:
                found.append((ids, starts.astype(np.int64), lengths.astype(np.int64)))
                continue
            begin = np.cumsum(lengths) - lengths
            at = np.arange(int(lengths.sum())) + np.repeat(starts - begin, lengths)
            held.append((np.frombuffer(hashes, np.uint64), np.repeat(ids, lengths), at))
        if held:
            hashes, ids, at = (np.concatenate(c) for c in zip(*held, strict=True))
            _, repeated = split_repeated(hashes, ids, at)
            found.append(intervals(ids[repeated], at[repeated], size))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["id", "start", "stop"])

    return blobs.groupBy("bucket").applyInArrow(settle, "id long, start long, stop long")


def dedup_substrings(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' columns but the text, and kept_text (kept words joined by a space), n_words, n_removed, removed (array<struct<start, stop>>, maximal)."""
    spans = (
        repeated_intervals(docs, size, id_col, text_col)
        .groupBy("id")
        .agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    )
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[docs[c] for c in rest]).alias("rest"), F.col(text_col).cast("string").alias("body"), F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("key"))
    joined = rows.join(spans, F.col("key") == F.col("id"), "left").select("rest", "body", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bodies in byte_texts(batches):
            out = []
            for body, starts, stops in zip(bodies, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                words = body.split()
                if not starts:
                    out.append((b" ".join(words), len(words), 0, []))
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.minimum(starts, len(words)), 1)
                np.add.at(edge, np.minimum(stops, len(words)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                bounds = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                out.append((kept, len(words), int(gone.sum()), [{"start": a, "stop": b} for a, b in bounds.tolist()]))
            kept, n_words, n_removed, removed = zip(*out, strict=True)
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, span)],
                ["rest", "kept_text", "n_words", "n_removed", "removed"],
            )

    attach(docs.sparkSession)
    kind = rows.schema["rest"].dataType.simpleString()
    found = joined.mapInArrow(cut, f"rest {kind}, kept_text string, n_words long, n_removed long, removed array<struct<start:long,stop:long>>")
    return found.select(*[F.col("rest")[c].alias(c) for c in rest], "kept_text", "n_words", "n_removed", "removed")


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns: doc_id, n_words, n_removed, kept_sha256."""
    found = dedup_substrings(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS body
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS rn FROM win)
  WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM rep),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT out) AS body, count(*) FILTER (WHERE out) AS n_removed
  FROM (SELECT words.*, gone.k IS NOT NULL AS out FROM words LEFT JOIN gone USING (doc_id, k)) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
