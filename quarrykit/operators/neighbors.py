"""Exact neighbours and similar pairs without comparing all blocks, and similar pairs from hyperplane signatures.

Vectors fall into cells around centres (spherical k-means over a bounded sample; about as many as the root of their number), and cells into
blocks by the angle to their centre. By the triangle inequality of angles, no vector of a block lies nearer to a query than

    max(0, angle(query, centre) - largest angle in the block, smallest angle in the block - angle(query, centre))

so a block whose bound cannot reach a query's k-th best score (or the threshold of a pair) is never met. Nothing is lost at any shape of the data:
clustered vectors meet few blocks, vectors without structure meet them all. A query travels once to each block that it meets; a block that many
queries meet is sent to several tasks, so a task holds one block of each side.

Dot products count as scores (of unit vectors, the cosine), rounded to six digits. Vectors of zeros score 0 with every vector. Vectors of
another dimension raise an error, null vectors must be filtered out before. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach, durable, partitions_for

#: Vectors of one side in one product, and how many blocks there may be before blocks grow.
BLOCK, MOST_BLOCKS = 4096, 1 << 18
#: Bins of the angle to a cell's centre, vectors that fit the centres, and what rounding may add to a bound.
BINS, SAMPLE, SLACK = 128, 5000, 2e-6
#: Blocks that links are sought in (a vector is sent to half of them) while they hold no more than so many vectors each, axes that a pair is first weighed by, vectors weighed at a time, and pairs compared exactly at a time.
MOST_PARTS, MOST_ROWS, LEADING, STEP, PAIRS = 8, 1 << 16, 15, 128, 1 << 13
#: Share of the pairs that the leading axes leave from which whole vectors are weighed instead (after so many pairs), and pairs that a task holds before it drops those that cannot be among the best.
DENSE, WEIGHED, HELD = 1 / 32, 1 << 20, 1 << 21
#: All pairs are met in blocks where bands would compare more than one in so many of them.
ONE_IN = 16
#: Bands of signatures, the bits of one, and the products of a bucket that are held at a time.
MOST_BANDS, MOST_BITS, CELLS = 256, 24, 1 << 21


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def upto(n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))


def kmeans(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centres by spherical k-means over a sample."""
    c = x[np.random.default_rng(3).choice(len(x), min(cells, len(x)), replace=False)] if len(x) else np.zeros((1, 1))
    for _ in range(rounds if len(x) else 0):
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def drawn(vectors: DataFrame, total: int, sample: int = SAMPLE) -> np.ndarray:
    """At most twice ``sample`` vectors of (id, embedding), drawn by a hash of the id."""
    part = min(1.0, sample / max(1, total))
    rows = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(part * (1 << 30))).limit(2 * sample).collect()
    rows.sort(key=lambda r: r["id"])
    return np.array([r["embedding"] for r in rows], np.float64)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.linalg.norm(x, axis=1)
    return x / np.maximum(norm, 1e-300)[:, None], norm


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


@dataclass(frozen=True)
class Blocks:
    """What every task knows of the blocks: each one's cell, range of angles, range of norms and number of vectors."""

    centres: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    most: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.cell)

    def rows_at_once(self) -> int:
        """So many vectors of which a task weighs all blocks at a time."""
        return max(1, (1 << 16) // len(self))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and bin of vectors."""
        found = angles(unit(x)[0], self.centres)
        cell = found.argmin(axis=1)
        return cell, bins(found[np.arange(len(x)), cell])

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The highest score that a vector of each block can have with each of ``x``."""
        direction, norm = unit(x)
        away = angles(direction, self.centres)[:, self.cell]
        best = np.cos(np.clip(np.maximum(away - self.high, self.low - away), 0.0, np.pi))
        return norm[:, None] * np.where(best >= 0, self.most, self.least) * best + SLACK * (1 + norm[:, None] * self.most)

    def nearest(self, bound: np.ndarray, k: int) -> np.ndarray:
        """The blocks of the highest bounds that together hold k vectors."""
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        found = np.zeros(bound.shape, bool)
        np.put_along_axis(found, order, before < k, axis=1)
        return found


def bins(angle: np.ndarray) -> np.ndarray:
    return np.minimum((angle * (BINS / np.pi)).astype(np.int64), BINS - 1)


def _blocked(vectors: DataFrame, total: int, cells: int | None, size: int | None = None) -> tuple[Blocks, DataFrame]:
    """The blocks of (id, embedding), of about ``size`` vectors at most, and that table with each vector's block."""
    size = max(size or BLOCK, -(-total // MOST_BLOCKS))
    cells = cells or (1 if total <= size else max(2, min(1024, int(total**0.5))))
    centres = kmeans(unit(drawn(vectors, total))[0], cells)
    one = np.zeros((len(centres), BINS), np.int64)
    plan = Blocks(centres, one, one, *[np.zeros(0)] * 6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                direction, norm = unit(matrix(batch.column(1)))
                found = angles(direction, centres)
                cell = found.argmin(axis=1)
                angle = found[np.arange(len(norm)), cell]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(bins(angle)), pa.array(angle), pa.array(norm)], ["cell", "bin", "angle", "norm"])

    stats = vectors.select("id", "embedding").mapInArrow(count, "cell long, bin long, angle double, norm double").groupBy("cell", "bin")
    rows = stats.agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("norm").alias("least"), F.max("norm").alias("most")).collect()  # cells x bins
    first, parts = np.zeros_like(one), np.ones_like(one)
    blocks: list[list] = []
    for r in sorted(rows, key=lambda r: (r["cell"], r["bin"])):
        joins = blocks and blocks[-1][0] == r["cell"] and blocks[-1][5] + r["n"] <= size
        if joins:
            b = blocks[-1]
            b[2], b[3], b[4], b[5] = r["high"], min(b[3], r["least"]), max(b[4], r["most"]), b[5] + r["n"]
            first[r["cell"], r["bin"]] = len(blocks) - 1
        else:
            many = -(-r["n"] // size)
            first[r["cell"], r["bin"]], parts[r["cell"], r["bin"]] = len(blocks), many
            blocks += [[r["cell"], r["low"], r["high"], r["least"], r["most"], -(-r["n"] // many)] for _ in range(many)]
    cell, low, high, least, most, n = (np.array(c) for c in zip(*blocks, strict=True))
    plan = Blocks(centres, first, parts, cell.astype(np.int64), low, high, least, most, n)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = plan.place(matrix(batch.column(1)))
                block = first[at] + batch.column(2).to_numpy() % parts[at]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block)], ["id", "embedding", "block"])

    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("spread")
    return plan, vectors.select("id", "embedding", spread).mapInArrow(assign, "id long, embedding array<float>, block long")


def _kept(df: DataFrame, key: str) -> DataFrame:
    return durable(df.select(F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")))


def _met(members: DataFrame, visits: DataFrame, extra: str, size: int, met: dict | None) -> DataFrame:
    """Both sides' rows (side 0: visitors) under (block, part), a part for every ``size`` visitors of a block."""
    parts = visits.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    parts = durable(parts.select("block", F.ceil(F.col("n") / size).cast("long").alias("parts"), "n"))  # a row a block
    if met is not None:
        met["met"] = met.get("met", 0) + (parts.agg(F.sum("n")).first()[0] or 0)
    parts = F.broadcast(parts.drop("n"))
    v = visits.join(parts, "block").select("id", "embedding", extra, F.lit(0).alias("side"), "block", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    m = members.join(parts, "block").select("id", "embedding", F.lit(None).cast("long").alias(extra), F.lit(1).alias("side"), "block", F.explode(upto(F.col("parts"))).alias("part"))
    return v.unionByName(m)


def best_of_blocks(rows: DataFrame, k: int, least: float | None) -> DataFrame:
    """query_id, vec_id, score: the k best vectors (side 1) for each query (side 0) in each (block, part), one product each."""

    def best(t: pa.Table) -> pa.Table:
        side, ids = t.column("side").to_numpy(), t.column("id").to_numpy()
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        if side.min() == side.max():
            return pa.table([pa.array([], x) for x in kinds], names=["query_id", "vec_id", "score"])
        x = matrix(t.column("embedding"))
        a, b = x[side == 0], x[side == 1]
        qa, vb = ids[side == 0], ids[side == 1]
        score = np.round(a @ b.T, 6)
        order = np.argsort(vb, kind="stable")
        score, vb = score[:, order], vb[order]
        keep = np.argsort(-score, axis=1, kind="stable")[:, :k]
        at = np.repeat(np.arange(len(qa)), keep.shape[1])
        s = score[at, keep.ravel()]
        good = np.ones(len(s), bool) if least is None else s >= least
        columns = (qa[at][good], vb[keep.ravel()][good], s[good])
        return pa.table([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    return rows.groupBy("block", "part").applyInArrow(best, "query_id long, vec_id long, score double")


def knn(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, cells: int | None = None, met: dict | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: exact neighbours. ``queries``: query_id, embedding; ``vectors``: vec_id, embedding.

    A query first meets the blocks of the highest bounds that hold k vectors; its k-th best score there says which others it must meet.
    ``met`` (a dict) gets how many pairs of query and block were met and how many there are.
    """
    attach(queries.sparkSession)
    asked, kept = _kept(queries, "query_id"), _kept(vectors, "vec_id")
    total = kept.count()
    if not total:
        return ranked(asked.select(F.col("id").alias("query_id"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).limit(0), k)
    plan, members = _blocked(kept, total, cells)
    members = durable(members) if len(plan) > 1 else members

    step = plan.rows_at_once()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                row, block = np.nonzero(plan.nearest(plan.bounds(matrix(part.column(1))), k))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(block))], ["id", "embedding", "near"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                found = plan.bounds(matrix(part.column(1))) >= part.column(3).to_numpy(zero_copy_only=False)[:, None]
                for at, near in enumerate(part.column(2).to_pylist()):
                    found[at, near] = False
                row, block = np.nonzero(found)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(block), pa.array(block)], ["id", "embedding", "own", "block"])

    asked = durable(asked.mapInArrow(first, "id long, embedding array<float>, near array<long>"))
    if met is not None:
        met["all"] = asked.count() * len(plan)
    near = best_of_blocks(_met(members, asked.select("id", "embedding", F.explode("near").alias("own")).withColumn("block", F.col("own")), "own", BLOCK, met), k, least)
    if len(plan) == 1:
        return ranked(near, k)
    near = durable(near)
    floor = F.lit(-math.inf if least is None else float(least))
    kth = ranked(near, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    more = durable(asked.join(kth, "id", "left").select("id", "embedding", "near", F.greatest(floor, F.coalesce("kth", floor)).alias("floor")))
    far = best_of_blocks(_met(members, more.mapInArrow(others, "id long, embedding array<float>, own long, block long"), "own", BLOCK, met), k, least)
    return ranked(near.unionByName(far), k)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, threshold: float, recall: float | None = None, cells: int | None = None, met: dict | None = None) -> DataFrame:
    """a < b and their score of at least ``threshold``: every pair, or with ``recall`` that share of them by ``banded_pairs``.

    A vector meets the blocks from its own one on whose bound reaches the threshold.
    """
    if recall is not None:
        return banded_pairs(vectors, threshold, recall)
    kept = _kept(vectors, "vec_id")
    total = kept.count()
    if not total:
        return kept.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("score"))

    def near(t: pa.Table) -> pa.Table:
        side, ids, x = t.column("side").to_numpy(), t.column("id").to_numpy(), matrix(t.column("embedding"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = t.column("own").take(pa.array(left)).to_numpy() == t.column("block")[0].as_py()
        score = np.round(x[left] @ x[right].T, 6)
        p, q = np.nonzero(score >= threshold)
        a, b, s = ids[left[p]], ids[right[q]], score[p, q]
        keep = ~same[p] | (a < b)
        return pa.table([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(s[keep])], names=["a", "b", "score"])

    return _meetings(kept, total, threshold, cells, BLOCK, met).groupBy("block", "part").applyInArrow(near, "a long, b long, score double")


def _meetings(kept: DataFrame, total: int, threshold: float, cells: int | None, size: int, met: dict | None) -> DataFrame:
    """Rows of both sides under (block, part): a vector meets its own block and those after it whose bound reaches the threshold."""
    attach(kept.sparkSession)
    plan, members = _blocked(kept, total, cells, size)
    members = durable(members) if len(plan) > 1 else members
    if met is not None:
        met["all"] = total * (len(plan) + 1) // 2

    step = plan.rows_at_once()

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                own = part.column(2).to_numpy()
                there = np.arange(len(plan))
                found = (plan.bounds(matrix(part.column(1))) >= threshold) & (there > own[:, None])
                found[np.arange(len(own)), own] = True
                row, block = np.nonzero(found)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(own[row]), pa.array(block)], ["id", "embedding", "own", "block"])

    return _met(members, members.mapInArrow(visits, "id long, embedding array<float>, own long, block long"), "own", size, met)


def similar_links(vectors: DataFrame, threshold: float, met: dict | None = None) -> DataFrame:
    """a, b: edges with the same connected components as ``similar_pairs``, but in each task at most one a row instead of every pair.

    Blocks grow with the table (``MOST_ROWS`` at most), so what is sent grows with it too, and only beyond that with its square. A task first weighs
    pairs by their ``LEADING`` largest axes and the rest's length, which no dot product exceeds, and takes exact products of what that leaves;
    where it leaves too many (``DENSE``), by products of the whole vectors in single precision.
    """
    kept = _kept(vectors, "vec_id")
    total = kept.count()
    if not total:
        return kept.select(F.col("id").alias("a"), F.col("id").alias("b"))
    size = _large(total)

    def link(t: pa.Table) -> pa.Table:
        side, ids, x = t.column("side").to_numpy(), t.column("id").to_numpy(), matrix(t.column("embedding"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        root = np.arange(len(ids))
        short = leading(x)
        norms = np.linalg.norm(x, axis=1)
        least = _below(threshold, norms.max(), x.shape[1])
        weighed = passed = 0
        thin = whole = None
        # No pair at the threshold lies further apart than this, so not along one axis either.
        apart = np.sqrt(max(0.0, 2 * (norms.max() ** 2 - threshold))) + 1e-5 * (1 + norms.max())
        along = short[:, short.var(axis=0).argmax()]
        left, right = left[np.argsort(along[left], kind="stable")], right[np.argsort(along[right], kind="stable")]
        across, at = np.ascontiguousarray(short[right].T), 0
        while at < len(left):
            lo = np.searchsorted(along[right], along[left[at]] - apart)
            own = left[at : at + STEP]
            hi = np.searchsorted(along[right], along[own[-1]] + apart)
            at += len(own)
            if whole is None:
                found = np.flatnonzero((short[own] @ across[:, lo:hi]).ravel() >= least)
                weighed, passed = weighed + len(own) * (hi - lo), passed + len(found)
                if weighed >= WEIGHED and passed > DENSE * weighed:
                    thin = x.astype(np.float32)
                    whole = np.ascontiguousarray(thin[right].T)
            if whole is not None:
                found = np.flatnonzero((thin[own] @ whole[:, lo:hi]).ravel() >= least)
            p, q = np.divmod(found, max(1, hi - lo))
            q += lo
            p, q = own[p], right[q]
            while len(p):
                news = root[p] != root[q]
                p, q = p[news], q[news]
                a, b, p, q = p[:PAIRS], q[:PAIRS], p[PAIRS:], q[PAIRS:]
                near = np.round(np.einsum("ij,ij->i", x[a], x[b]), 6) >= threshold
                root = joined(root, a[near], b[near])
        linked = np.flatnonzero(ids[root] != ids)
        return pa.table([pa.array(ids[root[linked]], pa.int64()), pa.array(ids[linked], pa.int64())], names=["a", "b"])

    rows = _meetings(kept, total, threshold, -(-total // size), size, met)
    return rows.groupBy("block", "part").applyInArrow(link, "a long, b long")


def _large(total: int) -> int:
    """Vectors of a block where blocks grow with the table."""
    return max(BLOCK, min(MOST_ROWS, -(-total // MOST_PARTS)))


def _below(threshold: float, norm: float, dimension: int) -> np.float32:
    """What no product in single precision falls short of where the exact one, rounded, reaches ``threshold``."""
    return np.float32(threshold - max(4e-6, 1.2e-7 * dimension) * (1 + norm**2))


def _reaching(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(p, q, score) of the pairs of rows of ``left`` and ``right`` at the threshold, ``STEP`` rows of ``left`` after the other, ``PAIRS`` pairs at a time.

    Every pair is weighed in single precision; exact products are taken of those that this leaves."""
    thin = x.astype(np.float32)
    across = np.ascontiguousarray(thin[right].T)
    least = _below(threshold, np.linalg.norm(x, axis=1).max(initial=0.0), x.shape[1])
    for own in (left[i : i + STEP] for i in range(0, len(left), STEP)):
        found = np.flatnonzero((thin[own] @ across).ravel() >= least)
        for cells in (found[i : i + PAIRS] for i in range(0, len(found), PAIRS)):
            p, q = np.divmod(cells, len(right))
            p, q = own[p], right[q]
            score = np.round(np.einsum("ij,ij->i", x[p], x[q]), 6)
            keep = score >= threshold
            yield p[keep], q[keep], score[keep]


def _by_groups(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], n: int, meet: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``meet`` yields for the rows of each value of ``keys``; a task holds one group's rows and hands results on as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            key = np.stack([held.column(c).to_numpy() for c in keys], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
                if hi - lo > 1:
                    yield from meet(held.slice(lo, hi - lo))
            held = held.slice(int(cuts[-1])) if len(cuts) else held  # the last group may go on
        if held is not None and held.num_rows > 1:
            yield from meet(held)

    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def leaders(at: np.ndarray, other: np.ndarray, score: np.ndarray, k: int, bonus: float, cap: float) -> np.ndarray:
    """Which of the rows can be among the k best of their ``at`` (higher score, then smaller ``other``), in order of ``at``: scores may yet rise by up to
    ``bonus``, and none counts for more than ``cap``."""
    score = np.minimum(score, cap)
    order = np.lexsort((other, -score, at))
    at, score = at[order], score[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), at[1:] != at[:-1])))
    sizes = np.diff(np.append(start, len(at)))
    rank = np.arange(len(at)) - np.repeat(start, sizes)
    keep = rank < k
    if bonus:
        kth = np.where(sizes >= k, score[np.minimum(start + k - 1, len(at) - 1)], -np.inf)
        keep |= (score >= np.repeat(kth, sizes) - bonus - 2e-6) & (score < cap)
    return order[keep]


def similar_best(vectors: DataFrame, threshold: float, k: int, bonus: float = 0.0, cap: float = math.inf, met: dict | None = None) -> DataFrame:
    """id, other, score: pairs of at least ``threshold``, both ways, that can be among the k best of ``id`` (higher score, then smaller ``other``).

    Scores may rise by up to ``bonus`` afterwards, and none counts for more than ``cap``. A task gives out only what can be among the k best of its own
    rows, so there are more rows than the k best, but not all pairs. Blocks are those of ``similar_links``.
    """
    kept = _kept(vectors, "vec_id")
    total = kept.count()
    if not total:
        return kept.select("id", F.col("id").alias("other"), F.lit(0.0).alias("score"))
    size = _large(total)

    def batch(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["id", "other", "score"])

    def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, ids, x = t.column("side").to_numpy(), t.column("id").to_numpy(), matrix(t.column("embedding"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return
        inside = t.column("own").to_numpy(zero_copy_only=False) == t.column("block")[0].as_py()  # of visitors: their pairs come both ways
        none, most = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], HELD
        held, new, many = none, [], 0
        for p, q, s in _reaching(x, left, right, threshold):
            apart = ids[p] != ids[q]
            back = apart & ~inside[p]
            new += [(p[apart], ids[q[apart]], s[apart]), (q[back], ids[p[back]], s[back])]
            many += int(apart.sum()) + int(back.sum())
            if many > most:
                held = [np.concatenate(c) for c in zip(held, *new, strict=True)]
                best = leaders(*held, k, bonus, cap)
                held, new = [c[best] for c in held], []
                if len(best) > 4 * HELD:  # too many of nearly one score: later steps sort them out
                    yield batch(ids[held[0]], *held[1:])
                    held = none
                many, most = len(held[0]), max(HELD, 2 * len(held[0]))
        held = [np.concatenate(c) for c in zip(held, *new, strict=True)]
        best = leaders(*held, k, bonus, cap)
        if len(best):
            yield batch(ids[held[0][best]], held[1][best], held[2][best])

    rows = _meetings(kept, total, threshold, -(-total // size), size, met)
    return _by_groups(rows, ("block", "part"), ("side", "id"), partitions_for(kept, 1), meet, "id long, other long, score double")


def leading(x: np.ndarray) -> np.ndarray:
    """Rows whose dot products are never below those of ``x`` (but for rounding): the ``LEADING`` largest axes and the length of the rest."""
    if x.shape[1] <= LEADING + 1:
        return x.astype(np.float32)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :LEADING]
    front = x @ axes
    rest = np.sqrt(np.maximum(0.0, (x**2).sum(axis=1) - (front**2).sum(axis=1)))
    return np.column_stack([front, rest]).astype(np.float32)


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each row's root (the first row of its group) once rows ``a`` and ``b`` are in one group."""
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
        np.minimum.at(root, a, b)
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    return root


def bands(threshold: float, total: int, recall: float) -> tuple[int, int]:
    """(bands, bits): so many bands of so many bits that a pair at the threshold shares one with probability ``recall``.

    A band has about as many bits as leave a few vectors to a bucket; fewer where that would take more than ``MOST_BANDS`` bands.
    """
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    for bits in range(max(1, min(MOST_BITS, round(math.log2(max(2, total))) - 3)), 0, -1):
        share = min(same**bits, 1 - 1e-12)
        many = max(1, math.ceil(math.log(1 - recall) / math.log(1 - share)))
        if many <= MOST_BANDS:
            return many, bits
    return MOST_BANDS, 1


def _signed_pairs(kept: DataFrame, total: int, threshold: float, signature: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The pairs of ``banded_pairs`` from blocks of all vectors: each is sent to a few blocks, not once a band, and signatures are made where they are met."""
    size = _large(total)

    def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, ids, x = t.column("side").to_numpy(), t.column("id").to_numpy(), matrix(t.column("embedding"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return
        inside = t.column("own").to_numpy(zero_copy_only=False) == t.column("block")[0].as_py()
        keys = np.concatenate([signature(x[i : i + 512]) for i in range(0, len(x), 512)])
        for p, q, s in _reaching(x, left, right, threshold):
            once = ~inside[p] | (ids[p] < ids[q])
            p, q, s = p[once], q[once], s[once]
            shared = (keys[p] == keys[q]).any(axis=1)
            if shared.any():
                a, b = ids[p[shared]], ids[q[shared]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s[shared])], ["a", "b", "score"])

    rows = _meetings(kept, total, threshold, -(-total // size), size, None)
    return _by_groups(rows, ("block", "part"), ("side", "id"), partitions_for(kept, 1), meet, "a long, b long, score double")


def banded_pairs(vectors: DataFrame, threshold: float, recall: float = 0.95) -> DataFrame:
    """a < b and their score of at least ``threshold``, as ``similar_pairs``, but only pairs that share a band of their hyperplane signatures.

    A bit says on which side of a random plane a vector lies; two vectors agree in it with probability 1 - angle / pi. A pair that shares several
    bands is compared in all of them and given out in the first. A bucket of more than ``BLOCK`` vectors is dealt out as pairs of its parts;
    a task holds ``CELLS`` products at a time, however many of them reach the threshold. At a threshold so low that bands would compare more than one pair in
    ``ONE_IN``, all pairs are weighed in blocks (while a vector meets fewer blocks than there are bands) and those that share a band given out.
    """
    attach(vectors.sparkSession)
    kept = _kept(vectors, "vec_id")
    sizes = kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    many, bits = bands(threshold, sizes["n"], recall)
    planes = np.random.default_rng(11).normal(size=(sizes["d"] or 1, many * bits))
    weights = 1 << np.arange(bits, dtype=np.int64)

    def signature(x: np.ndarray) -> np.ndarray:
        return ((x @ planes > 0).reshape(len(x), many, bits) @ weights).astype(np.int32)

    if ONE_IN * many >= 1 << bits and 0 < sizes["n"] <= 2 * many * MOST_ROWS:
        return _signed_pairs(kept, sizes["n"], threshold, signature)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                keys = signature(matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(keys), pa.list_(pa.int32()))], ["id", "embedding", "keys"])

    signed = durable(kept.mapInArrow(sign, "id long, embedding array<float>, keys array<int>"))
    rows = signed.select("id", "embedding", "keys", F.posexplode("keys").alias("band", "key"))
    large = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    large = durable(large.select("band", "key", F.ceil(F.col("n") / BLOCK).cast("long").alias("parts")))
    large = F.broadcast(large) if large.count() <= MOST_BLOCKS else large
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    dealt = rows.join(large, ["band", "key"], "left").withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(upto(F.col("parts"))))
    dealt = dealt.select("band", "key", (F.greatest("own", "other") * F.col("parts") + F.least("own", "other")).alias("tile"), F.when(F.col("own") >= F.col("other"), 0).otherwise(1).alias("side"), F.col("parts"), "id", "embedding", "keys")

    def compare(band: int, tile: int, parts: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, x, side = table.column("id").to_numpy(), matrix(table.column("embedding")), table.column("side").to_numpy()
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[:, :band]
        across = tile // parts != tile % parts
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(len(ids)),) * 2
        step = max(1, CELLS // max(1, len(right)))
        for own in (left[i : i + step] for i in range(0, len(left), step)):
            score = np.round(x[own] @ x[right].T, 6)
            found = np.flatnonzero((score >= threshold).ravel())
            for cells in (found[i : i + PAIRS] for i in range(0, len(found), PAIRS)):
                p, q = np.divmod(cells, len(right))
                if not across:
                    once = ids[own[p]] < ids[right[q]]
                    p, q = p[once], q[once]
                for c in range(0, band, 16):
                    apart = ~(keys[own[p], c : c + 16] == keys[right[q], c : c + 16]).any(axis=1)
                    p, q = p[apart], q[apart]
                if len(p):
                    a, b = ids[own[p]], ids[right[q]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(score[p, q])], ["a", "b", "score"])

    def tile(t: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from compare(t.column("band")[0].as_py(), t.column("tile")[0].as_py(), t.column("parts")[0].as_py(), t)

    return _by_groups(dealt, ("band", "key", "tile"), ("id",), partitions_for(signed, 1), tile, "a long, b long, score double")
