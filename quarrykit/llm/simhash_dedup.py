r"""Near-duplicates by 64-bit SimHash, found by a grid join over segment popcounts.

Fingerprint: ASCII-lower-cased text, words ``[^\x20\x09-\x0D]+``, shingles of k words joined by one space, repeats
included (a shorter text is one shingle; no word gives zero); a bit is set where over half of the shingles' XXH64
(seed 42) have it. Two fingerprints link at Hamming distance 3 or less.

Embedding: the 64 bits are 32 segments of two, and a fingerprint maps to its 32 bit counts (0 to 2). Manhattan
distance between count vectors never exceeds Hamming distance. The 32 dimensions lie in six blocks; at distance 3
or less, at least three blocks have equal counts, so every linked pair meets in one of the 20 grid cells given by three
blocks' counts. Inside a cell, pairs pass the Manhattan bound first and then the exact test. Nothing is capped: a
cell of more than ``tile`` fingerprints is dealt out as tiles (pairs of sub-cells), each a task-sized comparison.

Equal fingerprints collapse before the join and each cell yields the links of a spanning forest to the
smallest ids, not all pairs, so a group of copies costs one row and a group of near copies a linear number of links.

Defined cases: a null text counts as empty; all empty texts share fingerprint zero and link like others; a null doc_id
is in no component unless its text's fingerprint has other ids (then theirs), else null; repeated rows give equal rows;
other columns play no part; an empty table gives an empty result.

With ``least``, texts whose shingle sets (as XXH64 values) have a Jaccard similarity of ``least`` or more link as well, every
such pair: two sets of n shingles can only be so similar if they share one of the n - ceil(least n) + 1 that come first
in an order common to all texts. Any order is right; rare shingles come first (counts in ``SLOTS`` slots), so few texts meet.
Only those first shingles travel, and of them only the shared ones go on. In ``TURNS`` rounds each text is compared with one text of
another component, of those chosen for its shingles the one it shares most with, which settles groups of near copies with few
comparisons a text; then all texts of different components that still share a first shingle are compared. Both look at sizes and parity bitmaps of the sets first. Both compare whole sets, made again from the texts concerned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import attach, by_shuffle, durable, partitions_for
from ._ids import minus, only
from ._sums import summed
from ._text import byte_texts

SEED, BITS, MAX_DISTANCE = 42, 64, 3
#: Six blocks of 2-bit segments (in segments): 32 in all.
BLOCKS = (6, 6, 5, 5, 5, 5)
#: Three of six blocks: a pair differs in at most three.
CELLS = tuple(combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_DISTANCE))
#: Fingerprints of one cell compared in one piece.
TILE = 4096
#: Cells up to this size are compared many at a time.
SMALL = 64
#: Slots of the shingle counts that give the order of shingles.
SLOTS = 1 << 18
#: Longs of a shingle set's bitmap.
MAP = 8
#: Texts whose shingles a task holds at a time.
PART = 64
#: Rounds in which a text meets one other, before the texts of different components meet.
TURNS = 2
#: Similarity of shingle sets from which texts count as near-duplicates (the fingerprints alone: None).
LEAST = 0.8
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Texts of a component with a first shingle up to which they meet those of other components by that shingle alone; of larger ones the components meet first.
TOGETHER = 16


def shingles(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()
    n = max(1, len(words) - k + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(body[a:b], SEED) for a, b in zip(starts[:n], stops[min(k, len(words)) - 1 :], strict=True)), np.uint64, n
    )


def fingerprint(text: bytes, k: int) -> int:
    return majority(shingles(text, k))


def majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "little")


def fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint's bits as a signed long)."""
    attach(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bodies in byte_texts(batches):
            fps = np.array([fingerprint(b, k) for b in bodies], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return rows.mapInArrow(run, "id long, fp long")


def shingle_counts(docs: DataFrame, k: int, text_col: str = "text") -> np.ndarray:
    """How many shingles fall in each of ``SLOTS`` slots."""
    attach(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        found = np.zeros(SLOTS, np.int64)
        for _, bodies in byte_texts(batches, text=0, rows=PART):
            for body in bodies:
                np.add.at(found, (shingles(body, k) % np.uint64(SLOTS)).astype(np.int64), 1)
        return [found]

    return summed(docs.select(F.col(text_col).cast("string").alias("body")), count).get(0, np.zeros(SLOTS)).astype(np.float32)


def bitmap(hashes: np.ndarray) -> list[int]:
    """A set's parity bitmap: each shingle turns one bit over, so maps of two sets differ in no more bits than the sets in shingles."""
    turned = np.bincount((hashes >> np.uint64(40)) % np.uint64(64 * MAP), minlength=64 * MAP) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def first_shingles(hashes: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """Those of a set, rarest first, of which any set with a Jaccard similarity of ``least`` shares one."""
    n = len(hashes)
    order = np.lexsort((hashes, counts[(hashes % np.uint64(SLOTS)).astype(np.int64)]))
    return hashes[order[: n - math.ceil(least * n - 1e-9) + 1]]


def prefixes(docs: DataFrame, k: int, counts: np.ndarray, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, key (MD5 of the shingle set), n (its size), bits (its ``bitmap``), tokens (its first shingles)."""
    attach(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bodies in byte_texts(batches, rows=PART):
            every = [shingles(b, k) for b in bodies]
            fps = np.array([majority(h) for h in every], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in every]
            keys = [hashlib.md5(x.tobytes(), usedforsecurity=False).digest() for x in sets]
            tokens = [first_shingles(x, counts, least).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(fps, pa.int64()), pa.array(keys, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x) for x in sets], pa.list_(pa.int64())), pa.array(tokens, pa.binary())],
                ["id", "fp", "key", "n", "bits", "tokens"],
            )

    return rows.mapInArrow(run, "id long, fp long, key binary, n long, bits array<long>, tokens binary")


def shingle_sets(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, hashes (the set of shingle hashes)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bodies in byte_texts(batches, rows=PART):
            sets = [np.unique(shingles(b, k)).view(np.int64) for b in bodies]
            keys = [hashlib.md5(x.tobytes(), usedforsecurity=False).digest() for x in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["id", "key", "hashes"])

    return rows.mapInArrow(run, "id long, key binary, hashes array<long>")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments: each count lies in its segment's own two bits (00, 01 or 10)."""
    low = np.uint64(0x5555555555555555)
    return (fps & low) + ((fps >> np.uint64(1)) & low)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance between count vectors of ``segment_counts``.

    With c = high + low over {00, 01, 10}: counts 0 and 2 differ by 2, all other unequal counts by 1.
    """
    low = np.uint64(0x5555555555555555)
    x = a ^ b  # 01: 0-1; 10: 0-2; 11: 1-2
    both = x & (x >> np.uint64(1)) & low
    high_only = (x >> np.uint64(1)) & ~x & low
    low_only = x & ~(x >> np.uint64(1)) & low
    count = np.bitwise_count
    return count(both) + count(low_only) + 2 * count(high_only)


def _cell_masks() -> list[int]:
    edges = np.cumsum((0, *BLOCKS)) * 2
    block = [((1 << int(hi)) - 1) ^ ((1 << int(lo)) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(block[i] for i in cell) for cell in CELLS]


def grid_cells(distinct: DataFrame) -> DataFrame:
    """fp, rep and one ``cell`` key per choice of three blocks."""
    low = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned("fp", 1)
    one, two = F.col("fp").bitwiseXOR(high).bitwiseAND(low), F.col("fp").bitwiseAND(high).bitwiseAND(low)
    counts = one.bitwiseOR(F.shiftleft(two, 1))  # as in segment_counts, without a sum that may overflow
    signed = [m - (1 << 64) if m >> 63 else m for m in _cell_masks()]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    return distinct.withColumn("counts", counts).select("fp", "rep", F.explode(keys).alias("cell"))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints lie within the distance: the Manhattan bound first, then the exact test on what it leaves."""
    close = manhattan(segment_counts(a), segment_counts(b)) <= MAX_DISTANCE
    if close.any():
        close &= np.bitwise_count(a ^ b) <= MAX_DISTANCE
    return close


def links_of_large(fps: np.ndarray, reps: np.ndarray, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links (rep, smallest rep of its group) among fingerprints of one cell, by a search from the smallest rep outwards."""
    left = np.argsort(reps, kind="stable")
    members, smallest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left):
        seed, left = left[0], left[1:]
        edge = np.array([seed])
        while len(edge) and len(left):
            take = max(1, cells // len(left))
            found = near(fps[edge[:take], None], fps[None, left]).any(axis=0)
            new, left = left[found], left[~found]
            members.append(reps[new])
            smallest.append(np.full(len(new), reps[seed]))
            edge = np.concatenate((edge[take:], new))
    return np.concatenate(members), np.concatenate(smallest)


def links_of_small(key: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same over many cells of at most ``SMALL`` fingerprints at once: rows d apart in one cell, for each d."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = parent.get(up, up)
            i = up
        return i

    for d in range(1, SMALL):
        at = np.flatnonzero(key[d:] == key[:-d])
        if not len(at):
            break
        for i in at[near(fps[at], fps[at + d])].tolist():
            a, b = root(i), root(i + d)
            if a != b:
                a, b = (a, b) if reps[a] <= reps[b] else (b, a)
                parent[a], parent[b] = a, a
    moved = [i for i in parent if root(i) != i]
    return reps[moved], reps[[root(i) for i in moved]]


def cell_links(key: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
    """Links of all cells; ``key`` (cell, tile) is sorted."""
    number = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]).any(axis=1))))
    sizes = np.bincount(number)
    ends = np.cumsum(sizes)
    found = [links_of_large(fps[ends[k] - sizes[k] : ends[k]], reps[ends[k] - sizes[k] : ends[k]]) for k in np.flatnonzero(sizes > SMALL)]
    small = (sizes[number] <= SMALL) & (sizes[number] > 1)
    found.append(links_of_small(number[small], fps[small], reps[small]))
    a, b = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, tile), one cell after the other; a cell may reach over several batches."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, tile, fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        held.append((np.stack([cell, tile], axis=1), fp.view(np.uint64), rep))
        last = held[-1][0][-1]
        if (held[-1][0][0] == last).all():
            continue  # the batch's one cell goes on
        key, fps, reps = (np.concatenate(c) for c in zip(*held, strict=True))
        end = int(np.flatnonzero((key != last).any(axis=1))[-1]) + 1
        yield cell_links(key[:end], fps[:end], reps[:end])
        held = [(key[end:], fps[end:], reps[end:])]
    if held:
        yield cell_links(*(np.concatenate(c) for c in zip(*held, strict=True)))


def near_links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) between ids of fingerprints within the distance: a spanning forest of each cell or tile."""
    cells = grid_cells(distinct)
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tile).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    tiled = (
        cells.join(by_shuffle(sizes.withColumn("parts", parts)), "cell")
        .withColumn("own", own)
        .withColumn("other", other)
        .select("cell", (F.greatest("own", "other") * F.col("parts") + F.least("own", "other")).alias("tile"), "fp", "rep")
    )
    n = partitions_for(distinct)
    return tiled.repartition(n, "cell", "tile").sortWithinPartitions("cell", "tile").mapInArrow(_compare, "a long, b long")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, id, place) of (id, n, tokens); n and the place lie in one number."""
    for batch in batches:
        for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            tokens = [np.frombuffer(raw, np.int64) for raw in part.column(2).to_pylist()]
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = np.repeat(part.column(1).to_numpy(), sizes)
            ids = np.repeat(part.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([np.zeros(0, np.int64), *tokens]), ids, n << 32 | at)], ["token", "id", "place"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by token, whose token occurs more than once."""
    held, sent = None, False
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch])
        token = table.column(0).to_numpy()
        if not len(token):
            continue
        same = token[1:] == token[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        last = bool(keep[-1])
        if sent:
            keep[0] = False
        yield from table.filter(pa.array(keep)).combine_chunks().to_batches()
        held, sent = table.slice(len(token) - 1).combine_chunks().to_batches()[0], last  # its token may go on


def _size(side: str) -> Column:
    return F.shiftright(F.col(f"{side}.place"), 32)


def _place(side: str) -> Column:
    return F.col(f"{side}.place").bitwiseAND(F.lit((1 << 32) - 1))


def _smaller() -> Column:
    """Whether a's set is the smaller one (of equal sizes, that of the smaller id)."""
    return (_size("a") < _size("b")) | ((_size("a") == _size("b")) & (F.col("a.id") < F.col("b.id")))


def _met(rows: DataFrame, least: float) -> DataFrame:
    """id_a, c_a, id_b, c_b, times: pairs of ``rows`` (structs a and b, one row a shared first shingle) that may be similar.

    Sets that are similar enough differ in at most (1 - least) / (1 + least) of their shingles, so their bitmaps differ in no more bits.
    The first shingle that two such sets share stands among the first n - ceil(2 least / (1 + least) n) + 1 of the smaller one (which are fewer than
    its first shingles), so only rows where it does count. A shingle of both that does not count lies behind those of the smaller or the first
    of the other, so no pair shares more than the shingles that count and the greater of the two remainders.
    """
    first = _smaller()
    n, other = F.when(first, _size("a")).otherwise(_size("b")), F.when(first, _size("b")).otherwise(_size("a"))
    shared = 2 * least / (1 + least)
    early = F.when(first, _place("a")).otherwise(_place("b")) <= n - F.ceil(shared * n - 1e-9)
    alike = n >= least * other - 1e-9
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.get("a.bits", F.lit(i)).bitwiseXOR(F.get("b.bits", F.lit(i)))) for i in range(MAP)])
    close = apart <= (1 - least) / (1 + least) * (n + other) + 1e-9
    pairs = rows.where(alike & early & close).groupBy(F.col("a.id").alias("id_a"), F.col("a.c").alias("c_a"), F.col("b.id").alias("id_b"), F.col("b.c").alias("c_b"))
    counted = pairs.agg(F.count(F.lit(1)).alias("times"), F.max(n).alias("n"), F.max(other).alias("other"))
    rest = F.greatest(F.ceil(shared * F.col("n") - 1e-9), F.ceil(least * F.col("other") - 1e-9)) - 1
    return counted.where(F.col("times") + rest >= least / (1 + least) * (F.col("n") + F.col("other")) - 1e-9).drop("n", "other")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the components of pairs (id_a, id_b, c_a, c_b) of texts that are similar."""
    left, right = (by_shuffle(sets.select(F.col("id").alias(i), F.col("hashes").alias(h))) for i, h in (("id_a", "x"), ("id_b", "y")))
    both = pairs.join(left, "id_a").join(right, "id_b")

    same = F.size(F.array_intersect("x", "y"))
    return both.where(same >= least * (F.size("x") + F.size("y") - same) - 1e-9).select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))


def set_links(docs: DataFrame, prints: DataFrame, labelled: DataFrame, k: int, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) between components of ``labelled`` (fp, component_id) that hold texts with similar shingle sets."""
    rows = prints.where("id IS NOT NULL")
    by_key = durable(rows.select("key", "fp", "id", "bits").groupBy("key", "fp").agg(F.min("id").alias("id"), F.first("bits").alias("bits")).join(by_shuffle(labelled), "fp").select("key", "id", F.col("component_id").alias("c"), "bits"))
    named = durable(by_key.groupBy("key").agg(F.min(F.struct("id", "c")).alias("one"), F.first("bits").alias("bits")).select("key", "one.*", "bits"))
    equal = by_key.join(by_shuffle(named.select("key", F.col("c").alias("b"))), "key").where("c <> b").select(F.col("c").alias("a"), "b")

    copies = rows.select("key", "id").join(by_shuffle(named.select("key", F.col("id").alias("one"))), "key").where("id <> one").select("id").distinct()
    one = minus(rows.select("id", "n", "tokens"), "id", copies.join(by_shuffle(named.select("id")), "id", "left_anti"))
    tokens = one.select("id", "n", "tokens").mapInArrow(_exploded, "token long, id long, place long")
    parts = partitions_for(docs)
    shared = tokens.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(_repeated, "token long, id long, place long")
    shared = durable(shared.join(by_shuffle(named.select("id", "c", "bits")), "id"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id"))
        sets = durable(shingle_sets(only(docs.select(id_col, text_col), id_col, ids), k, id_col, text_col))
        repeated = not sets.groupBy("id", "key").count().where("count > 1").isEmpty()
        return sets.dropDuplicates(["id", "key"]) if repeated else sets  # of repeated rows one each is enough

    now, links = shared, equal
    for turn in range(TURNS):  # each text meets one other at a time, so a group of near copies falls together without all its pairs
        order = F.xxhash64("id", F.lit(turn)).alias("order")
        chosen = now.groupBy("token").agg(F.min(F.struct(order, "id", "place", "c", "bits")).alias("b"))
        star = now.select("token", F.struct("id", "place", "c", "bits").alias("a")).join(by_shuffle(chosen), "token").where("a.c <> b.c")
        times = _met(star, least)
        best = times.groupBy("id_a", "c_a").agg(F.max(F.struct("times", (-F.col("id_b")).alias("first"), "c_b")).alias("best"))
        pairs = durable(best.select("id_a", (-F.col("best.first")).alias("id_b"), "c_a", "best.c_b"))
        found = _similar(pairs, sets_of(pairs), least)
        found = durable(found.unionByName(equal) if not turn else found)
        links = found if not turn else links.unionByName(found)
        if found.isEmpty():
            break
        moved = components(found)
        now = durable(now.join(by_shuffle(moved), F.col("c") == F.col("node"), "left").select("token", "id", "place", F.coalesce("component", "c").alias("c"), "bits"))

    mixed = now.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("token")
    now = durable(now.join(by_shuffle(mixed), "token", "left_semi"))
    whole = F.struct("id", "place", "c", "bits")
    each = now.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
    small = now.join(by_shuffle(each.where(F.col("k") <= TOGETHER).drop("k")), ["token", "c"], "left_semi").select("token", whole.alias("a"))
    few = small.join(by_shuffle(small.withColumnRenamed("a", "b")), "token").where("a.c < b.c").select("token", "a", "b")
    large = each.toDF("token", "c_a", "k_a").join(by_shuffle(each.toDF("token", "c_b", "k_b")), "token").where((F.col("c_a") < F.col("c_b")) & (F.greatest("k_a", "k_b") > TOGETHER))
    a, b = now.select("token", F.col("c").alias("c_a"), whole.alias("a")), now.select("token", F.col("c").alias("c_b"), whole.alias("b"))
    pairs = few  # the smaller component's texts come first, those of the larger one with the conditions of ``_met``
    for meet, one, other in ((large.where("k_a <= k_b"), (a, "c_a"), (b, "c_b")), (large.where("k_a > k_b"), (b, "c_b"), (a, "c_a"))):
        pairs = pairs.unionByName(meet.join(by_shuffle(one[0]), ["token", one[1]]).join(by_shuffle(other[0]), ["token", other[1]]).select("token", "a", "b"))
    pairs = durable(_met(pairs, least).drop("times"))
    return links.unionByName(_similar(pairs, sets_of(pairs), least))


def near_groups(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text", least: float | None = LEAST) -> DataFrame:
    """One row per input row: ``id_col``, fp, component_id; with ``least`` also by similarity of the shingle sets."""
    if least is None:
        prints = durable(fingerprints(docs, k, id_col, text_col))
    else:
        prints = durable(prefixes(docs, k, shingle_counts(docs, k, text_col), least, id_col, text_col))
    distinct = durable(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    groups = components(near_links(distinct.where("rep IS NOT NULL")))
    labelled = distinct.join(by_shuffle(groups), F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    if least is not None:
        labelled = durable(labelled)
        wider = components(set_links(docs, prints, labelled, k, least, id_col, text_col))
        labelled = labelled.join(by_shuffle(wider), F.col("component_id") == F.col("node"), "left").select(
            "fp", F.coalesce("component", "component_id").alias("component_id")
        )
    return prints.select("id", "fp").join(by_shuffle(labelled), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def dedup(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id (rows without an id stay)."""
    groups = near_groups(docs, k, id_col, text_col, least)
    groups = durable(groups.select(F.col(id_col).alias("id"), "component_id").where("id IS NOT NULL").distinct())
    keep = groups.where("id = component_id").select("id")
    return minus(docs, id_col, groups.where("id <> component_id").select("id").join(by_shuffle(keep), "id", "left_anti"))


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns: doc_id, fingerprint (16 hex digits), component_id."""
    groups = near_groups(docs.select("doc_id", "text"), k=3, least=None)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
