r"""Benchmark decontamination by latent semantic retrieval with exact checks of what it finds.

1. Words (lower-cased runs of letters and digits) hash to ``DIM`` columns; blocks of ``PASSAGE`` words are the rows of a
   TF-IDF matrix A over the whole corpus. Randomised SVD in one pass over A: each row is added, with a random sign, to one of
   ``SKETCH`` rows of a matrix B with E[B^T B] = A^T A; document frequencies and B are sums over all tasks, of bounded size
   whatever the corpus' size, and B's leading right singular vectors stand for those of A.
2. Items and windows of documents (as many words as the item, in tens, at most ``WIDEST``; every ``STEP`` words) project
   onto the vectors. A window is a candidate for an item at a cosine of
   ``COSINE``. Items longer than ``WIDEST`` words are searched by each of their passages.
3. Each candidate is settled on the words of the region around the window: the share of the item's words in the longest
   common subsequences of its sentences and the region (so sentences may change places), the same for its rarer words alone, and
   the answer's (its last sentence) share. An item counts as leaked at a share of ``SURE``, or of ``LIKELY`` with at least
   ``ANSWER`` of the answer in place, if at least ``RARE`` of its rarer words are there too. Items of few words need ``LEAST`` words.

The gate is set from step 3: a paraphrase with a share of ``SURE`` has a cosine of about that share; the README and the tests
state how many fall below the gate. Before the subsequences a count of the item's words that stand in the region, which bounds
every share from above, drops candidates that cannot be accepted.

The benchmark is a stated query set: it goes to the tasks in blocks of at most about ``BLOCK_MB`` MB of text, each a pass over
the documents. Documents never move: a document's hits come out of the task that reads it.

Defined cases: null and empty texts have no passage and no hits; texts or items shorter than a passage are one
passage; items without a word match nothing; null item ids are reported as null; repeated items each match; repeated
documents each get their hits; other columns pass through; empty tables give empty results, and an empty benchmark
no hits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach, durable
from ._sums import summed
from ._text import texts
from .substring_dedup import powers

DIM, SKETCH, RANK, PASSAGE = 1 << 13, 192, 128, 50
#: Leading directions left out of the comparison: they tell languages and registers apart, not contents.
COMMON = 5
#: Words from one window to the next, and in the widest window.
STEP, WIDEST = 10, 60
COSINE = 0.28
SURE, LIKELY, ANSWER, RARE, LEAST = 0.45, 0.4, 0.6, 0.35, 6
#: Words in a smaller share of passages than this are the rarer ones.
RARER = 0.05
#: Words of texts compared with a tile of items at a time, items in a tile, and candidates screened at a time.
RUN, TILE, SCREEN = 50_000, 2048, 4096
BLOCK_MB = 16
SLICES = 16
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_INSIDE = np.array([bool(_WORDS.match(bytes([b]))) for b in range(256)])
_ENDS = re.compile(r"[.!?\n]+")
HITS = "array<struct<item_id:long,cosine:double,shared:double,answer:double,start:long,stop:long>>"


class Words:
    """The words of some texts: columns, and the bytes of any of them; text i has the words first[i] to first[i + 1]."""

    def __init__(self, strings: list[str], piece: int = 1 << 20):
        encoded = [t.lower().encode() for t in strings]
        self.body = b"\n".join(encoded) + b"\n"
        raw = np.frombuffer(self.body, np.uint8)
        edges = np.flatnonzero(np.diff(_INSIDE[raw].astype(np.int8), prepend=0))
        self.begin, self.end = edges[::2], edges[1::2]
        bounds = np.cumsum([0] + [len(e) + 1 for e in encoded])
        self.first = np.searchsorted(self.begin, bounds)
        self.columns = np.zeros(len(self.begin), np.int64)
        at = 0
        while at < len(self.begin):  # polynomial hashes of the words in a stretch of bytes
            lo = self.begin[at]
            to = max(at + 1, int(np.searchsorted(self.end, lo + piece, "right")))
            b, e = self.begin[at:to] - lo, self.end[at:to] - lo
            up, down = powers(int(e[-1]) + 1)
            sums = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum((raw[lo : lo + e[-1]].astype(np.uint64) + np.uint64(1)) * up[: e[-1]], out=sums[1:])
            h = (sums[e] - sums[b]) * down[b]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
            self.columns[at:to] = (h >> np.uint64(64 - DIM.bit_length() + 1)).astype(np.int64)
            at = to

    def of(self, i: int) -> list[bytes]:
        return self.between(int(self.first[i]), int(self.first[i + 1]))

    def between(self, lo: int, hi: int) -> list[bytes]:
        return [self.body[a:b] for a, b in zip(self.begin[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)]


def words_of(text: str) -> list[bytes]:
    return _WORDS.findall(text.lower().encode())


def hashed_words(docs: DataFrame, text_col: str) -> DataFrame:
    """Each text's word columns (uint16) as one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, strings in texts(batches, text=0, rows=128):
            words = Words(strings)
            columns = words.columns.astype("<u2")
            out = [columns[a:b].tobytes() for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["columns"])

    return docs.select(F.col(text_col).cast("string").alias("body")).mapInArrow(run, "columns binary")


def blocks(batches: Iterator[pa.RecordBatch], words: int = 40_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(column of each word, number of its passage) of about ``words`` words at a time; passages never span texts."""
    held, count = [], 0
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            text = np.frombuffer(raw, "<u2")
            for at in range(0, len(text), words - words % PASSAGE):
                held.append(text[at : at + words - words % PASSAGE])
                count += len(held[-1])
                if count >= words:
                    yield _numbered(held)
                    held, count = [], 0
    if count:
        yield _numbered(held)


def _numbered(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    passages = -(-sizes // PASSAGE)
    first = np.cumsum(passages) - passages
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.concatenate(held).astype(np.int64), np.repeat(first, sizes) + inside // PASSAGE


def distinct(passage: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each column of a passage once."""
    each = np.sort((passage * DIM + columns).astype(np.int32))
    return np.divmod(each[np.flatnonzero(np.diff(each, prepend=-1))].astype(np.int64), DIM)


class Space:
    """``weights``: DIM + 1 rows (the last is zero, for padding) that project words weighted by idf onto the singular vectors.

    ``rare``: whether a column is in few passages.
    """

    def __init__(self, weights: np.ndarray, rare: np.ndarray):
        self.weights, self.rare = weights, rare

    def vector(self, columns: np.ndarray) -> np.ndarray:
        v = self.weights[columns].sum(0)
        return v / max(float(np.linalg.norm(v)), 1e-9)

    def step_sums(self, padded: np.ndarray) -> np.ndarray:
        """The vector of each step of ``STEP`` words; ``padded`` holds whole steps."""
        rank = self.weights.shape[1]
        sums = np.empty((len(padded) // STEP, rank), np.float32)
        for at in range(0, len(padded), 400 * STEP):
            sums[at // STEP : at // STEP + 400] = self.weights[padded[at : at + 400 * STEP]].reshape(-1, STEP, rank).sum(1)
        return sums


def fit(docs: DataFrame, text_col: str = "text") -> Space:
    """Document frequencies and randomised SVD over all texts."""
    attach(docs.sparkSession)
    hashed = durable(hashed_words(docs, text_col))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        found, n = np.zeros(DIM), 0
        for columns, passage in blocks(batches):
            found += np.bincount(distinct(passage, columns)[1], minlength=DIM)
            n += int(passage[-1]) + 1
        return [found, np.array([n])]

    sums = summed(hashed, frequencies)
    nothing = Space(np.zeros((DIM + 1, 1), np.float32), np.ones(DIM, bool))
    if not sums:  # a table without partitions
        return nothing
    total, found = sums[1][0], sums[0]
    idf = np.log((1 + total) / (1 + found)).astype(np.float32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        draw = np.random.default_rng([20240201, TaskContext.get().partitionId()])
        b = np.zeros(SKETCH * DIM)
        for columns, passage in blocks(batches):
            n = int(passage[-1]) + 1
            passage, columns = distinct(passage, columns)
            size = np.sqrt(np.bincount(passage, idf[columns] ** 2, n))
            row, sign = draw.integers(0, SKETCH, n), draw.choice([-1.0, 1.0], n)
            share = sign / np.maximum(size, 1e-6)
            np.add.at(b, row[passage] * DIM + columns, idf[columns] * share[passage])
        return np.split(b, SLICES)

    sums = summed(hashed, sketch, np.float32)
    _, scale, right = np.linalg.svd(np.concatenate([sums[k] for k in range(SLICES)]).reshape(SKETCH, DIM), full_matrices=False)
    keep = np.flatnonzero(scale[: COMMON + RANK] > 1e-6 * max(scale[0], 1e-300))
    keep = keep[COMMON:] if len(keep) > 2 * COMMON else keep
    if not len(keep):
        return nothing
    weights = idf[:, None] * right[keep].T
    return Space(np.vstack((weights, np.zeros(weights.shape[1]))).astype(np.float32), found <= RARER * total)


def common(bits: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of ``words`` and n words whose places are ``bits``."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if u := bits.get(w, 0):
            u &= v
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def places(words: list[bytes]) -> dict[bytes, int]:
    found: dict[bytes, int] = defaultdict(int)
    for i, w in enumerate(words):
        found[w] |= 1 << i
    return dict(found)


def width_of(n: int) -> int:
    """Words in the windows that are compared with an item (or passage of one) of n words."""
    return min(WIDEST, max(STEP, STEP * ((n + STEP // 2) // STEP)))


def slack_of(n: int) -> int:
    """Words on either side of a window that belong to the region."""
    return n // 4 + STEP // 2 + (n if n > WIDEST else 0)


class Item:
    """An item's words, as its rules need them."""

    def __init__(self, key: int | None, text: str, rare: np.ndarray):
        words = Words([text])
        self.key, self.columns, self.size = key, words.columns, len(words.columns)
        sentences = [w for s in _ENDS.split(text) if (w := words_of(s))]
        self.sentences = [(places(s), len(s)) for s in sentences]
        of_column = dict(zip(words.of(0), rare[words.columns].tolist(), strict=True))
        rarer = [[w for w in s if of_column[w]] for s in sentences]
        self.rarer = [(places(s), len(s)) for s in rarer if s]
        self.rare_size = sum(map(len, rarer))
        self.needed = min(1.0, LEAST / self.size) if self.size else 1.0

    def judge(self, region: list[bytes]) -> tuple[float, float] | None:
        """(share, answer's share) of an accepted region."""
        shared = sum(common(bits, n, region) for bits, n in self.sentences) / self.size
        if shared < max(LIKELY, self.needed):
            return None
        bits, n = self.sentences[-1]
        answer = common(bits, n, region) / n
        if shared < SURE and answer < ANSWER:
            return None
        if self.rare_size and sum(common(bits, n, region) for bits, n in self.rarer) < RARE * self.rare_size:
            return None
        return shared, answer


class Items:
    """One block of the benchmark, by width of its windows and in tiles."""

    def __init__(self, space: Space, rows: list[tuple[int | None, str | None]]):
        self.space = space
        self.items = [item for key, text in rows if (item := Item(key, text or "", space.rare)).size]
        shapes: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i, item in enumerate(self.items):
            parts = -(-item.size // WIDEST)
            for part in np.array_split(item.columns, parts):
                shapes[width_of(len(part))].append((i, self.space.vector(part)))
        self.tiles = []
        for width, chosen in sorted(shapes.items()):
            for at in range(0, len(chosen), TILE):
                owners = np.array([i for i, _ in chosen[at : at + TILE]])
                self.tiles.append((width, owners, np.stack([v for _, v in chosen[at : at + TILE]]).astype(np.float32)))
        self.sizes = np.array([item.size for item in self.items], np.int64)
        self.columns = np.full((len(self.items), WIDEST), DIM + 1, np.int16)
        for i, item in enumerate(self.items):
            self.columns[i, : item.size] = item.columns[:WIDEST]

    def hits(self, strings: list[str]) -> list[list[dict]]:
        words = Words(strings)
        found: list[dict[int, dict]] = [{} for _ in strings]
        run, count = [], 0
        sizes = np.diff(words.first).tolist()
        for i, n in enumerate(sizes):
            if n:
                run.append(i)
                count += n
            if run and (count >= RUN or i == len(sizes) - 1):
                self.compare(run, words, found)
                run, count = [], 0
        return [list(f.values()) for f in found]

    def compare(self, run: list[int], words: Words, found: list[dict[int, dict]]) -> None:
        """Settle the candidates of the run's texts."""
        sizes = words.first[np.array(run) + 1] - words.first[run]
        real = -(-sizes // STEP)
        steps = np.maximum(real, WIDEST // STEP)  # so that the one window of a short text ends in padding
        padded = np.full(int(steps.sum()) * STEP, DIM, np.int64)
        first = np.cumsum(steps) - steps
        for i, at, n in zip(run, (first * STEP).tolist(), sizes.tolist(), strict=True):
            padded[at : at + n] = words.columns[words.first[i] : words.first[i + 1]]
        owner = np.repeat(np.arange(len(run)), steps)
        place = np.arange(len(owner)) - first[owner]
        each = self.space.step_sums(padded)
        sums = each.copy()
        for k in range(1, WIDEST // STEP + 1):
            if k > 1:
                sums = sums[:-1]
                sums += each[k - 1 :]
            tiles = [t for t in self.tiles if t[0] == k * STEP]
            if not tiles:
                continue
            begin = np.arange(len(sums))
            inside = (place[begin] == 0) | (place[begin] + k <= real[owner[begin]])
            least = np.where(inside, np.maximum(COSINE * np.sqrt(np.einsum("ij,ij->i", sums, sums)), 1e-6), np.inf).astype(np.float32)
            for width, owners, of_items in tiles:
                for at in range(0, len(sums), 1024):
                    products = sums[at : at + 1024] @ of_items.T
                    p, q = np.divmod(np.flatnonzero(products >= least[at : at + 1024, None]), len(owners))
                    self.screen(at + p, owners[q], products[p, q] * COSINE / least[at + p], width, padded, (run, owner, place, words), found)

    def screen(self, begin: np.ndarray, items: np.ndarray, cosines: np.ndarray, width: int, padded: np.ndarray, where: tuple, found: list[dict[int, dict]]) -> None:
        """Drop candidates whose region (with neighbours' words: a bound) holds too few of the item's words; settle the rest."""
        run, owner, place, words = where
        for at in range(0, len(begin), SCREEN):
            b, i = begin[at : at + SCREEN], items[at : at + SCREEN]
            good = self.sizes[i] > WIDEST  # these are few and settled at once
            short = np.flatnonzero(~good)
            slack = slack_of(WIDEST)
            span = b[short, None] * STEP + np.arange(-slack, width + slack)
            region = padded[np.clip(span, 0, len(padded) - 1)].astype(np.int16)
            inside = (self.columns[i[short]][:, :, None] == region[:, None, :]).any(2).sum(1)
            good[short] = inside >= LIKELY * self.sizes[i[short]]
            for k in np.flatnonzero(good).tolist():
                text = run[owner[b[k]]]
                self.settle(found[text], words, text, int(i[k]), int(place[b[k]]) * STEP, width, float(cosines[at + k]))

    def settle(self, found: dict[int, dict], words: Words, text: int, number: int, begin: int, width: int, cosine: float) -> None:
        """Decide a candidate on the words around it; the best place of an item in a text is kept."""
        if (known := found.get(number)) and known["shared"] >= 0.95:
            return
        item = self.items[number]
        slack = slack_of(item.size)
        base, last = int(words.first[text]), int(words.first[text + 1])
        lo, hi = max(base, base + begin - slack), min(last, base + begin + width + slack)
        if (judged := item.judge(words.between(lo, hi))) and not (known and judged[0] <= known["shared"]):
            found[number] = {"item_id": item.key, "cosine": cosine, "shared": judged[0], "answer": judged[1], "start": lo - base, "stop": hi - base}


def annotate(docs: DataFrame, benchmark: DataFrame, space: Space | None = None, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", into: str = "leaks") -> DataFrame:
    """``docs``' columns and ``into``: the benchmark items found in each text."""
    attach(docs.sparkSession)
    space = space or fit(docs, text_col)
    size = benchmark.agg(F.sum(F.octet_length(F.col(item_text)))).first()[0] or 0
    n = max(1, -(-size // (BLOCK_MB << 20)))
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[docs[c] for c in rest], F.lit(0).alias("__")).alias("rest"), docs[text_col].cast("string").alias("body"), F.array().cast(HITS).alias("leaks"))
    kind = rows.schema["rest"].dataType.simpleString()
    for k in range(n):
        block = benchmark.where(F.pmod(F.xxhash64(item_col, item_text), F.lit(n)) == k)
        items = Items(space, sorted(((r[0], r[1]) for r in block.select(F.col(item_col).cast("long"), item_text).collect()), key=str))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for part, strings in texts(batches, rows=128):
                hits = items.hits(strings)
                leaks = [old + new for old, new in zip(part.column(2).to_pylist(), hits, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(leaks, part.column(2).type)], ["rest", "body", "leaks"])

        rows = rows.mapInArrow(run, f"rest {kind}, body string, leaks {HITS}")
    columns = [F.col("rest")[c].alias(c) if c != text_col else F.col("body").alias(c) for c in docs.columns]
    return rows.select(*columns, F.col("leaks").alias(into))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The registered query's columns: a row per document and leaked item."""
    found = annotate(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", F.round("leak.cosine", 4).alias("cosine"), F.round("leak.shared", 6).alias("shared"), F.round("leak.answer", 6).alias("answer"), "leak.start", "leak.stop"
    )
