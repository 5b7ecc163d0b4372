"""Packing of token sequences by shortest-pack-first over the length histogram.

1. Each text is tokenized (whole) and cut into pieces of at most ``capacity`` ids; a piece gets its rank among the
   pieces of its length in its task. The pieces are written to the shared checkpoint folder.
2. The histogram (at most ``capacity`` rows) goes to the driver, where lengths are placed longest first, each into
   the shortest pack that still has room. Packs of one make-up are one pattern with a count, so work and memory
   depend on ``capacity`` alone, not on the corpus.
3. Patterns become slots (length, ranks from-to, first sequence, offset). A piece's rank over all tasks is its task's
   base plus its rank there; the bases come from per-task counts, not from a global sort. Pieces meet their slot
   by length and rank in a broadcast join. Each length adds three patterns at most (a split one and two new ones), so
   there are at most 3 * capacity patterns, and their slots (about 10,000 in practice) do not grow with the corpus.

Defined cases: a null or empty text has the end id alone; ids pass through, null or repeated (each row is packed);
other columns play no part; an empty table gives an empty result; ties in rank fall as the checkpoint has them.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach, durable
from ._text import texts
from ._tokens import LETTER, VISIBLE, Memo, vocabulary, vocabulary_path

CAPACITY, END_ID = 2048, 1

_memos: dict[str, Memo] = {}
LETTERS = re.compile(f"[{LETTER}]+")
#: Where a string's lower case may depend on its neighbours or end in a mark.
WIDE = re.compile("[\u0130\u0250-\U0010ffff]")


class WordEncoder:
    """Ids of space-delimited parts as little-endian uint32 bytes; the vocabulary drops white space.

    A part of Latin letters alone is one pre-token, so it goes to the merge rules directly, lower-cased and with its
    bytes mapped as the library maps them. All other parts pass through the whole library.
    """

    def __init__(self, path: str):
        self.tokenizer = vocabulary(path)
        letters = [chr(c) for c in range(ord("a"), 0x250) if LETTERS.fullmatch(chr(c))]
        step = self.tokenizer.pre_tokenizer
        self.bytes_of = {ord(c): "".join(m for m, _ in step.pre_tokenize_str(c)) for c in letters}

    def __call__(self, parts: list[str]) -> list[bytes]:
        tokenize, bytes_of, ids = self.tokenizer.model.tokenize, self.bytes_of, {}
        for part in parts:
            if LETTERS.fullmatch(part):
                ids[part] = array("I", [t.id for t in tokenize(part.lower().translate(bytes_of))]).tobytes()
        rest = [p for p in parts if p not in ids]
        for part, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            ids[part] = np.asarray(e.ids, "<u4").tobytes()
        return [ids[p] for p in parts]


def memo(path: str) -> Memo:
    if path not in _memos:
        _memos[path] = Memo(WordEncoder(path))
    return _memos[path]


def token_ids(text: str, path: str, end_id: int = END_ID) -> bytes:
    if not WIDE.search(text):
        text = text.lower()  # as the library lower-cases here, and fewer distinct parts
    return b"".join(memo(path).values(VISIBLE.findall(text))) + end_id.to_bytes(4, "little")


def pieces(
    docs: DataFrame, id_col: str, text_col: str, vocabulary_file: str | None, capacity: int, keep_ids: bool
) -> DataFrame:
    """One row per piece: task, rank (among the task's pieces of that length), id, start, length, crc, doc_tokens[, ids]."""
    path = vocabulary_file or vocabulary_path("word_bpe_49k.json")
    attach(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = dict(rows.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ranks = TaskContext.get().partitionId(), Counter()
        for part, strings in texts(batches):
            out: list[tuple] = []
            for key, text in zip(part.column(0).to_pylist(), strings, strict=True):
                ids = token_ids(text, path)
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    out.append((task, ranks[length], key, start, length, zlib.crc32(piece), n, piece if keep_ids else None))
                    ranks[length] += 1
            columns = list(zip(*out, strict=True))
            kinds = [pa.int32(), pa.int64(), part.schema.field(0).type, *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["task", "rank", "id", "start", "length", "crc", "doc_tokens", "ids"],
            )

    return rows.mapInArrow(
        cut, f"task int, rank long, id {kind}, start long, length long, crc long, doc_tokens long, ids binary"
    )


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence, how many sequences): longest length first, into the shortest pack with room."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    totals: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def add(total: int, pattern: tuple[int, ...], count: int) -> None:
        if total == capacity:
            done.append((pattern, count))
            return
        if not open_packs[total]:
            insort(totals, total)
        open_packs[total].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if totals and totals[0] + length <= capacity:
                total = totals[0]
                pattern, count = open_packs[total].pop()
                if not open_packs[total]:
                    del totals[bisect_left(totals, total)]
                used = min(count, left)
                if count > used:
                    add(total, pattern, count - used)
                add(total + length, (*pattern, length), used)
            else:
                per = capacity // length
                used = left // per if left >= per else 1
                many = per if left >= per else left
                add(many * length, (length,) * many, used)
                left -= many * used
                continue
            left -= used
    return done + [x for total in totals for x in open_packs[total]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) for each place in each pattern."""
    out, next_rank, sequence = [], Counter(), 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            first = next_rank[length]
            out.append((length, first, first + count, sequence, offset))
            next_rank[length] += count
            offset += length
        sequence += count
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_file: str | None = None,
    capacity: int = CAPACITY,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    spark = docs.sparkSession
    cut = durable(pieces(docs, id_col, text_col, vocabulary_file, capacity, keep_ids))
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    places = spark.createDataFrame(
        slots(pack_histogram(histogram, capacity)),
        "slot_length long, first long, past long, sequence long, slot_offset long",
    )
    ranked = cut.join(bases, ["length", "task"]).withColumn("place", F.col("base") + F.col("rank"))
    packed = ranked.join(
        F.broadcast(places),
        (F.col("length") == F.col("slot_length")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("past")),
    )
    return packed.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        (F.col("sequence") + F.col("place") - F.col("first")).alias("sequence_id"),
        F.col("slot_offset").alias("offset"),
        *(["ids"] if keep_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids (its pieces' ids in order of offset); at most ``capacity`` ids each."""
    return (
        packed.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
        .select(
            "sequence_id",
            "n_tokens",
            F.aggregate("parts", F.lit(b""), lambda joined, p: F.concat(joined, p["ids"])).alias("ids"),
        )
    )


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", "text"))
