"""Token counts of every prefix of every text, by dynamic programming over prefixes.

Within one pre-token, the byte-pair encoding of a prefix of i bytes is the encoding of a shorter prefix plus one last
token: the only vocabulary token that ends at i and that the merge rules leave standing beside the shorter prefix's
own last token. So ``count[i] = count[i - len(token)] + 1`` and one pass gives all prefixes. Pre-tokens add up along
the text. Three places where cutting a text changes the pre-tokens before the cut are handled apart: the last
character of a white-space run, the inside of a contraction, and the inside of a special string (encoded directly).

The result stores, for each text, the exact count for every prefix as little-endian int32 (one per code point), so
truncation and budget questions (``within_budget``, ``tokens_before``) need no further encoding. Counts are those of
the library for the ``.json`` file, special strings as its default, without added tokens or truncation.

Defined cases: a null text counts as empty (no prefix, 0 tokens); ids pass through, null or repeated; other columns
play no part; an empty table gives an empty result. A memo of distinct parts bounds each worker's memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import attach
from ._text import texts
from ._tokens import PARTS, SPACE, Memo, vocabulary, vocabulary_path

LEADING = re.compile(f"[{SPACE}]+")
CONTRACTIONS = ("'re", "'ve", "'ll")
PLAIN = re.compile(" ?[A-Za-z]+")
#: Parts in a generation of the memo: working a part out costs far more here than keeping it (about 200 bytes).
GENERATION = 450_000


class PrefixCounter:
    """Prefix counts of one part (white space and the visible run after it)."""

    def __init__(self, path: str):
        self.tokenizer = vocabulary(path)
        self.model, self.pre = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.tokens = set(self.tokenizer.get_vocab(with_added_tokens=False))
        self.longest = max(map(len, self.tokens))
        self.space = self.pre.pre_tokenize_str(" ")[0][0]
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.beside: dict[tuple[str, str], bool] = {}

    def stand(self, left: str, right: str) -> bool:
        """Whether the merge rules leave the two tokens beside each other as they are."""
        pair = (left, right)
        if (known := self.beside.get(pair)) is None:
            if len(self.beside) > 1_000_000:
                self.beside.clear()
            wanted = [left, right] if left else [right]
            known = self.beside[pair] = [t.value for t in self.model.tokenize(left + right)] == wanted
        return known

    def pretoken(self, mapped: str) -> list[int]:
        """count[i] for the first i of the pre-token's bytes (one character each in ``mapped``)."""
        last, count = [""], [0]
        tokens, beside = self.tokens, self.beside
        for end in range(1, len(mapped) + 1):
            for start in range(max(0, end - self.longest), end):
                token = mapped[start:end]
                if token in tokens:
                    stands = beside.get((last[start], token))
                    if stands if stands is not None else self.stand(last[start], token):
                        last.append(token)
                        count.append(count[start] + 1)
                        break
            else:
                raise ValueError(f"no token ends at byte {end} of {mapped!r}")
        return count

    def ordinary(self, segment: str) -> list[int]:
        """Counts of every code-point prefix (from 1) of a segment without special strings."""
        if PLAIN.fullmatch(segment):  # one pre-token, a byte a character
            return self.pretoken(segment.replace(" ", self.space))[1:]
        out: list[int] = []
        base = 0
        for mapped, (start, end) in self.pre.pre_tokenize_str(segment):
            count = self.pretoken(mapped)
            at = 0
            for char in segment[start:end]:
                at += len(char.encode())
                out.append(base + count[at])
            if segment[start:end] in CONTRACTIONS:
                out[-2] = base + 2
            base += count[-1]
        if run := LEADING.match(segment):
            total = 0
            whole = self.pretoken("".join(m for m, _ in self.pre.pre_tokenize_str(run[0])))
            for k, char in enumerate(run[0]):
                total += len(char.encode())
                out[k] = whole[total]
        return out

    def part(self, part: str) -> list[int]:
        if self.special is None or not self.special.search(part):
            return self.ordinary(part)
        out: list[int] = []
        base = 0
        for k, segment in enumerate(self.special.split(part)):
            if k % 2:
                inside = range(len(out) + 1, len(out) + len(segment))
                out += [len(self.tokenizer.encode(part[:i], add_special_tokens=False).ids) for i in inside] + [base + 1]
                base += 1
            elif segment:
                out += [base + n for n in self.ordinary(segment)]
                base = out[-1]
        return out


_memos: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    if path not in _memos:
        counter = PrefixCounter(path)
        _memos[path] = Memo(lambda parts: [packed(counter.part(p)) for p in parts], GENERATION)
    return _memos[path]


def packed(counts: list[int]) -> bytes | np.ndarray:
    """A byte per count, in all parts but very long ones."""
    return bytes(counts) if max(counts) < 256 else np.asarray(counts, "<i4")


def prefix_array(text: str, path: str) -> np.ndarray:
    """Token count of ``text[:i]`` for i from 1 to len(text)."""
    parts = memo(path).values(PARTS.findall(text))
    if not parts:
        return np.zeros(0, "<i4")
    ends = np.fromiter((p[-1] for p in parts), np.int64, len(parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    if all(type(p) is bytes for p in parts):
        inside = np.frombuffer(b"".join(parts), np.uint8)
    else:
        inside = np.concatenate([np.frombuffer(p, np.uint8) if type(p) is bytes else p for p in parts])
    return (inside + np.repeat(np.cumsum(ends) - ends, sizes)).astype("<i4")


def prefix_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_file: str | None = None
) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and ``prefixes`` (binary, an int32 per code point)."""
    path = vocabulary_file or vocabulary_path("byte_bpe_50k.json")
    attach(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, strings in texts(batches, rows=64):
            arrays = [prefix_array(t, path) for t in strings]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(t.encode()) for t in strings], pa.int64()),
                    pa.array([int(a[-1]) if len(a) else 0 for a in arrays], pa.int64()),
                    pa.array([a.tobytes() for a in arrays], pa.binary()),
                ],
                ["id", "n_bytes", "n_tokens", "prefixes"],
            )

    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, prefixes binary").withColumnRenamed("id", id_col)


def tokens_before(prefixes: Column, chars: Column) -> Column:
    """Exact token count of the first ``chars`` code points (1 or more), read from the stored bytes."""
    at = (chars - 1) * 4
    little = F.concat(*[F.hex(F.substring(prefixes, at + k, F.lit(1))) for k in (4, 3, 2, 1)])
    return F.conv(little, 16, 10).cast("long")


def within_budget(counted: DataFrame, budget: int, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, n_chars: code points of the longest prefix of each text that takes at most ``budget`` tokens."""

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for raw in batch.column(1).to_pylist():
                fits = np.flatnonzero(np.frombuffer(raw, "<i4") <= budget)
                ends.append(int(fits[-1]) + 1 if len(fits) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.int64())], ["id", "n_chars"])

    kind = dict(counted.dtypes)[id_col]
    return counted.select(id_col, "prefixes").mapInArrow(longest, f"id {kind}, n_chars long").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, limit: int = 1024) -> DataFrame:
    """The registered query's columns: doc_id, n_bytes, n_tokens, over_limit."""
    counted = prefix_counts(docs.select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
