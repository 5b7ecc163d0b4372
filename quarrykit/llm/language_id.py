r"""Language identification by a string kernel with Nystrom landmarks and one-versus-rest kernel ridge regression.

Kernel: blended spectrum with presence. A text is the set of byte n-grams (n from 1 to 4) of its lower-cased UTF-8,
hashed to ``DIM`` places; a longer one than ``PIECE`` bytes is scored piece by piece, as a set of everything tells nothing, and its
margins are the pieces' averaged by length; k(x, y) = |x and y| / sqrt(|x| |y|). Landmarks are ``LANDMARKS`` training texts, spread over the
classes; a text's Nystrom features are its kernel values with the landmarks times the inverse root of the
landmarks' own kernel matrix, and one ridge regression per language separates it from the rest.

Scoring multiplies a batch's presence matrix with the landmark matrix folded into the regression weights (one
``DIM`` x languages matrix of bounded size that goes to each task), so whole texts of any length cost one pass.

Fitting uses a sample of at most ``FIT_ROWS`` labelled rows, as many of each language as of any other (all of rare ones), drawn by a
hash of the id, and of each row one piece; a row enters only if crc32(doc_id as text) mod 5 is not 0 and its language is not null.
The sample's presence bits (2 kB each) are all that reaches the driver.

Defined cases: a null text or one without a letter is ``und`` with score 0; with no labelled row at all, or one
language only, every text with a letter gets that language (``und`` if none) with score 0 or 1; ids pass through,
null (held out, as the empty string's crc32 is 0) or repeated; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach
from ._text import bucket, texts

NGRAMS, DIM, PIECE, LANDMARKS, FIT_ROWS = 4, 1 << 14, 4096, 256, 4000
#: Labelled rows of a language that are learned at least, however many languages there are.
MIN_ROWS = 20
#: Pieces in one matrix product.
BATCH = 128
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def pieces(text: str) -> list[np.ndarray]:
    """The bytes of a text in equal pieces of at most ``PIECE``."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    return np.array_split(raw, max(1, -(-len(raw) // PIECE)))


def presence(raw: np.ndarray) -> np.ndarray:
    """Places (of ``DIM``) of the n-grams that occur, as booleans."""
    gram = raw = raw.astype(np.uint32)
    there = np.zeros(DIM, bool)
    for n in range(NGRAMS):
        if n:
            gram = (gram[:-1] << np.uint32(8)) | raw[n:]
        if not len(gram):
            break
        mixed = (gram ^ (gram >> np.uint32(15))) * _MULTIPLIERS[n]
        there[mixed >> np.uint32(32 - DIM.bit_length() + 1)] = True
    return there


def kernel(x: np.ndarray, y: np.ndarray, rows: int = 256) -> np.ndarray:
    """Kernel values of presence rows; only ``rows`` of ``x`` become numbers at a time."""
    y = y.astype(np.float32)
    found = np.concatenate([x[i : i + rows].astype(np.float32) @ y.T for i in range(0, len(x), rows)] or [np.zeros((0, len(y)), np.float32)])
    return found / np.sqrt(np.outer(np.maximum(x.sum(1), 1), np.maximum(y.sum(1), 1)))


class Model:
    """languages and weights (DIM x languages): margins are (presence / sqrt(size)) @ weights."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def predict(self, strings: list[str]) -> tuple[list[str], list[float]]:
        named, scores = [UNDETERMINED] * len(strings), [0.0] * len(strings)
        some = [i for i, t in enumerate(strings) if _LETTER.search(t)]
        if some and self.languages:
            parts = [(i, p) for i in some for p in pieces(strings[i])]
            margins = np.zeros((len(strings), len(self.languages)))
            weight = np.zeros(len(strings))
            for at in range(0, len(parts), BATCH):
                owner = np.array([i for i, _ in parts[at : at + BATCH]])
                size = np.array([len(p) for _, p in parts[at : at + BATCH]])
                x = np.stack([presence(p) for _, p in parts[at : at + BATCH]]).astype(np.float32)
                x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
                np.add.at(margins, owner, (x @ self.weights) * size[:, None])
                np.add.at(weight, owner, size)
            margins = margins[some] / np.maximum(weight[some], 1)[:, None]
            best = margins.argmax(1)
            chance = np.clip((margins.max(1) + 1) / 2, 0, 1)
            for i, k, p in zip(some, best.tolist(), chance.tolist(), strict=True):
                named[i], scores[i] = self.languages[k], float(p)
        return named, scores


def fit_rows(x: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model:
    """Nystrom features and kernel ridge regression on presence rows ``x``."""
    names = sorted(set(languages))
    if len(names) < 2:
        return Model(names, np.ones((DIM, len(names)), np.float32) * 1e6)
    y = np.array([names.index(v) for v in languages])
    share = [np.flatnonzero(y == k)[: max(1, landmarks // len(names))] for k in range(len(names))]
    marks = x[np.concatenate(share)]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel(x, marks).astype(np.float64) @ root
    targets = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    balance = 1.0 / np.bincount(y, minlength=len(names))[y]
    weighted = features * balance[:, None]
    gram = weighted.T @ features + ridge * np.eye(features.shape[1]) / features.shape[1]
    beta = np.linalg.solve(gram, weighted.T @ targets)
    scaled = marks.astype(np.float64) / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
    return Model(names, (scaled.T @ (root @ beta)).astype(np.float32))


def fit(docs: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``rows`` labelled rows outside the held-out fifth, or ``MIN_ROWS`` a language where that is more."""
    attach(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (bucket(id_col, 5) != 0))
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).cast("string")).count().collect()}
    quota = max(MIN_ROWS, rows // max(1, len(counts)))
    chance = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, quota / n) * (1 << 30)))]) if counts else None
    most = quota * max(1, len(counts))
    drawn = known.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < chance[F.col(lang_col).cast("string")]) if counts else known
    sample = drawn.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, strings in texts(batches):
            keep = [i for i, t in enumerate(strings) if _LETTER.search(t)]
            chosen = [(p := pieces(strings[i]))[zlib.crc32(strings[i].encode()) % len(p)] for i in keep]
            bits = [np.packbits(presence(p)).tobytes() for p in chosen]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array(bits, pa.binary())], ["lang", "bits"])

    got = sample.mapInArrow(run, "lang string, bits binary").limit(2 * most).collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    order = np.random.default_rng(7).permutation(len(got))
    x = np.array([np.unpackbits(np.frombuffer(got[i]["bits"], np.uint8)) for i in order], bool).reshape(-1, DIM)
    return fit_rows(x, [got[i]["lang"] for i in order])


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", into: str = "language") -> DataFrame:
    """``docs``' columns and a struct column ``into`` (predicted, score)."""
    model = model or fit(docs, id_col=id_col, text_col=text_col)
    attach(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[docs[c] for c in rest], F.lit(0).alias("__")).alias("rest"), docs[text_col].cast("string").alias("body"))
    kind = rows.schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, strings in texts(batches, rows=256):
            named, scores = model.predict(strings)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(named), pa.array(scores, pa.float64())], ["rest", "body", "predicted", "score"])

    found = rows.mapInArrow(run, f"rest {kind}, body string, predicted string, score double")
    columns = [F.col("rest")[c].alias(c) if c != text_col else F.col("body").alias(c) for c in docs.columns]
    return found.select(*columns, F.struct("predicted", "score").alias(into))


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns: doc_id, held_out, lang_pred, score."""
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.predicted").alias("lang_pred"), F.col("language.score").alias("score"))
