r"""Quality scores by positive-unlabelled learning: the non-negative risk estimator with a logistic loss.

Trusted positives are texts labelled good, and unlabelled web text is every text that may be learned from and has no label. With the
margin g, prior pi and l(z) = log(1 + e^-z)

    risk = pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)])

is convex for a linear margin while the negative part is above zero. Newton steps minimise it there over *all* rows, and a
step that takes the negative part below zero is halved until it does not: each pass sums gradients and curvatures over
all tasks (two levels deep) and the driver sees two vectors and a small matrix. Inputs come from the text alone: shape, character and
repetition statistics with their squares, and its character 4-grams as a signed hashed vector of ``HASHED`` places; all standardised.

The class prior pi is estimated from positives and unlabelled text, without negatives: a first fit with ``START`` on half of the texts
(by a hash of their inputs, so copies stay together) gives margins on the other half, where the share of unlabelled text above a margin
over the share of positives above it is not below pi but for chance. The margin (of those that ``TAIL`` of the positives exceed)
with the least such ratio and one standard error is taken, and the model is fitted on all texts with its ratio less two standard errors: a
prior that is too high lets the negative part of the risk fall below zero everywhere, one that is a little too low does no harm.

A row is learned from only if crc32(doc_id as text) mod 3 is not 1. With no positive or no unlabelled row the score is the
share of good texts among the labelled ones (0.5 if there is no label), kept within 0.001 and 0.999.

Defined cases: null and empty texts have all-zero inputs and get the score that belongs to them; a null id has no
label and is not held out; repeated rows count as often as they occur and score alike; of several labels of one id the
lowest counts; labels outside 0 and 1 are ignored; other columns pass through; empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach, durable
from ._sums import summed
from ._text import byte_texts

#: Newton steps; weight of the squares of weights, and how much more of it there is for each weight that a positive must settle.
STEPS, RIDGE, FEW = 14, 1e-3, 2.0
#: Places of the hashed 4-grams; the prior of the first fit; the share of positives above the last margin that is looked at; bins of margins.
HASHED, START, TAIL, BINS = 64, 0.5, 0.5, 400


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256)
    table[list(chars)] = 1
    return table


#: Byte classes whose share of a text is a statistic.
CLASSES = np.stack(
    [
        _class(bytes(range(97, 123))),
        _class(bytes(range(65, 91))),
        _class(bytes(range(48, 58))),
        _class(b" "),
        _class(b"\n"),
        _class(b".,;:"),
        _class(b"!?"),
        _class(b"|"),
        _class(b"#$%&*@^~+=<>{}[]\\/_"),
        _class(b"\"'()-"),
        _class(bytes(range(128, 256))),
    ],
    axis=1,
)
PLAIN = CLASSES.shape[1] + 15
N = PLAIN + HASHED


def statistics(text: bytes) -> list[float]:
    """The ``PLAIN`` statistics of one text."""
    words = text.split()
    if not words:
        return [0.0] * PLAIN
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = bytes_ / len(text)
    n = len(words)
    sizes = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = text.split(b"\n")
    distinct_lines = len(set(lines))
    ends = sum(line.rstrip()[-1:] in (b".", b"!", b"?", b":") for line in lines)
    capital = sum(w[:1].isupper() for w in words)
    shout = sum(w.isupper() and len(w) > 1 for w in words)
    some = share[share > 0]
    marked = sum(not w.strip(b".,;:!?\"'()").isalnum() and w.isascii() for w in words)
    return [
        *(share @ CLASSES).tolist(),
        np.log1p(n),
        np.log1p(len(lines)),
        np.log1p(n / len(lines)),
        float(sizes.mean()) / 10,
        float(sizes.std()) / 10,
        np.log1p(sizes.max()),
        len(counts) / n,
        max(counts.values()) / n,
        same / max(1, n - 1),
        distinct_lines / len(lines),
        ends / len(lines),
        capital / n,
        shout / n,
        marked / n,
        float(-(some * np.log(some)).sum()),
    ]


def hashed_grams(text: bytes) -> np.ndarray:
    """Signed counts of the character 4-grams, of unit length."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.zeros(HASHED)
    gram = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(2654435761)
    place = (mixed >> np.uint32(32 - HASHED.bit_length())).astype(np.int64)  # one bit more: the sign
    counts = np.bincount(place, minlength=2 * HASHED)
    found = (counts[::2] - counts[1::2]).astype(np.float64)
    return found / max(float(np.linalg.norm(found)), 1.0)


def inputs_of(text: bytes) -> np.ndarray:
    return np.concatenate((statistics(text), hashed_grams(text)))


def with_statistics(docs: DataFrame, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """rest (struct of the other columns), body if asked for, and x (array<float>)."""
    attach(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[docs[c] for c in rest], F.lit(0).alias("__")).alias("rest"), docs[text_col].cast("string").alias("body"))
    kind = rows.schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bodies in byte_texts(batches):
            x = pa.array([inputs_of(b) for b in bodies], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column(0), *([part.column(1)] if with_text else []), x], ["rest", *(["body"] if with_text else []), "x"])

    return rows.mapInArrow(run, f"rest {kind}, {'body string, ' if with_text else ''}x array<float>")


class Model:
    """Margin: weights on standardised inputs, the statistics' squares (bounded) and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack((z, np.minimum(z[:, :PLAIN] ** 2, 16), np.ones((len(z), 1))))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -40, 40)))


def _rows(batches: Iterator[pa.RecordBatch], half: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(inputs, role: 1 trusted positive, 0 unlabelled) of each batch, of all rows or of one half."""
    for batch in batches:
        if batch.num_rows:
            x, role = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, N), batch.column(1).to_numpy(zero_copy_only=False)
            if half is not None:
                mine = np.fromiter((zlib.crc32(row.tobytes()) >> 7 & 1 == half for row in x), bool, len(x))
                x, role = x[mine], role[mine]
            yield x.astype(np.float64), role


def fit(learned: DataFrame, share: float) -> Model:
    """``learned``: x and role of all rows that may be learned from (a durable table); ``share``: the score where nothing can be learned."""

    def moments(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        total, square, n = np.zeros(N), np.zeros(N), np.zeros(2)
        for x, role in _rows(batches):
            total += x.sum(0)
            square += (x * x).sum(0)
            n += [(role == 0).sum(), (role == 1).sum()]
        return [total, square, n]

    sums = summed(learned, moments)
    size = N + PLAIN + 1
    if not sums or not sums[2].all():
        share = min(max(share, 1e-3), 1 - 1e-3)
        start = np.zeros(size)
        start[-1] = np.log(share / (1 - share))
        return Model(np.zeros(N), np.ones(N), start, share)
    n = sums[2].sum()
    mean = sums[0] / n
    scale = np.sqrt(np.maximum(sums[1] / n - mean**2, 0)) + 1e-3
    first = newton(learned, Model(mean, scale, np.zeros(size), START), 0)
    return newton(learned, Model(mean, scale, np.zeros(size), estimated_prior(learned, first)))


def estimated_prior(learned: DataFrame, model: Model) -> float:
    """The least ratio of the shares of unlabelled and of positive rows above a margin."""
    edges = np.linspace(-20, 20, BINS + 1)[1:-1]

    def histograms(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        found = np.zeros((2, BINS))
        for x, role in _rows(batches, 1):
            place = np.searchsorted(edges, model.inputs(x) @ model.weights)
            for k in (0, 1):
                found[k] += np.bincount(place[role == k], minlength=BINS)
        return [found.ravel()]

    found = summed(learned, histograms)[0].reshape(2, BINS)
    n = found.sum(axis=1, keepdims=True)
    if not n.all():
        return START
    above = found[:, ::-1].cumsum(axis=1)[:, ::-1] / n
    enough = above[1] >= TAIL
    free, good = above[:, enough]
    ratio = free / good
    chance = ratio * np.sqrt((1 - free) / np.maximum(free * n[0], 1) + (1 - good) / (good * n[1]))
    best = int((ratio + chance).argmin())
    return float(np.clip(ratio[best] - 2 * chance[best], 0.01, 0.99))


def newton(learned: DataFrame, model: Model, half: int | None = None) -> Model:
    """``model`` with weights that minimise the risk over all rows or one half."""
    size, prior = N + PLAIN + 1, model.prior

    def parts(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        """Losses of the negative label (unlabelled, positive); unlabelled gradient and curvature; sum of positives' inputs; numbers."""
        loss, gradient, curve, plain, n = np.zeros(2), np.zeros(size), np.zeros((size, size)), np.zeros(size), np.zeros(2)
        for x, role in _rows(batches, half):
            z = model.inputs(x)
            g = np.clip(z @ model.weights, -40, 40)
            free = role == 0
            loss += [np.log1p(np.exp(g[free])).sum(), np.log1p(np.exp(g[~free])).sum()]
            p = 1 / (1 + np.exp(-g[free]))
            gradient += p @ z[free]
            curve += (z[free] * (p * (1 - p))[:, None]).T @ z[free]
            plain += z[~free].sum(0)
            n += [free.sum(), (~free).sum()]
        return [loss, gradient, curve, plain, n]

    good = step = np.zeros(size)
    model.weights = good
    for _ in range(STEPS):
        got = summed(learned, parts)
        loss, gradient, curve, plain = got[0], got[1], got[2].reshape(size, size), got[3]
        n_u, n_p = np.maximum(got[4], 1)
        if loss[0] / n_u < prior * loss[1] / n_p:
            step = step / 2
            model.weights = good - step
        else:
            good = model.weights
            ridge = RIDGE + FEW * size / n_p
            slope = gradient / n_u - prior * plain / n_p + ridge * good
            step = np.linalg.solve(curve / n_u + ridge * np.eye(size), slope)
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            model.weights = good - step
        if np.abs(step).max() < 1e-2:
            break
    model.weights = good
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1) -> tuple[DataFrame, Model]:
    """``id_col``, held_out, score and predicted for each row of ``docs``, and the fitted model."""
    attach(docs.sparkSession)
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__mark"))
    found = with_statistics(docs.select(id_col, text_col), text_col, with_text=False).select(F.col("rest")[id_col].alias("id"), "x")
    held_out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % folds == held
    rows = durable(found.join(marks, F.col("id") == F.col("__id"), "left").select("id", "x", held_out.alias("held_out"), "__mark"))
    free = rows.where("NOT held_out")
    share, n = free.agg(F.avg("__mark"), F.count("__mark")).first()
    learned = free.where("__mark IS NULL OR __mark = 1").select("x", F.coalesce("__mark", F.lit(0)).cast("int").alias("role"))
    model = fit(learned, float(share) if n else 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, N).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], ["id", "held_out", "score"])

    kind = dict(rows.dtypes)["id"]
    scored = rows.select("id", "held_out", "x").mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")), model


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query's columns: doc_id, held_out, score, predicted."""
    return score(docs, labels)[0]
