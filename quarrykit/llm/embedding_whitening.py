r"""Whitening of embeddings by polarisation covariance.

Entries become whole numbers x = floor(64 c) + 1000000. The fit list is each distinct vector once. With y = x - m, where m is the mean's nearest
whole number, tasks add up y, y_i^2 for every dimension and (y_i + y_j)^2 for every pair of dimensions, in whole numbers; the difference

    var(x_i + x_j) - var(x_i) - var(x_j) = 2 cov(x_i, x_j)

recovers every covariance exactly, as a fraction, before it becomes a double for ``eigh``. Spark adds the tasks' sums (D (D + 1) / 2 of them), so
the driver holds one matrix of the dimension and no vectors; every other pass is a projection of rows by bounded matrices.

Sums are exact for entries of any size: a batch whose squares fit 64 bits is added up in them, any other in unbounded whole numbers; between
tasks a sum travels as high and low part. Entries beyond a long are held at +-2^62.

Defined cases: null vectors and those with null, NaN or infinite entries are dropped, as are empty ones and those of another dimension than most
have (the larger of equally frequent dimensions); repeated rows and ids are rows like others; a null id stays null; components whose eigenvalue is
below ``LEAST`` of the largest carry no variance and are left out (one distinct vector has none, so no rows); an empty table gives an
empty result; deviation is null where it does not fit a long; further columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach, durable
from ._sums import summed

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Smallest share of the largest eigenvalue that counts as variance.
LEAST = 1e-11
#: Rows that a task works on at a time, and where high and low part of a sum meet.
ROWS, LOW = 2048, 1 << 40


@dataclass(frozen=True)
class Whitening:
    """``mean`` (fractions), ``middle`` (nearest whole numbers), unit ``axes`` (dimension x components), eigenvalues ``spread`` and their shares."""

    n: int
    totals: list[int]
    middle: np.ndarray
    axes: np.ndarray
    spread: np.ndarray
    explained: np.ndarray
    identity_error: float


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, x (array<long>) of the rows that have a vector of the common dimension with finite entries."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("c"))
    finite = ~F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == math.inf))
    rows = rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & F.coalesce(finite, F.lit(False)))
    sizes = rows.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d")).alias("most")).first()
    dimension = sizes["most"]["d"] if sizes["most"] else 0
    held = lambda c: F.greatest(F.least(c * SCALE, F.lit(float(1 << 62))), F.lit(-float(1 << 62)))
    return rows.where(F.size("c") == dimension).select("id", F.transform("c", lambda c: F.floor(held(c)) + OFFSET).alias("x"))


def exact_sums(rows: DataFrame, slots: Callable[[np.ndarray], list[int]]) -> dict[int, int]:
    """{slot: sum over all of the whole numbers that ``slots`` gives for a block (rows x dimension) of ``rows``' one column}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                found = slots(_matrix(batch.column(0).slice(at, ROWS)))
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total is not None:
            high = pa.array([Decimal(v // LOW) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), high, pa.array([v % LOW for v in total], pa.int64())], ["slot", "high", "low"])

    parts = rows.mapInArrow(run, "slot int, high decimal(38,0), low long")
    added = parts.groupBy("slot").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    return {r["slot"]: int(r["high"]) * LOW + int(r["low"]) for r in added.collect()}


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` in 64 bits where sums over its rows of values up to ``bound`` of its largest entry fit them, else in unbounded numbers."""
    largest = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    return x if (2 * largest) ** bound * max(1, len(x)) < 1 << 62 else x.astype(object)


def column_sums(x: np.ndarray) -> list[int]:
    return [len(x), *map(int, _exact(x, 1).sum(axis=0))]


def centred(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """x - middle; in unbounded numbers where the difference might leave 64 bits."""
    far = x.size and max(abs(int(x.min())), abs(int(x.max()))) >= 1 << 61
    return x.astype(object) - middle.astype(object) if far or np.abs(middle).max(initial=0) >= 1 << 61 else x - middle


def polarised(x: np.ndarray, middle: np.ndarray) -> list[int]:
    """Sums of squares of each dimension, then of each sum of two dimensions (i, j) with i < j, row by row of the matrix."""
    y = _exact(centred(x, middle), 2)
    found = list(map(int, (y * y).sum(axis=0)))
    for i in range(y.shape[1] - 1):
        pair = y[:, i : i + 1] + y[:, i + 1 :]
        found += map(int, (pair * pair).sum(axis=0))
    return found


def covariance(n: int, rest: list[int], squares: dict[int, int]) -> list[list[Fraction]]:
    """Exact covariances (divisor n) of vectors whose centred entries sum to ``rest`` and whose ``polarised`` sums are ``squares``."""
    d = len(rest)
    own = [Fraction(squares[i] * n - rest[i] ** 2, n * n) for i in range(d)]
    found = [[Fraction(0)] * d for _ in range(d)]
    slot = d
    for i in range(d):
        found[i][i] = own[i]
        for j in range(i + 1, d):
            both = Fraction(squares[slot] * n - (rest[i] + rest[j]) ** 2, n * n)
            found[i][j] = found[j][i] = (both - own[i] - own[j]) / 2
            slot += 1
    return found


def projected(x: np.ndarray, middle: np.ndarray, offset: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """(x - mean) on the axes; the whole part of the mean goes before the numbers become doubles."""
    return (centred(x, middle).astype(np.float64) - offset) @ axes


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From the table (id, x) of ``whole``; None where there is no variance."""
    attach(rows.sparkSession)
    distinct = durable(rows.select("x").distinct())
    sums = exact_sums(distinct, column_sums)
    n = sums.get(0, 0)
    totals = [sums[i] for i in range(1, len(sums))]
    if not n:
        return None
    middle = np.array([(2 * s + n) // (2 * n) for s in totals], np.int64)
    rest = [s - n * int(m) for s, m in zip(totals, middle, strict=True)]
    exact = covariance(n, rest, exact_sums(distinct, lambda x: polarised(x, middle)))
    values, vectors = np.linalg.eigh(np.array([[float(v) for v in row] for row in exact]))
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > LEAST * max(values.max(), 0.0)][:components]
    trace = float(sum(exact[i][i] for i in range(len(exact))))
    if not len(order) or trace <= 0:
        return None
    axes = vectors[:, order]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)  # the same on every run
    scaled = axes / np.sqrt(values[order])
    offset = np.array([r / n for r in rest])

    def second(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        first, square = np.zeros(len(order)), np.zeros((len(order), len(order)))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                z = projected(_matrix(batch.column(0).slice(at, ROWS)), middle, offset, scaled)
                first, square = first + z.sum(axis=0), square + z.T @ z
        return [first, square]

    got = summed(distinct, second)
    mean = got[0] / n
    error = np.abs(got[1].reshape(len(order), -1) / n - np.outer(mean, mean) - np.eye(len(order))).max()
    return Whitening(n, totals, middle, axes, values[order], values[order] / trace, float(error))


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """id, deviation, whitened (array<double>, a value a component) of the table (id, x) of ``whole``."""
    attach(rows.sparkSession)
    kind = f"id {rows.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>"
    if model is None:
        return rows.select("id", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    rest = [s - model.n * int(m) for s, m in zip(model.totals, model.middle, strict=True)]
    scaled, offset = model.axes / np.sqrt(model.spread), np.array([r / model.n for r in rest])
    n, middle = model.n, model.middle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                y = centred(x := _matrix(part.column(1)), middle)
                largest = max(abs(int(y.min())), abs(int(y.max())))
                far = np.array(rest, object) if max(map(abs, rest)) >= 1 << 62 else np.array(rest)
                if ((largest + 1) * n) ** 2 * y.shape[1] >= 1 << 62 or far.dtype == object:
                    y, far = y.astype(object), far.astype(object)
                gap = n * y - far
                deviation = [int(v) if int(v) < 1 << 63 else None for v in (gap * gap).sum(axis=1)]
                z = projected(x, middle, offset, scaled)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation, pa.int64()), flat], ["id", "deviation", "whitened"])

    return rows.select("id", "x").mapInArrow(run, kind)


def digest(vectors: DataFrame) -> DataFrame:
    """The registered query's columns: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = whole(vectors)
    model = fit(rows)
    spread = F.array(*[F.lit(float(v)) for v in model.explained]) if model else F.array().cast("array<double>")
    found = whiten(rows, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(spread, F.col("at")).alias("explained"), F.lit(model.identity_error if model else 0.0).cast("double").alias("identity_error"),
    )
