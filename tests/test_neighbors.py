"""Neighbours and pairs against all pairs in numpy: clustered, unstructured and degenerate vectors, ties, copies, norms, empty tables."""

import numpy as np
import pytest

from quarrykit.operators import neighbors as N
from quarrykit.operators.components import components

KIND = "vec_id long, embedding array<float>"


def clustered(n, centres, spread, seed=0, d=16):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    x = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, key="vec_id"):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], KIND.replace("vec_id", key))


def exact_knn(q, x, k, least=None):
    s = np.round(q.astype(np.float64) @ x.astype(np.float64).T, 6)
    want = set()
    for i, row in enumerate(s):
        order = sorted(range(len(row)), key=lambda j: (-row[j], j))[:k]
        want |= {(i, j, row[j], r + 1) for r, j in enumerate(order) if least is None or row[j] >= least}
    return want


def exact_pairs(x, t):
    s = np.round(x.astype(np.float64) @ x.astype(np.float64).T, 6)
    return {(i, j, s[i, j]) for i, j in zip(*np.nonzero(s >= t), strict=True) if i < j}


def rows(df):
    return {tuple(r) for r in df.collect()}


CASES = {
    "clusters": clustered(900, 12, 0.05),
    "no structure": clustered(400, 400, 1.0, 1),
    "copies and ties": np.concatenate([np.repeat(clustered(3, 3, 0.0, 2), 90, axis=0), clustered(60, 5, 0.2, 3)]),
    "norms and zeros": clustered(300, 6, 0.1, 4) * np.random.default_rng(5).uniform(0, 3, (300, 1)).astype(np.float32) * (np.arange(300) % 17 > 0)[:, None],
}


@pytest.mark.parametrize("name", CASES)
def test_equal_rows_to_all_blocks(spark, monkeypatch, name):
    x = CASES[name].astype(np.float32)
    monkeypatch.setattr(N, "BLOCK", 64)
    met = {}
    got = rows(N.knn(frame(spark, x[::10], "query_id"), frame(spark, x), 5, met=met))
    assert got == exact_knn(x[::10], x, 5)
    assert 0 < met["met"] <= met["all"]
    if name == "clusters":
        assert met["met"] < 0.35 * met["all"]  # the share of block pairs that are skipped on clustered vectors
    assert rows(N.knn(frame(spark, x[::10], "query_id"), frame(spark, x), 400, least=0.5)) == exact_knn(x[::10], x, 400, 0.5)
    for t in (0.2, 0.9):
        met = {}
        assert rows(N.similar_pairs(frame(spark, x), t, met=met)) == exact_pairs(x, t)
        if name == "clusters" and t == 0.9:
            assert met["met"] < 0.35 * met["all"]


@pytest.mark.parametrize("d", [16, 40])
def test_links_keep_the_groups_of_all_pairs(spark, monkeypatch, d):
    """One edge a row and task at most, where all pairs of a group grow with its square, and the same groups."""
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "STEP", 8)
    monkeypatch.setattr(N, "PAIRS", 50)
    cases = [CASES[c].astype(np.float32) for c in ("copies and ties", "norms and zeros")] if d == 16 else [clustered(500, 40, 0.05, 9, d)]
    for x in cases:
        for t in (0.6, 0.95):
            pairs = spark.createDataFrame([(int(a), int(b)) for a, b, _ in exact_pairs(x, t)], "a long, b long")
            met = {}
            links = N.similar_links(frame(spark, x), t, met=met)
            assert rows(components(links)) == rows(components(pairs))
            assert links.count() <= 2 * met["met"] + len(x)
    assert N.similar_links(spark.createDataFrame([], KIND), 0.5).count() == 0


def test_small_and_empty_tables(spark):
    x = clustered(7, 2, 0.1, 6)
    none = spark.createDataFrame([], KIND)
    assert rows(N.knn(frame(spark, x, "query_id"), frame(spark, x), 30)) == exact_knn(x, x, 30)
    assert N.knn(frame(spark, x, "query_id"), none, 3).count() == 0 and N.similar_pairs(none, 0.5).count() == 0 and N.banded_pairs(none, 0.5).count() == 0
    assert N.knn(none.withColumnRenamed("vec_id", "query_id"), frame(spark, x), 3).count() == 0


@pytest.mark.parametrize("threshold", [0.85, 0.6])
def test_recall_of_bands(spark, monkeypatch, threshold):
    x = clustered(1500, 250, 0.15, 7)
    want = exact_pairs(x, threshold)
    got = N.similar_pairs(frame(spark, x), threshold, recall=0.95).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {tuple(r) for r in got} <= want
    assert len(got) >= 0.95 * len(want)
    monkeypatch.setattr(N, "BLOCK", 40)  # buckets dealt out as tiles
    assert {tuple(r) for r in N.similar_pairs(frame(spark, x), threshold, recall=0.95).collect()} == {tuple(r) for r in got}


def test_work_grows_nearly_in_proportion(spark, monkeypatch):
    """Ten times the vectors of ten times the clusters: pairs of vector and block that are met grow about tenfold, not a hundredfold."""
    monkeypatch.setattr(N, "BLOCK", 64)
    met = []
    for n in (600, 6000):
        count = {}
        N.similar_pairs(frame(spark, clustered(n, n // 50, 0.02, 8, d=8)), 0.97, met=count).write.format("noop").mode("overwrite").save()
        met.append(count["met"])
    assert met[1] < 25 * met[0]
    assert N.bands(0.85, 10**9, 0.95)[0] <= N.MOST_BANDS and N.bands(0.9, 10**6, 0.95)[1] > 8


def test_large_bucket_in_bounded_memory(spark, monkeypatch):
    n = 1000
    x = np.concatenate([np.repeat(clustered(1, 1, 0.0, 2), n, axis=0), clustered(100, 100, 1.0, 3)])
    monkeypatch.setitem(spark.sparkContext.environment, "QUARRYKIT_TEST", "bucket")  # workers of its own
    copies = N.banded_pairs(frame(spark, x), 0.4).where(f"b < {n}").agg({"score": "min", "*": "count"}).first()
    assert copies["count(1)"] == n * (n - 1) // 2 and copies["min(score)"] >= 0.99

    def peak(batches):
        import resource

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10])], ["mb"])

    assert spark.range(0, 8, 1, 4).mapInArrow(peak, "mb long").agg({"mb": "max"}).first()[0] < 600


def test_links_send_a_vector_to_few_blocks_whatever_the_size_of_the_table(spark, monkeypatch):
    """Blocks grow with the table, so the rows that are sent grow with it and not with its square."""
    monkeypatch.setattr(N, "BLOCK", 32)
    x = np.random.default_rng(4).normal(size=(1600, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    met = {}
    N.similar_links(frame(spark, x), 0.7, met=met)
    assert met["met"] <= 10 * len(x)
