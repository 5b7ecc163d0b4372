"""Work in blocks that grow with the table: what is sent and given out, and the same rows as all pairs."""

import numpy as np
import pytest

from quarrykit.operators import neighbors as N
from quarrykit.operators.components import components
from quarrykit.plans import retrieval
from tests.test_neighbors import CASES, clustered, exact_pairs, frame, rows


def unstructured(n, d=64, seed=4):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_links_of_unstructured_vectors_take_few_exact_products(spark, monkeypatch):
    """The leading axes leave nearly all pairs of such vectors, so whole products in single precision weigh them first."""
    x, taken = unstructured(900), spark.sparkContext.accumulator(0)
    monkeypatch.setattr(N, "WEIGHED", 1 << 12)
    einsum = np.einsum

    def counted(how, a, b):
        taken.add(len(a))
        return einsum(how, a, b)

    monkeypatch.setattr(np, "einsum", counted)
    monkeypatch.setattr(N, "BLOCK", 450)
    monkeypatch.setattr(N, "_meetings", lambda *_: spark.range(1).selectExpr("0L AS block", "0L AS part"))

    class Whole:
        """Runs the task's function here, over one block of all vectors."""

        def __init__(self, df):
            self.df = df

        def applyInArrow(self, link, schema):
            import pyarrow as pa

            v = pa.array(list(x), pa.list_(pa.float32()))
            n = len(x)
            side = pa.array([0] * n + [1] * n)
            out = link(pa.table({"side": side, "id": pa.array([*range(n)] * 2), "embedding": pa.concat_arrays([v, v])}))
            return spark.createDataFrame(out.to_pylist() or [], "a long, b long")

    monkeypatch.setattr(type(spark.range(1)), "groupBy", lambda self, *_: Whole(self))
    links = N.similar_links(frame(spark, x), 0.4)
    monkeypatch.undo()
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b, _ in exact_pairs(x, 0.4)], "a long, b long")
    assert rows(components(links)) == rows(components(pairs))
    assert taken.value < 0.3 * len(x) ** 2


@pytest.mark.parametrize("name", [*CASES, "unstructured"])
def test_best_pairs_hold_the_best_of_all_pairs(spark, monkeypatch, name):
    x = unstructured(300) if name == "unstructured" else CASES[name].astype(np.float32)
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "HELD", 500)
    tags = spark.createDataFrame([(i, [i % 3]) for i in range(len(x))], "id long, tags array<int>")
    for t, least in ((0.35, 0.4), (0.9, 0.95)):
        pairs = spark.createDataFrame([(int(a), int(b), float(s)) for a, b, s in exact_pairs(x, t)], "a long, b long, score double")
        best = N.similar_best(frame(spark, x), t, 5, 0.05, 1.0)
        assert rows(retrieval.best_related(best, tags, 5, least)) == rows(retrieval.related(pairs, tags, 5, least))
    assert N.similar_best(frame(spark, x[:0]), 0.5, 3).count() == 0


def test_best_pairs_are_few_a_row_and_task(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 100)
    x = np.concatenate([np.repeat(clustered(1, 1, 0.0, 2), 400, axis=0), clustered(400, 400, 1.0, 3)])
    met = {}
    best = N.similar_best(frame(spark, x), 0.35, 5, met=met)
    assert best.count() <= 5 * (met["met"] + 8 * 2 * len(x)) < 400 * 399


def test_low_thresholds_send_no_row_for_each_band(spark, monkeypatch):
    """The same pairs as by bands, of which there are 100 and more at such a threshold."""
    x = unstructured(400)
    monkeypatch.setattr(N, "BLOCK", 64)
    sent = []
    monkeypatch.setattr(N, "_by_groups", lambda rows, *rest, was=N._by_groups: sent.append(rows.count()) or was(rows, *rest))
    found = rows(N.banded_pairs(frame(spark, x), 0.3))
    monkeypatch.setattr(N, "ONE_IN", 0)
    assert rows(N.banded_pairs(frame(spark, x), 0.3)) == found and len(found) > 100
    assert sent[0] < 20 * len(x) < sent[1]
