"""Joins whose size Spark guesses too low: neither side may reach all tasks by the driver."""

import random

from quarrykit.llm import simhash_dedup
from quarrykit.operators import components as C
from quarrykit.session import durable
from tests.llm.test_operators import make, prose


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_fingerprints_are_not_sent(spark):
    """Spark takes the twenty cells of each fingerprint for no more bytes than the fingerprints."""
    distinct = durable(spark.range(2000).selectExpr("xxhash64(id) AS fp", "id AS rep"))
    assert "BroadcastHashJoin" not in plan(simhash_dedup.near_links(distinct))


def test_shared_shingles_are_not_sent(spark, monkeypatch):
    rng = random.Random(5)
    texts = [prose(rng, 80) for _ in range(12)]
    texts += [" ".join(t.split()[:78]) + " other end" for t in texts]
    plans = []

    def kept(df):
        plans.append(plan(df))
        return durable(df)

    monkeypatch.setattr(simhash_dedup, "durable", kept)
    groups = simhash_dedup.near_groups(make(spark, texts), 5, least=0.8).collect()
    assert {r.doc_id: r.component_id for r in groups} == {i: i % 12 for i in range(24)}
    sent = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert len(plans) > 5 and all("__id" in line for line in sent), sent  # counted ids alone


def test_many_edges_are_not_sent(spark, monkeypatch):
    edges = durable(spark.range(100).selectExpr("id + 1 AS a", "id AS b"))
    for few in (True, False):
        assert ("BroadcastHashJoin" in plan(C._large_star(edges, few))) == few
        assert ("BroadcastHashJoin" in plan(C._small_star(edges, few))) == few
    monkeypatch.setattr(C, "FEW", 10)
    assert {tuple(r) for r in C.components(edges).collect()} == {(i, 0) for i in range(1, 101)}
