"""Ordered folds against a plain loop: one key over many tasks, many keys, states from batch to batch, states that end."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarrykit.operators import folds as D
from quarrykit.operators import health as H
from quarrykit.session import scratch, table
from quarrykit.sources.buckets import Live
from quarrykit.streaming import events as E
from tests.conftest import SF

MACHINES = {"breaker": D.Breaker(3, 5.0), "bucket": D.TokenBucket(2.5, 0.4), "poor": D.TokenBucket(0.5, 0.4), "repeats": D.Repeats(3.0), "streak": D.Streak()}


def loop(machine, rows, states=None):
    """Outcomes and last states, key by key; ``rows``: (key, at, event_id, *inputs)."""
    states, out = dict(states or {}), {}
    for key, at, event, *more in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1], r[2])):
        states[key], result = machine.step(states.get(key), at, *more)
        out[event] = (key, *result)
    return out, states


def some(seed, n, keys, gap=2_000_000):
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([0, 1, gap // 3, gap, gap, 3 * gap])
        rows.append((rng.choice(keys), at, i, rng.random() < 0.5))
    return rows


def frame(spark, rows, machine, state=""):
    name = machine.inputs[0] if machine.inputs else "unused"
    return spark.createDataFrame(rows, f"who long, at long, event_id long, {name} boolean{state}")


@pytest.mark.parametrize("name", MACHINES)
def test_all_states_at_a_time(name):
    """Whatever the state before, a summary of rows gives the state that the rows lead to."""
    machine = MACHINES[name]
    for seed in range(40):
        rows = [r[1:2] + (r[3:] if machine.inputs else ()) for r in some(seed, 30, [1])]
        rows = [(at + 50_000_000, *more) for at, *more in rows]
        before = [None] + [machine_state for _, _, machine_state in _walk(machine, seed)]
        unknown = machine.unknown()
        for row in rows:
            unknown.step(*row)
        for state in before:
            now = json.loads(json.dumps(state))
            for row in rows:
                now = machine.step(now, *row)[0]
            assert unknown.end(json.loads(json.dumps(state))) == now, (seed, state)


def _walk(machine, seed):
    state = None
    for _, at, _, ok in some(1000 + seed, 25, [1], 1_500_000):
        if at <= 50_000_000:
            state, _ = machine.step(state, at, *((ok,) if machine.inputs else ()))
            yield at, ok, state


@pytest.mark.parametrize("name", MACHINES)
def test_one_key_over_many_tasks(spark, monkeypatch, name):
    machine = MACHINES[name]
    monkeypatch.setattr(D, "partitions_for", lambda df: 7)
    for keys in ([5], [None, 1, 2, 3], [1] * 30 + list(range(40))):
        rows = some(len(keys), 400, keys)
        cut = [r if machine.inputs else (*r[:3], None) for r in rows]
        want, last = loop(machine, [r[:4] if machine.inputs else r[:3] for r in rows])
        found, states = D.fold(frame(spark, cut, machine).repartition(5), "who", machine)
        assert {r[0]: tuple(r)[1:] for r in found.collect()} == want
        assert {r.who: json.loads(r.state) for r in states.collect()} == last
        tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 3 if keys == [5] else tasks


def test_states_from_batch_to_batch(spark, monkeypatch):
    machine = MACHINES["bucket"]
    monkeypatch.setattr(D, "partitions_for", lambda df: 4)
    rows = some(9, 300, [1, 1, 1, 2, 3])
    first, states = D.fold(frame(spark, [(*r[:3], None) for r in rows[:150]], machine), "who", machine)
    joined = frame(spark, [(*r[:3], None) for r in rows[150:]], machine).join(states.select("who", "state"), "who", "left")
    second, _ = D.fold(joined, "who", machine, state="state")
    want, _ = loop(machine, [r[:3] for r in rows])
    assert {r[0]: tuple(r)[1:] for r in first.union(second).collect()} == want
    none = frame(spark, [], machine)
    assert [x.count() for x in D.fold(none, "who", machine)] == [0, 0]


def test_streams_equal_their_batch_twins(spark):
    events = table(spark, SF, "events")
    batch = {(r.event_id, r.allowed) for r in H.rate_limit(events, 2, 0.00005).collect()}
    rows = E.timed_rows(E.stream(spark, SF, "events").select("user_id", "event_id", "ts"))
    live = E.folded(rows, "user_id", D.TokenBucket(2, 0.00005))[0]
    assert {(r.event_id, r.allowed) for r in live.collect()} == batch and not all(a for _, a in batch)


def test_stream_states_end_and_batches_may_come_again(spark):
    """Three batches, the second one twice; states of keys that are idle go, also those that no batch touches."""
    machine, folder = D.Repeats(10.0), scratch(spark, "test")
    states = Live(spark, f"{folder}/states", "who long, state string, at long", "who", 8)
    run = E.fold_batch(states, f"{folder}/out", "who", machine, late=5.0, sweep=2)
    second = 1_000_000
    batches = [[(k, k * second // 100, k, None) for k in range(200)], [(500 + k, 8 * second, 1000 + k, None) for k in range(50)] + [(3, 9 * second, 2000, None)], [(900, 60 * second, 3000, None)], [(901, 61 * second, 3001, None)]]
    left = []
    for number, rows in enumerate(batches):
        for _ in range(2 if number == 1 else 1):
            run(frame(spark, rows, machine), number)
        left.append(states.read().count())
    assert left[0] == 200 and left[1] == 250 and left[2] < left[1] and left[3] == 2
    got = {r.event_id: r.hit for r in spark.read.parquet(f"{folder}/out").collect()}
    want, _ = loop(machine, [r[:3] for rows in batches for r in rows])
    assert got == {k: v[1] for k, v in want.items()} and got[2000]


def test_breaker_states():
    machine, state, seen = D.Breaker(3, 60.0), None, []
    for ts, ok in [(0, False), (1, False), (2, False), (3, True), (70, False), (71, True), (140, True), (141, True)]:
        state, outcome = machine.step(state, ts * 1_000_000, ok)
        seen.append(outcome)
    assert seen == [("FAILED", "CLOSED"), ("FAILED", "CLOSED"), ("TRIPPED", "OPEN"), ("REJECTED", "OPEN"), ("TRIPPED", "OPEN"), ("REJECTED", "OPEN"), ("PASSED", "CLOSED"), ("PASSED", "CLOSED")]
