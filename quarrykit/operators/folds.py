"""Ordered folds of long keys over many tasks: state machines whose steps compose.

A fold takes a key's rows in order of (at, event_id) through a machine: state and row give the next state and an outcome. Rows are dealt out by ranges of
(key, at, event_id), so a key of many rows lies in several tasks. All keys of a task but its first start there and are folded at once. Of the
first, the task does not know the state it starts from, so it follows all states at a time: those that lead to the same state are one
from then on, which leaves a machine a few of them (``Unknown``). The driver goes once over these summaries (one a task) and hands every task the
state its first key starts from; those rows alone are folded then, in as many tasks.

States come and go as tables (key, state, at), so a stream folds batch by batch (``streaming.events.fold_stream``); a state that a fresh key
would have as well is dropped.

Times are whole microseconds. Defined cases: null keys are one key; null times come first and count as 0; equal times follow in order of
event_id; repeated rows are rows like others; an empty table gives empty results.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import attach, durable, partitions_for

State = Any


class Machine:
    """``inputs``: columns that a step reads; ``outcomes``: DDL of what it gives. States are JSON values; None is that of a fresh key."""

    inputs: list[str] = []
    outcomes = ""

    def step(self, state: State, at: int, *row) -> tuple[State, tuple]:
        raise NotImplementedError

    def unknown(self) -> Unknown:
        raise NotImplementedError

    def fresh(self, state: State, now: int) -> bool:
        """Whether a key without a state would go on alike, for rows from ``now`` on."""
        return state is None


class Unknown:
    """All states at a time."""

    def step(self, at: int, *row) -> None:
        raise NotImplementedError

    def end(self, state: State) -> State:
        """The state after the rows so far for the one before them."""
        raise NotImplementedError


class Waiting(Unknown):
    """Of a machine whose states are a few fixed ones and those that nothing changes until ``delay`` after their time.

    A row ends the wait of all times up to its own less the delay, which share a state from then on. Neighbouring groups of times that
    come to one state are one group; a row that resets the machine makes one of all that it meets.
    """

    def __init__(self, machine: Machine, fixed: list[State], delay: int, waiting):
        self.machine, self.fixed, self.delay, self.waiting = machine, fixed, delay, waiting
        self.at_fixed, self.ended, self.states = list(range(len(fixed))), [], list(fixed)

    def step(self, at: int, *row) -> None:
        step = self.machine.step
        until = at - self.delay
        if not self.ended or self.ended[-1][0] < until:
            self.ended.append((until, len(self.states)))
            self.states.append(self.waiting(until))
        found: dict = {}
        moved = []
        for state in self.states:
            after = step(state, at, *row)[0]
            moved.append(found.setdefault(json.dumps(after), (len(found), after))[0])
        if len(found) < len(moved):  # some came to the same state
            self.at_fixed = [moved[i] for i in self.at_fixed]
            ended = [(bound, moved[i]) for bound, i in self.ended]
            self.ended = [x for x, y in zip(ended, [*ended[1:], (0, -1)], strict=True) if x[1] != y[1]]
            used = sorted({*self.at_fixed, *(i for _, i in self.ended)})
            place = {old: new for new, old in enumerate(used)}
            self.at_fixed, self.ended = [place[i] for i in self.at_fixed], [(b, place[i]) for b, i in self.ended]
            states = [state for _, state in found.values()]
            self.states = [states[i] for i in used]
        else:
            self.states = [state for _, state in found.values()]

    def end(self, state: State) -> State:
        if state in self.fixed:
            return self.states[self.at_fixed[self.fixed.index(state)]]
        since = self.since(state)
        return next((self.states[i] for bound, i in self.ended if since <= bound), state)

    def since(self, state: State) -> int:
        return self.machine.since(state)


class Breaker(Machine):
    """A circuit breaker: ``limit`` failures in a row open it, after ``reset`` seconds one call is let through on trial.

    States: None (closed, no failure), a number of failures, or ["OPEN", time]."""

    inputs, outcomes = ["ok"], "outcome string, state string"

    def __init__(self, limit: int, reset: float):
        self.limit, self.reset = limit, round(reset * 1e6)

    def step(self, state: State, at: int, ok: bool) -> tuple[State, tuple]:
        trial = isinstance(state, list)
        if trial and at - state[1] < self.reset:
            return state, ("REJECTED", "OPEN")
        if ok:
            return None, ("PASSED", "CLOSED")
        failures = 1 + (0 if trial else state or 0)
        if trial or failures >= self.limit:
            return ["OPEN", at], ("TRIPPED", "OPEN")
        return failures, ("FAILED", "CLOSED")

    def unknown(self) -> Unknown:
        return Waiting(self, [None, *range(1, self.limit)], self.reset, _opened)

    def since(self, state: State) -> int:
        return state[1]


def _opened(at: int) -> State:
    return ["OPEN", at]


class Repeats(Machine):
    """A key within ``ttl`` seconds of its last miss is a hit; hits do not extend the time. States: None, or the time of the last miss."""

    outcomes = "hit boolean"

    def __init__(self, ttl: float):
        self.ttl = round(ttl * 1e6)

    def step(self, state: State, at: int) -> tuple[State, tuple]:
        hit = state is not None and at - state < self.ttl
        return (state if hit else at), (hit,)

    def unknown(self) -> Unknown:
        return Waiting(self, [None], self.ttl, _missed)

    def since(self, state: State) -> int:
        return state

    def fresh(self, state: State, now: int) -> bool:
        return state is None or now - state >= self.ttl


def _missed(at: int) -> State:
    return at


class TokenBucket(Machine):
    """A bucket of ``most`` tokens that fills by ``per_second``; a row takes a token if there is one.

    Tokens count in microseconds of filling, so sums are exact. States: None (full), or [filling, time]."""

    outcomes = "allowed boolean"

    def __init__(self, most: float, per_second: float):
        self.full, self.cost = round(most / per_second * 1e6), round(1e6 / per_second)

    def step(self, state: State, at: int) -> tuple[State, tuple]:
        held = self.full if state is None else min(self.full, state[0] + max(0, at - state[1]))
        allowed = held >= self.cost
        return [held - self.cost if allowed else held, at], (allowed,)

    def unknown(self) -> Unknown:
        return Filling(self.full, self.cost)

    def fresh(self, state: State, now: int) -> bool:
        return state is None or state[0] + now - state[1] >= self.full


class Filling(Unknown):
    """What is in the bucket as a function of what was in it at the first row: stretches on which it is constant or differs by a constant."""

    def __init__(self, full: int, cost: int):
        self.full, self.cost = full, cost
        self.first = self.last = None
        self.pieces: list[tuple[int, int | None, int]] = [(full, None, 0)]  # (up to, constant, or None and the difference)

    def step(self, at: int) -> None:
        gained = 0 if self.last is None else max(0, at - self.last)
        self.first = at if self.first is None else self.first
        self.last = at
        found: list[tuple[int, int | None, int]] = []

        def add(upto: int, constant: int | None, more: int) -> None:
            if found and found[-1][1:] == (constant, more):
                found.pop()
            if not found or found[-1][0] < upto:
                found.append((upto, constant, more))

        low = 0
        for upto, constant, more in self.pieces:
            if constant is not None:
                held = min(self.full, constant + gained)
                add(upto, held - self.cost if held >= self.cost else held, 0)
            else:
                more += gained
                kept = min(upto, self.cost - more - 1, self.full - more)  # too little for a token
                if kept >= low:
                    add(kept, None, more)
                taken = min(upto, self.full - more)
                if taken >= max(low, self.cost - more):
                    add(taken, None, more - self.cost)
                if upto > self.full - more:
                    add(upto, self.full - self.cost if self.full >= self.cost else self.full, 0)
            low = upto + 1
        self.pieces = found

    def end(self, state: State) -> State:
        held = self.full if state is None else min(self.full, state[0] + max(0, self.first - state[1]))
        constant, more = next((c, m) for upto, c, m in self.pieces if held <= upto)
        return [held + more if constant is None else constant, self.last]


class Streak(Machine):
    """Consecutive weak rows; two in a row escalate. States: None, or their number."""

    inputs, outcomes = ["weak"], "streak int, escalate boolean"

    def step(self, state: State, at: int, weak: bool) -> tuple[State, tuple]:
        n = (state or 0) + 1 if weak else 0
        return n or None, (n, n >= 2)

    def unknown(self) -> Unknown:
        return Counting()


class Counting(Unknown):
    def __init__(self):
        self.reset, self.n = False, 0

    def step(self, at: int, weak: bool) -> None:
        self.reset, self.n = (self.reset, self.n + 1) if weak else (True, 0)

    def end(self, state: State) -> State:
        return (self.n if self.reset else self.n + (state or 0)) or None


def microseconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


class _Groups:
    """Runs of equal keys in sorted batches."""

    def __init__(self):
        self.key: list = []

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple[bool, tuple]]:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = not self.key or self.key[0] != row[0]
            self.key = [row[0]]
            yield new, row


def _fields(ddl: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in ddl.split(",")]


def fold(rows: DataFrame, key: str, machine: Machine, at: str = "at", state: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(event_id, key, outcomes) of each row, and (key, state, at) after each key's last one.

    ``rows``: key, ``at`` (long), event_id, the machine's inputs and, if named, ``state``: each key's state before (JSON or null).
    """
    attach(rows.sparkSession)
    names, kinds = _fields(machine.outcomes), rows.schema[key].dataType.simpleString()
    before = (F.col(state) if state else F.lit(None)).cast("string")
    base = rows.select(F.col(key).alias("key"), F.coalesce(F.col(at), F.lit(0)).cast("long").alias("at"), F.col("event_id").cast("long").alias("event_id"), before.alias("before"), *machine.inputs)
    order = [F.col("key").asc_nulls_first(), "at", "event_id"]
    ranged = base.repartitionByRange(partitions_for(base), *order).sortWithinPartitions(*order)
    arrow = [to_arrow_type(f.dataType) for f in rows.sparkSession.createDataFrame([], machine.outcomes).schema]
    kept = f"key {kinds}, at long, event_id long, before string" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in machine.inputs)
    schema = f"part int, open boolean, tail boolean, summary binary, after string, {kept}, {machine.outcomes}"
    columns = _fields(schema)
    none = (None,) * len(names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, groups, unknown, now = TaskContext.get().partitionId(), _Groups(), machine.unknown(), None
        opened, held, types = True, None, None

        def record(row: list) -> None:
            out.append(tuple(row))

        out: list[tuple] = []
        for batch in batches:
            types = types or [pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.string(), *batch.schema.types, *arrow]
            for new, row in groups.rows(batch):
                if new and held is not None:  # the last row of the key before
                    held[3:5] = [pickle.dumps(unknown), None] if opened else [None, json.dumps(now)]
                    opened, now = False, None if row[3] is None else json.loads(row[3])
                if held is not None:
                    record(held)
                if opened:
                    unknown.step(row[1], *row[4:])
                    result = none
                else:
                    now, result = machine.step(now, row[1], *row[4:])
                held = [part, opened, False, None, None, *row, *result]
            yield _batch(out, columns, types)
            out.clear()
        if held is not None:
            held[2], held[3:5] = True, [pickle.dumps(unknown), None] if opened else [None, json.dumps(now)]
            record(held)
            yield _batch(out, columns, types)

    # the first key of the first task starts there as well, but is left open like others
    once = durable(ranged.mapInArrow(first, schema))
    ends = once.where("tail OR summary IS NOT NULL").select("part", "key", "tail", "summary", "after", "before").collect()  # at most two rows a task
    entry: dict[int, State] = {}
    last: tuple[list, State] | None = None  # the last key and its state at the end of the tasks so far
    for r in sorted(ends, key=lambda r: (r["part"], r["tail"])):
        if r["summary"] is not None:
            same = last is not None and last[0] == [r["key"]]
            entry[r["part"]] = last[1] if same else None if r["before"] is None else json.loads(r["before"])
        if r["tail"]:
            last = [r["key"]], pickle.loads(bytes(r["summary"])).end(entry[r["part"]]) if r["summary"] is not None else json.loads(r["after"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, now, held, types, out = _Groups(), None, None, None, []
        for batch in batches:
            types = types or [pa.string(), *[batch.schema.field(i).type for i in (1, 2, 3)], *arrow]
            for new, row in groups.rows(batch):
                if new:
                    if held is not None:
                        held[0] = json.dumps(now)
                    now = entry[row[0]]
                if held is not None:
                    out.append(tuple(held))
                now, result = machine.step(now, row[2], *row[5:])
                held = [None, row[1], row[2], row[3], *result]
            yield _batch(out, ["after", "key", "at", "event_id", *names], types)
            out.clear()
        if held is not None:
            held[0] = json.dumps(now)
            yield _batch([tuple(held)], ["after", "key", "at", "event_id", *names], types)

    deferred = once.where("open").select("part", "key", "at", "event_id", "before", *machine.inputs)
    deferred = deferred.repartitionByRange(partitions_for(base), "part").sortWithinPartitions("part", "at", "event_id")
    found = durable(deferred.mapInArrow(second, f"after string, key {kinds}, at long, event_id long, {machine.outcomes}"))
    every = once.where("NOT open").select("after", "key", "at", "event_id", *names).unionByName(found)
    states = every.where("after IS NOT NULL").groupBy("key").agg(F.max_by("after", F.struct("at", "event_id")).alias("state"), F.max("at").alias("at"))
    return every.select("event_id", F.col("key").alias(key), *names), states.withColumnRenamed("key", key)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
