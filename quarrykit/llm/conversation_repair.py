r"""Repair of conversation structure by weighted CYK parsing of intervals.

Role initials of a repaired conversation read ``(s?(ua)+)?``. Its grammar in Chomsky normal form has a nonterminal N(p, q) for each pair of the
four states before nothing, after s, after u and after a, with rules N(p, q) -> N(p, r) N(r, q), and the edits of one row as terminals: Keep (cost 0),
Rerole to user or assistant (2), Delete (3; the only one for blank and repeated rows); kept and reroled rows that end without ``[.!?]`` cost 1 more. Insert
(an empty user or assistant row, 2) stands for no row, so every terminal is closed under inserts on both sides. A cell of a span holds the
least (cost, audit) of each nonterminal. Audits of one cost over one span are never each other's prefixes (an insert more costs more), so the least
of a concatenation is the concatenation of the least.

Cells are combined bottom-up by span length. All states are nonterminals, so every split point of a span gives the same cell; one is
enough, and only spans of doubling length are built: one cell a row, not its square. A task does so for ``CHUNK`` rows in a row of one conversation;
cells of longer conversations meet in pairs over all tasks, round by round, so no conversation is parsed in one place. Rows are put in
order by ranges of (conversation, turn, role, text), equal ones counted. The audit gives all edits: roles alternate, so it names what a rerole
or insert becomes, and it is applied in a stream of sorted rows that holds one batch, the audit and (for the digest) the state of a hash.

Defined cases: nulls count as one space in a role or text (so a null text is blank, a null role has no initial of the grammar and must be reroled or deleted); rows of
a null conv_id are one conversation; null turns come first; rows of one turn follow in order of role, then text; an empty role has no initial; an empty table gives an
empty result; further columns play no part. A row of the result holds a conversation's whole audit, a letter an edit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach, durable, partitions_for

SPACE = " \t\n\x0b\x0c\r"
STATES = range(4)
#: State after a role initial.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
FINAL = (0, 3)
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 2, 2, 3, 1
#: Kinds of rows: the initial's place in ``INITIALS``, ``CUT`` more if truncated; or one that must go.
INITIALS, CUT, GOES = "sua?", 4, 8
#: Rows of a conversation that a task parses in one piece, and spans whose cells it remembers.
CHUNK, SHORT = 1024, 8

Cell = tuple[tuple[int, str] | None, ...]


def _least(found: dict[tuple[int, int], tuple[int, str]], at: tuple[int, int], item: tuple[int, str]) -> None:
    if at not in found or item < found[at]:
        found[at] = item


def combine(a: Cell, b: Cell) -> Cell:
    """The cell of a span from those of its two parts."""
    out: list[tuple[int, str] | None] = []
    for p in STATES:
        for q in STATES:
            ways = [(x[0] + y[0], x[1], y[1]) for r in STATES if (x := a[4 * p + r]) and (y := b[4 * r + q])]
            cost = min((w[0] for w in ways), default=None)
            out.append(None if cost is None else (cost, min(x + y for c, x, y in ways if c == cost)))
    return tuple(out)


def _cell(found: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return tuple(found.get((p, q)) for p in STATES for q in STATES)


def _inserts() -> Cell:
    """Inserts before or after a row: none, one or two bring the grammar from any state to every other that it can reach."""
    found = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        for (p, r), (cost, audit) in list(found.items()):
            for role in "ua":
                if r in NEXT[role]:
                    _least(found, (p, NEXT[role][r]), (cost + INSERT, audit + "I"))
    return _cell(found)


NONE = _inserts()


@lru_cache(maxsize=None)
def terminal(kind: int) -> Cell:
    """The cell of one row."""
    found: dict[tuple[int, int], tuple[int, str]] = {(p, p): (DELETE, "D") for p in STATES}
    if kind != GOES:
        more = TRUNCATED if kind >= CUT else 0
        for role, cost, letter in ((INITIALS[kind % CUT], KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
            for p, q in NEXT.get(role, {}).items():
                _least(found, (p, q), (cost + more, letter))
    return combine(combine(NONE, _cell(found)), NONE)


@lru_cache(maxsize=1 << 15)
def short_span(kinds: bytes) -> Cell:
    if not kinds:
        return NONE
    half = 1 << max(0, (len(kinds) - 1).bit_length() - 1)
    return terminal(kinds[0]) if len(kinds) == 1 else combine(short_span(kinds[:half]), short_span(kinds[half:]))


def span(kinds: bytes) -> Cell:
    """The cell of the rows' kinds, by spans of doubling length."""
    cells = [short_span(kinds[i : i + SHORT]) for i in range(0, len(kinds), SHORT)] or [NONE]
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def repeated(kind: int, times: int) -> Cell:
    """The cell of equal rows in a row, by squaring."""
    found, base = NONE, terminal(kind)
    while times:
        found = combine(found, base) if times & 1 else found
        times >>= 1
        base = combine(base, base) if times else base
    return found


def faults(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (equal rows), blank, seen (before, in the conversation), truncated, initial; one row for equal ones."""
    filled = messages.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), *([F.col("n")] if "n" in messages.columns else [F.lit(1).cast("long").alias("n")]))
    runs = durable(filled.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("said", F.sha2("text", 256)))
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = runs.groupBy(F.col("conv_id").alias("__conv"), F.col("role").alias("__role"), F.col("said").alias("__said")).agg(F.min(order).alias("first"))
    met = runs.join(first, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("said") == F.col("__said")))
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    return met.select("conv_id", "turn", "role", "text", "n", (end == "").alias("blank"), (order != F.col("first")).alias("seen"), (~end.isin(".", "!", "?")).alias("truncated"), F.left("role", F.lit(1)).alias("initial"))


def _sorted(runs: DataFrame, parts: int) -> DataFrame:
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    return runs.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def cells(runs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, part, piece, head, tail (role initials), illegal, costs, audits: a cell for up to ``chunk`` rows that follow each other."""
    kind = F.when(F.col("blank") | F.col("seen"), GOES).otherwise(F.coalesce(F.nullif(F.instr(F.lit(INITIALS[:3]), F.col("initial")), F.lit(0)), F.lit(CUT)) - 1 + F.when(F.col("truncated"), CUT).otherwise(0))
    kind = F.when((F.col("initial") == "") & (kind != GOES), CUT - 1 + F.when(F.col("truncated"), CUT).otherwise(0)).otherwise(kind)
    rows = _sorted(runs.select("conv_id", "turn", "role", "text", "n", kind.cast("int").alias("kind"), "initial"), partitions_for(runs)).select("conv_id", "n", "kind", "initial")
    attach(runs.sparkSession)
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, part int, piece int, head string, tail string, illegal long, costs array<long>, audits array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, out = TaskContext.get().partitionId(), 0, []
        conv: list = []
        kinds, heads, illegal = bytearray(), ["", ""], 0
        names = ["conv_id", "part", "piece", "head", "tail", "illegal", "costs", "audits"]

        def close(cell: Cell) -> None:
            nonlocal piece, illegal, kinds
            out.append((conv[0], part, piece, heads[0], heads[1], illegal, [x[0] if x else None for x in cell], [x[1] if x else None for x in cell]))
            piece, illegal, kinds = piece + 1, 0, bytearray()

        def sent() -> pa.RecordBatch:
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for name, n, kind, initial in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv and (conv[0] != name or len(kinds) >= chunk):
                    if kinds:
                        close(span(bytes(kinds)))
                    if len(out) >= 256:
                        yield sent()
                if not kinds:
                    conv, heads = [name], [initial, initial]
                else:
                    illegal += heads[1] + initial not in ("su", "ua", "au")
                    heads[1] = initial
                kinds.append(kind)
                if n > chunk:
                    close(span(bytes(kinds)))
                    conv, heads, illegal = [name], [initial, initial], n - 2
                    close(repeated(GOES, n - 1))
                elif n > 1:
                    kinds += bytes([GOES]) * (n - 1)
                    illegal += n - 1
        if kinds:
            close(span(bytes(kinds)))
        if out:
            yield sent()

    return rows.mapInArrow(run, schema)


def audits(found: DataFrame) -> DataFrame:
    """conv_id, cost, audit, illegal of each conversation, from the table of ``cells``."""
    attach(found.sparkSession)
    found = durable(found)
    name, schema = found.schema["conv_id"].dataType.simpleString(), found.schema
    seen = found.groupBy(F.col("conv_id").alias("__conv")).agg(F.count(F.lit(1)).alias("cells"))
    several = F.broadcast(seen.where("cells > 1")) if seen.where("cells > 1").count() <= 100_000 else seen.where("cells > 1")
    same = F.col("conv_id").eqNullSafe(F.col("__conv"))
    done = [found.join(several, same, "left_anti")]
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "piece")) - 1
    now = durable(found.join(several, same, "left_semi").withColumn("piece", number).withColumn("part", F.lit(0)))

    def pair(t: pa.Table) -> pa.Table:
        a, *b = sorted(t.to_pylist(), key=lambda r: r["piece"])
        for r in b:
            cell = combine(*(tuple(None if c is None else (c, s) for c, s in zip(x["costs"], x["audits"], strict=True)) for x in (a, r)))
            illegal = a["illegal"] + r["illegal"] + (a["tail"] + r["head"] not in ("su", "ua", "au"))
            a = a | {"tail": r["tail"], "illegal": illegal, "costs": [x[0] if x else None for x in cell], "audits": [x[1] if x else None for x in cell]}
        return pa.Table.from_pylist([a | {"piece": a["piece"] // 2}], schema=t.schema)

    while not now.where("piece > 0").isEmpty():
        now = durable(now.withColumn("half", F.expr("piece div 2")).groupBy("conv_id", "half").applyInArrow(lambda t: pair(t.drop_columns(["half"])), schema))
    done.append(now)
    best = F.array_min(F.filter(F.array(*[F.struct(F.get("costs", F.lit(q)).alias("cost"), F.get("audits", F.lit(q)).alias("audit")) for q in FINAL]), lambda x: x["cost"].isNotNull()))
    whole = done[0].unionByName(done[1])
    return whole.select(F.col("conv_id").cast(name).alias("conv_id"), best["cost"].alias("cost"), best["audit"].alias("audit"), "illegal")


class _Edits:
    """Applies an audit to the rows of its conversation, one after the other."""

    AFTER = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._role(), ""

    def _role(self) -> str:
        role = self.AFTER[self.last]
        self.last = role[0]
        return role

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the inserts before a row and of the row, if it stays."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.last = role[0]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._role(), text


def _applied(runs: DataFrame, found: DataFrame, schema: str, collect) -> DataFrame:
    """Rows that ``collect`` (a function of conv_id and the repaired rows in order) yields for each conversation."""
    attach(runs.sparkSession)
    first = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(runs.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"))
    rows = first.unionByName(runs.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "n"))
    order = [F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartition(partitions_for(runs), "conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source() -> Iterator[tuple]:
            for batch in batches:
                for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        rest = source()
        held = next(rest, None)

        def repaired(audit: str) -> Iterator[tuple[str, str, str]]:
            nonlocal held
            edits = _Edits(audit)
            while held is not None and held[1] == 1:
                _, _, role, text, n = held
                for _ in range(n):
                    yield from edits.row(role, text)
                held = next(rest, None)
            yield from edits.inserts()

        while held is not None:
            conv, audit = held[0], held[3]
            held = next(rest, None)
            yield from collect(conv, repaired(audit))

    return rows.mapInArrow(run, schema)


def repaired_rows(runs: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R or I), role, text: the repaired conversations."""
    kind = runs.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def collect(conv, rows: Iterator[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
        held, start = [], 0
        for row in rows:
            held.append(row)
            if len(held) == 256:
                yield block(conv, start, held)
                start, held = start + len(held), []
        if held:
            yield block(conv, start, held)

    def block(conv, start: int, held: list[tuple[str, str, str]]) -> pa.RecordBatch:
        n = len(held)
        edit, role, text = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([conv] * n, arrow), pa.array(range(start, start + n), pa.int64()), pa.array(edit), pa.array(role), pa.array(text)], ["conv_id", "place", "edit", "role", "text"])

    return _applied(runs, found, f"conv_id {kind.simpleString()}, place long, edit string, role string, text string", collect)


def repaired_hashes(runs: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the repaired ``role:text`` joined by newlines."""
    kind = runs.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def collect(conv, rows: Iterator[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for i, (_, role, text) in enumerate(rows):
            digest.update(f"{chr(10) if i else ''}{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([conv], arrow), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    return _applied(runs, found, f"conv_id {kind.simpleString()}, repaired_sha256 string", collect)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the registered query's damage, by crc32 of ``conv_id:turn`` modulo 20."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("n"))


def repair(messages: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The table of ``faults`` and, for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    runs = durable(faults(messages))
    count = lambda c: F.sum(c).cast("long")
    long = F.col("last").cast("decimal(38,0)") - F.col("first") + 1 - F.col("turns")
    counts = runs.groupBy("conv_id").agg(
        F.min("turn").alias("first"), F.max("turn").alias("last"), F.countDistinct("turn").alias("turns"),
        count(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        count(F.when(~F.col("blank"), F.col("n") - 1 + F.col("seen").cast("long")).otherwise(0)).alias("duplicate"),
        count(F.when(~F.col("blank") & ~F.col("seen") & F.col("truncated"), 1).otherwise(0)).alias("truncated"),
    )
    counts = counts.select("conv_id", F.coalesce(long.try_cast("long"), F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated")
    found = durable(audits(cells(runs, chunk))).withColumnRenamed("conv_id", "__conv")
    both = counts.join(found, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    return runs, durable(both)


def _or(name: str, value) -> Column:
    return F.coalesce(F.col(name), F.lit(value)).alias(name)


def digest(conversations: DataFrame) -> DataFrame:
    """The registered query's columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    runs, found = repair(damaged(conversations))
    hashes = repaired_hashes(runs, found).withColumnRenamed("conv_id", "__conv")
    known = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv").withColumnRenamed("conv_id", "__conv")
    every = conversations.select("conv_id").distinct().join(known, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *zero, _or("audit", ""), _or("repaired_sha256", hashlib.sha256().hexdigest()))
