"""Source mixing, conversation repair and embedding whitening against brute force, with nulls, ties, repeats and clashing names."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import conversation_repair, embedding_whitening, source_mixing
from quarrykit.session import table

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


# Mixing


def wanted(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by plain resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if rate * weight[s] >= most * sizes[s]}
        if not above:
            return target | {s: rate * weight[s] for s in open_}
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def mix_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix string, size string, key string, hash long, plan int, words int")


def check_mix(rows, got, slack):
    size = lambda t: len(WORD.findall(t or ""))
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[2]] += size(r[1])
    target = wanted(sizes)
    assert sorted((r.doc_id is not None, r.doc_id, r.size) for r in got) == sorted((r[0] is not None, r[0], size(r[1])) for r in rows)
    source = {(r[0], size(r[1])): r[2] for r in rows}
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= slack(s), s


def test_mix_against_plain_resharing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice([1, 3, 40, 200]))), rng.choice(["b", "b", "b", "a", "Z", "é", "\U0001f600", None]), "m", "s", "k", 1, 2, 3) for i in range(600)]
    rows += [(None, "null id", "a"), (900, None, "a"), (901, " \t", "only-blank"), (902, "", None), (903, "word " * 3000, "long")]
    rows = [(*r, *("m", "s", "k", 1, 2, 3)[len(r) - 9 :])[:9] if len(r) < 9 else r for r in rows]
    got = source_mixing.digest(mix_rows(spark, rows)).collect()
    check_mix(rows, got, lambda s: 201 if s != "long" else 3001)
    again = source_mixing.digest(mix_rows(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_of_equal_rows_and_hot_sources(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "CHUNK", 64)
    more = ("m", "s", "k", 1, 2, 3)
    rows = [(5, "four words in all", "hot", *more)] * 700 + [(i, "x " * (i % 5), "hot", *more) for i in range(20, 90)] + [(i, "y " * 9, "z", *more) for i in range(100, 140)]
    got = source_mixing.digest(mix_rows(spark, rows)).collect()
    check_mix(rows, got, lambda s: 9)
    assert 0 < len({r.taken for r in got if r.doc_id == 5}) <= 2
    assert source_mixing.digest(mix_rows(spark, [])).count() == 0
    assert {r.target for r in source_mixing.digest(mix_rows(spark, [(1, None, "a", *more), (2, " ", None, *more)])).collect()} == {0.0}


def test_mix_keeps_columns_and_repeats_texts(spark):
    docs = table(spark, SF, "documents").withColumn("mix", F.lit("old"))
    sized = docs.withColumn("size", source_mixing.words("text"))
    got = source_mixing.mix(sized)
    assert set(got.columns) == set(sized.columns) and got.count() == docs.count()
    times = {r.doc_id: r.mix.times for r in got.collect()}
    out = source_mixing.mixed(docs)
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter({i: n for i, n in times.items() if n})
    smaller = {r.doc_id: r.mix.times for r in source_mixing.mix(sized, share=0.7).collect()}
    single = {r.doc_id: r.mix.times for r in source_mixing.mix(sized, weights=(1,), share=0.2).collect()}
    half = {r.doc_id: r.mix.times for r in source_mixing.mix(sized, weights=(1,), share=0.4).collect()}
    assert all(single[i] <= half[i] for i in single) and sum(smaller.values()) < sum(times.values())  # budgets are nested


# Repair


def edits_by_search(rows):
    """(cost, audit) by a uniform-cost search over rows and states; ``rows``: (initial, must go, truncated)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        if i < len(rows):
            initial, goes, cut = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state))
            if not goes:
                if (state, initial) in step:
                    heapq.heappush(queue, (cost + cut, audit + "K", i + 1, step[state, initial]))
                for role in "ua":
                    if (state, role) in step:
                        heapq.heappush(queue, (cost + 2 + cut, audit + "R", i + 1, step[state, role]))
        for role in "ua":
            if (state, role) in step:
                heapq.heappush(queue, (cost + 2, audit + "I", i, step[state, role]))


def brute(rows):
    """Digest of one conversation's rows (turn, role, text) after damage, in order."""
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    turns = [t for t, _, _ in rows if t is not None]
    seen, marks, blank, duplicate, truncated = set(), [], 0, 0, 0
    for _, role, text in rows:
        end = text.rstrip(space)[-1:]
        cut = False
        if not end:
            blank += 1
        elif (role, text) in seen:
            duplicate += 1
        elif end not in ".!?":
            truncated += 1
            cut = True
        marks.append((role[:1], not end or (role, text) in seen, int(cut)))
        seen.add((role, text))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
    cost, audit = edits_by_search(marks)
    out, last, at = [], "", 0
    after = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    for letter in audit:
        if letter != "I":
            _, role, text = rows[at]
            at += 1
        if letter == "D":
            continue
        role, text = (after[last], "") if letter == "I" else (after[last], text) if letter == "R" else (role, text)
        out.append(f"{role}:{text}")
        last = role[0]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute_digest(rows):
    groups, want = defaultdict(list), {}
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        fault = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        groups[conv]
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", shown[3]) if fault == 2 else shown[3]
        groups[conv] += [(turn, "user" if fault == 4 else shown[2], text)] * (2 if fault == 3 else 1)
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0], r[1].encode(), r[2].encode()))
        want[conv] = brute(found) if found else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    return want


def test_cells_hold_the_least_edits_at_every_split():
    kinds = [0, 1, 2, 3, 4, 5, 6, 7, 8]
    of = lambda k: ("sua?"[k % 4] if k < 8 else "u", k == 8, int(4 <= k < 8))
    rng = random.Random(2)
    cases = [bytes(c) for n in (0, 1, 2, 3) for c in itertools.product(kinds, repeat=n)] + [bytes(rng.choices(kinds, k=rng.randrange(4, 40))) for _ in range(300)]
    for case in cases:
        cell = conversation_repair.span(case)
        got = min(x for x in (cell[0], cell[3]) if x)
        assert got == edits_by_search([of(k) for k in case]), case
        for cut in range(1, len(case)):
            assert conversation_repair.combine(conversation_repair.span(case[:cut]), conversation_repair.span(case[cut:])) == cell
            if len(case) > 12:
                break
    assert conversation_repair.repeated(8, 37) == conversation_repair.span(bytes([8] * 37))


@pytest.fixture(scope="module")
def chats(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "Σ"]
    texts = ["Yes.", "No!", "well", "a longer line of text that ends. ", " \t\n", "", None, "again?", "x. ", "héllo …"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}.") for c in range(150) for t in range(rng.randrange(1, 12))]
    rows += [(None, t, "user", "null conversation.") for t in (None, 1, 2)] + [(7, None, "user", "no turn"), (7, None, None, None), (8, 3, "user", "tie."), (8, 3, "user", "tie."), (8, 3, "assistant", "tie.")]
    rows += [(500, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"t{t % 90}.") for t in range(700)]  # a long one
    rows += [(501, None, "user", "same")] * 60 + [(502, -5, "user", "x." * 30_000)]
    rows += [(1000 + k, 0, "user", "x") for k in range(60)]  # some lose their only row
    return rows


def test_repair_against_search(spark, chats, monkeypatch):
    names = "conv_id long, turn long, role string, text string"
    frame = spark.createDataFrame(chats, names).select("*", F.lit("z").alias("n"), F.lit(1).alias("kind"), F.lit("q").alias("said"), F.lit(0).alias("audit")).repartition(5)
    want = brute_digest(chats)
    for chunk in (conversation_repair.CHUNK, 16):  # whole conversations in one piece, and long ones over many tasks
        monkeypatch.setattr(conversation_repair.repair, "__defaults__", (chunk,))
        got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.digest(frame).collect()}
        assert got.keys() == want.keys()
        assert {c: (got[c], want[c]) for c in want if got[c] != want[c]} == {}
    assert any(v[6] == "" for v in want.values())
    assert conversation_repair.digest(frame.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "hi."), (1, 2, "user", "cut"), (2, 0, "user", "q?"), (2, 1, "user", "q?"), (2, 2, "assistant", "a.")]
    runs, found = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(map(tuple, conversation_repair.repaired_rows(runs, found).collect()))
    assert got == [(1, 0, "K", "system", "s."), (1, 1, "I", "user", ""), (1, 2, "K", "assistant", "hi."), (2, 0, "K", "user", "q?"), (2, 1, "K", "assistant", "a.")]
    assert {r.conv_id: r.audit for r in found.collect()} == {1: "KIKD", 2: "KDK"}


# Whitening


def exact_digest(rows):
    """x vectors, n, mean and covariance in fractions."""
    kept = [(i, [math.floor(64 * np.float64(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows]
    distinct = sorted({tuple(x) for _, x in kept})
    n, d = len(distinct), len(distinct[0])
    mean = [Fraction(sum(x[i] for x in distinct), n) for i in range(d)]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in distinct) / n for j in range(d)] for i in range(d)]
    return kept, n, mean, cov


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "id") for i, v in rows], "vec_id long, embedding array<float>, label int, x string, n long, id string")


def check_whitening(rows, got, components=16):
    kept, n, mean, cov = exact_digest(rows)
    v = np.array([[float(c) for c in row] for row in cov])
    e, u = np.linalg.eigh(v)
    order = [k for k in np.argsort(-e) if e[k] > 1e-11 * e.max()][:components]
    assert sorted((repr(r.vec_id), r.component) for r in got) == sorted((repr(i), k + 1) for i, _ in kept for k in range(len(order)))
    deviation = defaultdict(set)
    for i, x in kept:
        found = sum(int(n * (a - m)) ** 2 for a, m in zip(x, mean, strict=True))
        deviation[i].add(found if found < 1 << 63 else None)
    by_id = defaultdict(dict)
    for r in got:
        assert r.n == n and r.deviation in deviation[r.vec_id] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(e[order[r.component - 1]] / np.trace(v), rel=1e-9)
        by_id[r.vec_id][r.component] = r.whitened
    for i, x in kept:
        if len(deviation[i]) == 1:
            z = np.array([float(a - m) for a, m in zip(x, mean, strict=True)]) @ u[:, order] / np.sqrt(e[order])
            assert np.allclose(np.abs(z), np.abs([by_id[i][k + 1] for k in range(len(order))]), rtol=1e-7, atol=1e-9)


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 9)) @ np.diag([3, 2.5, 2, 1.5, 1.2, 1, 0.7, 0.5, 0.3])
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(base.astype(np.float32))]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (0, rows[0][1]), (None, rows[3][1])]  # copies, a repeated id, a null id
    broken = [(200, None), (201, [None] * 9), (202, [float("nan")] + [0.0] * 8), (203, [math.inf] + [0.0] * 8), (204, []), (205, [1.0, 2.0])]
    got = embedding_whitening.digest(vectors(spark, rows + broken)).collect()
    check_whitening(rows, got)
    assert embedding_whitening.digest(vectors(spark, [])).count() == 0
    assert embedding_whitening.digest(vectors(spark, broken[:5])).count() == 0
    assert embedding_whitening.digest(vectors(spark, [(1, [1.0, 2.0])] * 3)).count() == 0  # no variance


def test_whitening_of_flat_far_and_huge_vectors(spark):
    rng = np.random.default_rng(5)
    flat = [(i, [float(a), 2.0 * float(a), 5.0]) for i, a in enumerate(rng.integers(0, 50, 40))]
    got = embedding_whitening.digest(vectors(spark, flat)).collect()
    check_whitening(flat, got)
    assert {r.component for r in got} == {1}
    far = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(1e9 + rng.normal(size=(30, 3)) * 1e6)]
    check_whitening(far, embedding_whitening.digest(vectors(spark, far)).collect())
    huge = vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])
    found = embedding_whitening.digest(huge).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and {r.deviation is None for r in found} == {True, False}


def test_polarised_sums_are_exact():
    rng = np.random.default_rng(6)
    for scale in (100, 1 << 40, 1 << 61):
        x = rng.integers(-scale, scale, (50, 4))
        middle = x.mean(axis=0).astype(np.int64)
        y = [[int(a) - int(m) for a, m in zip(row, middle, strict=True)] for row in x]
        want = [sum(r[i] ** 2 for r in y) for i in range(4)] + [sum((r[i] + r[j]) ** 2 for r in y) for i in range(4) for j in range(i + 1, 4)]
        assert embedding_whitening.polarised(x, middle) == want


def test_whitening_of_the_test_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, SF, "embeddings").collect()]
    check_whitening(rows, embedding_whitening.digest(table(spark, SF, "embeddings")).collect())
