"""Training-data operators against brute force on small tables, with nulls, ties, repeats, empties and clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrykit.llm import chat_format, decontaminate, exact_dedup, language_id, line_dedup, packing, quality_pu, simhash_dedup, substring_dedup, token_counts
from quarrykit.llm._tokens import vocabulary, vocabulary_path
from quarrykit.session import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, id long, body string, fp long, rank int"
WORDS = "alpha beta gamma delta the of and to run river stone light green house morning quiet".split()


def make(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, "en", "s", len(t or ""), "x", 9, "b", 1, 2) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, empty and blank texts, a very long one, repeats of a row, a null id, text in other scripts."""
    rng = random.Random(5)
    long = prose(rng, 6000)
    texts = [None, "", " \t\n", "one", "two  words", long, long, "Ünï ĉödé 中文 🙂 İ", "one", prose(rng, 60), None]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None]
    docs = make(spark, [*texts, texts[9], "one"], [*ids, 9, 3]).cache()
    return docs


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, awkward):
    got = exact_dedup.exact_dedup(awkward).collect()
    rows = awkward.select("doc_id", "text").collect()
    groups = defaultdict(list)
    norm = lambda t: re.sub("[\x20\x09-\x0D]+", " ", t or "")
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    want = []
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_line_dedup_brute_force(spark):
    rng = random.Random(1)
    lines = [prose(rng, 5) for _ in range(30)]
    block = [prose(rng, 6) for _ in range(12)]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(1, 8)) + (block if i % 3 == 0 else []) + rng.choices(lines, k=3)) for i in range(40)] + [None, "", "\n", "a\n\nb"]
    docs = make(spark, texts)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}

    def chunks(text):
        ls, hs, out, start = text.split("\n"), [], [], 0
        for i, x in enumerate(ls):
            hs.append(int(hashlib.md5(x.encode()).hexdigest()[:8], 16))
            h = hs[i] + 31 * (hs[i - 1] if i > 0 else 0) + 961 * (hs[i - 2] if i > 1 else 0)
            if h % 4 == 0 or i == len(ls) - 1:
                out.append((start, "\n".join(ls[start : i + 1]), i + 1 - start))
                start = i + 1
        return out

    seen = {}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].text is None and got[i].line_dedup.n_lines == 0
            continue
        kept = []
        for start, body, n in chunks(t):
            if n < 2 or seen.setdefault(body, (i, start)) == (i, start):
                kept.append(body)
        assert got[i].text == "\n".join(kept)
        assert got[i].line_dedup.n_lines == t.count("\n") + 1
    assert any(r.line_dedup.n_removed for r in got.values())
    assert got[0].keep_id == "x" and line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_awkward(awkward):
    got = line_dedup.dedup_lines(awkward).collect()
    assert len(got) == awkward.count()


def test_simhash_groups(spark, awkward):
    rng = random.Random(2)
    texts = [prose(rng, 80) for _ in range(30)]
    for i in range(0, 30, 3):
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), texts[i].upper()]
    texts += [None, "", "one two", "One two"]
    docs = make(spark, texts)
    got = {r.doc_id: r for r in simhash_dedup.digest(docs).collect()}

    def fp(t):
        w = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    label[j] = min(label[j], label[i])
    for i, f in enumerate(fps):
        assert got[i].fingerprint == f"{f:016x}" and got[i].component_id == label[i]
    assert {r.component_id for r in simhash_dedup.near_groups(awkward).where("doc_id IN (0, 1, 2)").collect()} == {0}
    assert simhash_dedup.digest(empty(spark)).count() == 0
    kept = [r.doc_id for r in simhash_dedup.dedup(docs, k=3).collect()]
    assert sorted(kept) == sorted(set(label))


def test_simhash_dense_cells():
    """Large cells give the same groups as all pairs, and a number of links linear in their size."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) for b in base] + [base]))
    reps = rng.permutation(len(fps)).astype(np.int64)
    a, b = simhash_dedup.links_of_large(fps, reps)
    assert len(a) == len(fps) - 5
    assert (simhash_dedup.manhattan(simhash_dedup.segment_counts(fps[:50, None]), simhash_dedup.segment_counts(fps[None, :50])) <= np.bitwise_count(fps[:50, None] ^ fps[None, :50])).all()


def test_simhash_tiles_lose_no_link(spark):
    rng = np.random.default_rng(4)
    base = np.uint64(0x0F0F123456789ABC)
    flips = {int(base)} | {int(base) ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 64, (300, 2))}
    rows = [(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(sorted(flips))]
    distinct = spark.createDataFrame(rows, "fp long, rep long")
    for tile in (4096, 16):
        nodes = simhash_dedup.components(simhash_dedup.near_links(distinct, tile=tile))
        assert {r.component for r in nodes.collect()} == {0} and nodes.count() == len(rows) - 1


def test_substring_dedup_brute_force(spark, awkward):
    rng = random.Random(6)
    passage = prose(rng, 55)
    texts = [f"{prose(rng, rng.randrange(0, 40))} {passage if i % 2 else ''} {prose(rng, 10)}" for i in range(12)] + [f"{passage} {passage}", None, "", "few words"]
    docs = make(spark, texts)
    got = {r.doc_id: r for r in substring_dedup.digest(docs).collect()}
    words = [re.findall("[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = set()
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone |= set(range(k, k + 20))
            seen.add(window)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    spans = substring_dedup.dedup_substrings(awkward).where("doc_id = 6").first()
    assert spans.n_removed == 6000 and spans.keep_id == "x" and len(spans.removed) == 1
    assert substring_dedup.digest(empty(spark)).count() == 0


def test_token_counts_every_prefix(spark, awkward):
    path = vocabulary_path("byte_bpe_50k.json")
    tokenizer = vocabulary(path)
    rng = random.Random(7)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'re", "'ll", "'s", "'", "1", "23", "é", "中", " ", "　", "!", "...", "<|endoftext|>", "<|end", "\x1c", "́", "🙂"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        want = [len(tokenizer.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]
        assert token_counts.prefix_array(text, path).tolist() == want, repr(text)
    counted = token_counts.prefix_counts(awkward)
    for r in awkward.join(counted.drop("doc_id"), F.lit(False), "left").limit(0).collect():
        raise AssertionError(r)
    got = defaultdict(set)
    for r in token_counts.digest(awkward).collect():
        got[r.doc_id].add((r.n_bytes, r.n_tokens, r.over_limit))
    for r in awkward.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        assert (len((r.text or "").encode()), n, n > 1024) in got[r.doc_id]
    one = counted.where("doc_id = 4")
    assert one.select(token_counts.tokens_before(F.col("prefixes"), F.lit(3)).alias("n")).first().n == len(tokenizer.encode("two").ids)
    budget = token_counts.within_budget(counted.where("doc_id = 5"), 50).first().n_chars
    text = awkward.where("doc_id = 5").first().text
    assert len(tokenizer.encode(text[:budget]).ids) <= 50 < len(tokenizer.encode(text[: budget + 40]).ids)


def test_packing_round_trip(spark, awkward):
    path = vocabulary_path("word_bpe_49k.json")
    tokenizer = vocabulary(path)
    packed = packing.pack(awkward, keep_ids=True).cache()
    rows = packed.collect()
    pieces = defaultdict(list)
    for r in rows:
        assert r.length <= 2048 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        pieces[r.doc_id].append(r)
    for r in awkward.dropDuplicates(["doc_id"]).collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        if r.doc_id in (3, 9):
            continue  # repeated rows are packed twice
        joined = b"".join(bytes(p.ids) for p in sorted(pieces[r.doc_id], key=lambda p: p.start))
        assert np.frombuffer(joined, "<u4").tolist() == ids and all(p.doc_tokens == len(ids) for p in pieces[r.doc_id])
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.sequences(packed).agg(F.sum("n_tokens")).first()[0] == sum(r.length for r in rows)
    assert packing.pack(empty(spark)).count() == 0


def test_histogram_packing_is_whole_and_tight():
    rng = random.Random(8)
    histogram = {n: rng.randrange(1, 50) for n in range(1, 2049)}
    patterns = packing.pack_histogram(histogram)
    placed = defaultdict(int)
    for pattern, count in patterns:
        assert sum(pattern) <= 2048
        for n in pattern:
            placed[n] += count
    assert dict(placed) == histogram
    assert sum(n * c for n, c in histogram.items()) / (2048 * sum(c for _, c in patterns)) > 0.97
    assert len(patterns) <= 3 * 2048


def test_language_id_held_out(spark, awkward):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in language_id.digest(docs).collect()}
    held = [(r.lang, got[r.doc_id]) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(g.held_out for _, g in held) and np.mean([lang == g.lang_pred for lang, g in held]) > 0.97
    rows = {r.doc_id: r.language for r in language_id.identify(awkward, language_id.fit(docs)).collect()}
    assert rows[0].predicted == rows[1].predicted == "und" and rows[0].score == 0
    long = " ".join(r.text for r in docs.where("lang = 'en'").limit(2000).collect())
    model = language_id.fit(docs)
    named, scores = model.predict([long, long[:2000]])
    assert named == ["en", "en"] and scores[0] > 0.9  # a set of everything in a long text would tell nothing
    few = docs.where("lang = 'en'").limit(3000).unionByName(docs.where("lang = 'es'").limit(4))
    assert language_id.fit(few, rows=200).languages == ["en", "es"]  # rare languages are drawn as well
    same = language_id.digest(docs.limit(50).unionByName(docs.limit(50))).collect()
    assert len({(r.doc_id, r.lang_pred, r.score) for r in same}) == len({r.doc_id for r in same})
    assert language_id.digest(empty(spark)).count() == 0


def test_quality_held_out(spark, awkward):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = {r.doc_id: r for r in quality_pu.digest(docs, labels).collect()}
    marks = [(r.quality, got[r.doc_id].score) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for q, s in marks if q], [s for q, s in marks if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.5) == q for q, s in marks]) > 0.97
    _, model = quality_pu.score(docs, labels)
    assert abs(model.prior - np.mean([q for q, _ in marks])) < 0.1
    rows = quality_pu.digest(awkward, labels.limit(0)).collect()
    assert len(rows) == awkward.count() and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    bad = spark.createDataFrame([(i, 0) for i in range(11)], "doc_id long, quality int")
    rows = quality_pu.digest(awkward, bad).collect()
    assert all(abs(r.score - 0.001) < 1e-9 and r.predicted == 0 for r in rows)
    again = docs.limit(300)
    twice = defaultdict(set)
    for r in quality_pu.digest(again.unionByName(again), labels).collect():
        twice[r.doc_id].add(r.score)
    assert all(len(scores) == 1 for scores in twice.values())  # repeated rows score alike
    marked = labels.selectExpr("doc_id", "quality", "toxic AS score", "1 AS held_out")
    clash = docs.limit(200).withColumn("score", F.lit("x")).withColumn("x", F.lit(1)).withColumn("id", F.lit(2))
    assert quality_pu.score(clash, marked)[0].count() == 200
    assert quality_pu.digest(empty(spark), labels).count() == 0


def test_decontamination_finds_leaks_and_paraphrases(spark, awkward):
    docs, benchmark = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    items = {r.item_id: r.text for r in benchmark.collect()}
    clean = [r.text for r in docs.collect()]
    filler = clean[3].split()
    paraphrase = items[5].split()
    del paraphrase[4::9]
    texts = [" ".join(filler[:37]) + " " + items[2] + " " + " ".join(filler[37:80]), " ".join(filler[:20] + paraphrase + filler[20:50]), items[7].upper(), None, ""]
    planted = make(spark, texts, [10_000 + i for i in range(len(texts))]).select(docs.columns)
    got = decontaminate.digest(docs.unionByName(planted), benchmark).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert {(10_000, 2), (10_001, 5), (10_002, 7)} <= pairs
    norm = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    for r in docs.collect():
        for i, t in items.items():
            if norm(t) in norm(r.text):
                assert (r.doc_id, i) in pairs
    assert len({d for d, _ in pairs if d < 10_000}) < 30
    assert decontaminate.annotate(awkward, benchmark).count() == awkward.count()
    assert decontaminate.digest(empty(spark), benchmark).count() == 0
    assert decontaminate.digest(docs, benchmark.limit(0)).count() == 0


def test_chat_keeps_nameless_and_repeated_results(spark):
    kind = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>, rules string, copies string"
    calls = spark.createDataFrame([(1, "a", 1, "search", '{"query": "x", "limit": 3}', None, "r", "c"), (1, None, 2, "search", None, [None], "r", "c")], kind)
    results = spark.createDataFrame([(1, None, 5, "one"), (1, None, 6, "two"), (1, None, 6, "two"), (1, "a", 7, "late"), (1, "a", 3, "early")], "conv_id long, call_id string, turn long, content string")
    got = chat_format.link_calls(calls, results).collect()
    assert sorted((r.turn, r.json) for r in got if r.status == "orphan") == [(5, '{"content":"one"}'), (6, '{"content":"two"}'), (6, '{"content":"two"}')]
    a, late = sorted((r for r in got if r.call_id == "a"), key=lambda r: r.part)
    assert a.result_copies == 1 and '"content":"early"' in a.json and a.turn == 1
    assert (late.status, late.turn, late.part, late.json) == ("repeat", 7, 2, '{"content":"late","id":"a"}')
    assert [r.errors for r in got if r.status == "invalid"] == ["bad_json"]
    messages = spark.createDataFrame([(1, 0, "user", None)], "conv_id long, turn long, role string, text string")
    assert '{"role":"user"}' in [r.json for r in chat_format.format_chat(messages, calls, results).collect()]


def test_chat_levels_in_few_rounds(spark, monkeypatch):
    """Branching chains, trees, ladders and cycles against a search; rounds of chains with branches stay logarithmic."""
    rng = random.Random(4)
    deps = {f"c{i}": [f"c{i - 1}", f"leaf{i}"] if i else [] for i in range(200)} | {f"leaf{i}": [] for i in range(200)}
    trees = {f"t{i}": [f"t{(i - 1) // 2}"] if i else [] for i in range(100)} | {f"r{i}": [f"r{2 * i + 1}", f"r{2 * i + 2}"] if i < 60 else [] for i in range(121)}
    odd = {f"x{i}": [f"x{j}" for j in rng.sample(range(30), 2)] if i % 3 else [] for i in range(30)} | {"me": ["me"], "behind": ["me", "c0", "nowhere"]}
    deps |= trees | odd

    def level(c, seen=()):
        if c in seen:
            return None
        below = [level(d, (*seen, c)) for d in deps[c] if d in deps]
        return None if None in below else max((b + 1 for b in below), default=0)

    rounds = []
    durable = chat_format.durable
    monkeypatch.setattr(chat_format, "durable", lambda df: rounds.append(1) or durable(df))
    rows = spark.createDataFrame([(1, c, d) for c, d in deps.items()], "conv_id long, call_id string, depends_on array<string>")
    got = {r.call_id: r.level for r in chat_format.levels(rows).collect()}
    want = {c: (i if c.startswith("c") else 0) for i, c in enumerate(f"c{i}" for i in range(200))}
    assert all(got[c] == want[c] for c in want)
    rest = {c: level(c) for c in deps if c not in want}
    assert {c: v for c, v in got.items() if c not in want} == {c: v for c, v in rest.items() if v is not None}
    assert len(rounds) <= 2 * 14 + 2


def test_chat_links(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 1, "search", '{"query": "x", "limit": 3}', []),
            (1, "b", 2, "search", '{"limit": "3"}', ["a", "zz"]),
            (1, "c", 3, "nope", "{}", ["b", "a"]),
            (1, "d", 4, "search", "not json", ["e"]),
            (1, "e", 5, "translate", '{"target":"xx","text":"t","more":[1,{"b":2,"a":1}]}', ["d"]),
            (1, "a", 9, "search", "{}", []),
            (2, None, 1, "summarize", '{"text":"t","max_words":5}', []),
        ],
        "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, "a", 2, "found"), (1, "zz", 8, "lost"), (1, "b", 3, None)], "conv_id long, call_id string, turn long, content string")
    found = chat_format.link_calls(calls, results).collect()
    assert [(r.turn, r.status, r.errors) for r in found if r.status == "repeat"] == [(9, "repeat", "missing:limit;missing:query")]
    got = {(r.conv_id, r.call_id): r for r in found if r.status != "repeat"}
    assert got[1, "a"].status == "ok" and got[1, "a"].copies == 1 and got[1, "a"].level == 0
    assert got[1, "a"].json == '{"arguments":{"limit":3,"query":"x"},"content":"found","id":"a","level":0,"name":"search"}'
    assert got[1, "b"].errors == "missing:query;type:limit" and got[1, "b"].level == 1
    assert got[1, "c"].errors == "unknown_tool" and got[1, "c"].level == 2
    assert got[1, "d"].errors == "bad_json" and got[1, "d"].level is None and got[1, "e"].level is None
    assert got[1, "e"].errors == "enum:target;extra:more" and '"more":[1,{"a":1,"b":2}]' in got[1, "e"].json
    assert got[1, "zz"].status == "orphan" and got[2, None].errors == "range:max_words"
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digest(none).count() == 0


def test_chat_null_turns_conversations_and_repeats(spark):
    kind = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
    good = '{"query": "x", "limit": 3}'
    calls = [(1, "a", None, "search", good, []), (None, "b", 1, "search", good, []), (None, "b", 2, "search", "{}", []), (2, "c", 1, "search", good, []), (2, "c", 1, "search", good, []), (2, "c", 4, "search", "{}", [])]
    results = [(1, "a", 2, "one"), (1, "a", 3, "two"), (None, "b", 3, "x"), (None, "b", 3, "y"), (2, "c", None, None)]
    got = chat_format.link_calls(spark.createDataFrame(calls, kind), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")).collect()
    rows = sorted((r.conv_id or 0, r.call_id, r.part, r.status, r.copies, r.result_copies) for r in got)
    assert rows == [
        (0, "b", 1, "invalid", 1, 0), (0, "b", 1, "no_result", 1, 0), (0, "b", 2, "orphan", 0, 1), (0, "b", 2, "orphan", 0, 1),
        (1, "a", 1, "ok", 1, 1), (1, "a", 2, "repeat", 0, 1), (2, "c", 1, "ok", 2, 1), (2, "c", 1, "repeat", 1, 0),
    ]


def test_chat_ladder_of_200_levels(spark, monkeypatch):
    """Each call needs all calls of the level before; rounds follow the logarithm of the depth."""
    rounds = []
    durable = chat_format.durable
    monkeypatch.setattr(chat_format, "durable", lambda df: rounds.append(1) or durable(df))
    rows = [(c, f"{i}-{j}", [f"{i - 1}-{k}" for k in range(n)] if i else []) for c, n in ((1, 2), (2, 8)) for i in range(200) for j in range(n)]
    got = chat_format.levels(spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")).collect()
    assert len(got) == len(rows) and all(r.level == int(r.call_id.split("-")[0]) for r in got)
    assert len(rounds) <= 10


def test_many_languages_of_few_rows(spark):
    rng = random.Random(3)
    signs = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join("".join(rng.choice(signs[k % 26] + signs[k // 26] + "eio") for _ in range(6)) for _ in range(30)), f"l{k:02d}") for i, k in enumerate(range(30)) for i in range(i * 20, i * 20 + 20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=20)
    assert len(model.languages) == 30


def test_chat_levels_match_longest_paths(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for conv in range(6):
        deps = {}
        for k in range(40):
            deps[k] = sorted({rng.randrange(k) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))}) if k else []
        if conv == 5:
            deps = {k: [k - 1] if k else [] for k in range(40)} | {40: [41], 41: [40], 42: [41, 3]}
        level = {}
        for k in sorted(deps):
            if k < 40:
                level[k] = 1 + max((level[x] for x in deps[k]), default=-1)
        want |= {(conv, str(k)): v for k, v in level.items()}
        rows += [(conv, str(k), [str(x) for x in xs]) for k, xs in deps.items()]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")
    assert {(r.conv_id, r.call_id): r.level for r in chat_format.levels(calls).collect()} == want


def test_heavy_slots_bound_the_buckets_at_every_size():
    """What is left in a bucket stays near the mean, also with as many buckets as slots (a hundred times those of small tables)."""
    rng = np.random.default_rng(8)
    for buckets in (64, 4096, 1 << 19):
        slots = buckets * max(1, -(-substring_dedup.SLOTS // buckets))
        counts = rng.poisson(5000, slots).astype(float)
        counts[7] = counts.sum() / 50  # a run in a fiftieth of all windows
        left = np.where(substring_dedup.heavy(counts, buckets), 0, counts)
        assert not left[7] and np.bincount(np.arange(slots) % buckets, left).max() <= 5 * counts.sum() / buckets
    keys = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert ((substring_dedup.slot_of(keys, 64 * 4096) % 64) == ((keys >> np.uint64(23)) % np.uint64(64)).astype(np.int64)).all()


def test_substring_dedup_splits_heavy_runs(spark):
    """Many texts share twelve words between random ones: the run is counted as heavy, buckets stay even, and results whole."""
    rng = random.Random(12)
    phrase = " ".join(f"shared{i}" for i in range(12))
    texts = [f"{' '.join(str(rng.random()) for _ in range(14))} {phrase} {' '.join(str(rng.random()) for _ in range(14))}" for _ in range(1500)]
    twice = " ".join(f"again{i}" for i in range(30))
    docs = make(spark, [*texts, twice, f"{phrase} {twice}"]).select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    assert substring_dedup.heavy_slots(docs, 20, 16).any()
    blobs = substring_dedup.window_blobs(docs, 20, 16).where("NOT settled").select("bucket", (F.octet_length("hashes") / 8).alias("n"))
    sizes = [r.n for r in blobs.groupBy("bucket").agg(F.sum("n").alias("n")).collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes) and len(sizes) == 16
    spans = [tuple(r) for r in substring_dedup.repeated_intervals(make(spark, [*texts, twice, f"{phrase} {twice}"]), buckets=16).collect()]
    gone = {(i, k) for i, a, b in spans for k in range(a, b)}
    assert gone == {(1501, 12 + k) for k in range(30)}
