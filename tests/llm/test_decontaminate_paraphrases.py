"""Recall of what the operator's own rule accepts, against every region of every text, and of paraphrases by kind."""

import random
import re

from quarrykit.llm import decontaminate as D
from quarrykit.session import table
from tests.llm.test_operators import SCHEMA, SF

KINDS = [("dropped", 0.1), ("dropped", 0.2), ("dropped", 0.3), ("dropped", 0.4), ("replaced", 0.1), ("replaced", 0.2), ("replaced", 0.3), ("replaced", 0.4), ("shuffled", 0), ("verbatim", 0)]


def changed(rng, text, kind, share, pool):
    words = text.split()
    if kind == "dropped":
        return [w for w in words if rng.random() >= share]
    if kind == "replaced":
        return [rng.choice(pool) if rng.random() < share else w for w in words]
    if kind == "shuffled":
        parts = [p for p in re.split(r"(?<=[.!?\n])\s+", text) if p.strip()]
        rng.shuffle(parts)
        return " ".join(parts).split()
    return words


def every(item, words):
    """Whether the rule accepts any region of the words, with no gate before it."""
    width, slack = D.width_of(min(item.size, D.WIDEST)), D.slack_of(item.size)
    return any(item.judge(words[max(0, at - slack) : at + width + slack]) for at in range(0, max(1, len(words)), D.STEP))


def test_paraphrases_are_found(spark):
    rng = random.Random(8)
    benchmark = table(spark, SF, "benchmark")
    texts = {r.item_id: r.text for r in benchmark.collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text")
    clean = {r.doc_id: r.text or "" for r in docs.limit(60).collect()}
    base = [t.split() for t in clean.values() if len(t.split()) > 150]
    rows, kind_of = [], {}
    for item, text in sorted(texts.items()):
        for kind, share in KINDS:
            around = base[len(rows) % len(base)]
            cut = rng.randrange(20, 120)
            kind_of[10_000 + len(rows)] = (item, kind, share)
            rows.append((10_000 + len(rows), " ".join([*around[:cut], *changed(rng, text, kind, share, around), *around[cut:]])))
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    space = D.fit(docs)
    found = D.annotate(docs.where("doc_id < 60").unionByName(planted), benchmark, space).selectExpr("doc_id", "explode(leaks) AS leak").select("doc_id", "leak.*").collect()
    got = {(r.doc_id, r.item_id) for r in found}
    for kind in KINDS:
        mine = [d for d, k in kind_of.items() if k[1:] == kind]
        share = sum((d, kind_of[d][0]) in got for d in mine) / len(mine)
        assert share >= (1.0 if kind[0] == "verbatim" else 0.85), (kind, share)
    recall = sum((d, k[0]) in got for d, k in kind_of.items()) / len(kind_of)
    assert recall >= 0.95
    items = {i: D.Item(i, t, space.rare) for i, t in texts.items()}
    whole = clean | dict(rows)
    accepted = {(d, i) for d, t in whole.items() for i, item in items.items() if every(item, D.words_of(t))}
    assert got <= accepted and len(got) >= 0.97 * len(accepted)
    planted_pairs = {(d, k[0]) for d, k in kind_of.items()}
    assert all((d, i) in planted_pairs or any(D.words_of(texts[i])[:6] == D.words_of(whole[d])[k : k + 6] for k in range(len(D.words_of(whole[d])))) for d, i in got)


def test_vectorised_words_agree_with_the_pattern():
    strings = ["", "Ünï ĉödé 中文 🙂 İ x", "a", " lead and trail ", "x" * 50, "One, two; three.\nfour " * 40]
    words = D.Words(strings, piece=64)
    assert [words.of(i) for i in range(len(strings))] == [D.words_of(t) for t in strings]
    again = D.Words(["".join(reversed(strings[5])), strings[5]])
    assert (again.columns[again.first[1] :] == words.columns[words.first[5] :]).all()


def test_long_items_and_few_words(spark):
    long = " ".join(f"w{i} v{i % 7}" for i in range(400))
    rows = [(1, "pad " * 50 + long + " pad" * 50), (2, "only a few words"), (3, "words few a only here and there"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, long), (2, "only a few words"), (3, None), (4, "..."), (None, long)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.digest(docs, items).collect()}
    assert got == {(1, 1), (1, None), (2, 2)}
