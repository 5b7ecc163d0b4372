"""Operators without SQL against plain Python over whole small tables."""

import csv
import hashlib
import io
import json
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarrykit import registry
from quarrykit.functions import text as T
from quarrykit.operators import chunks as K
from quarrykit.plans import build as B
from quarrykit.session import table
from tests.conftest import SF

Q = registry.queries()


@pytest.fixture(scope="module")
def events(spark):
    rows = table(spark, SF, "events").selectExpr("event_id", "user_id", "event_type", "props", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS s").collect()
    return sorted(rows, key=lambda r: (r.s, r.event_id))


def test_delimited_json_and_xml_texts(spark, events):
    got = {name: sorted(r.text for r in Q[name](spark, SF).collect()) for name in ("s2_read_delimited", "s3_read_json_leaves", "s4_read_xml_leaves")}
    parsed = [list(csv.reader(io.StringIO(f'id,type\n\n{e.event_id},"{e.event_type}"'))) for e in events]
    assert got["s2_read_delimited"] == sorted("\n".join(" | ".join(row) for row in rows if row) for rows in parsed)

    def leaves(x):
        return [y for v in (x.values() if isinstance(x, dict) else x) for y in leaves(v)] if isinstance(x, dict | list) else [] if x is None or not str(x).strip() else [str(x).lower() if isinstance(x, bool) else str(x)]

    assert got["s3_read_json_leaves"] == sorted(t for e in events if (t := "\n".join(leaves(json.loads(e.props)))))
    assert got["s4_read_xml_leaves"] == sorted(f"{e.event_id} {e.event_type}" if e.event_id % 5 == 0 else f"{e.event_id}\n{e.event_type}" for e in events)


@pytest.mark.parametrize("name", ["r3_rate_limit", "r3_rate_limit_batch"])
def test_rate_limits(spark, events, name):
    want, state = {}, {}
    for e in events:
        tokens, last = state.get(e.user_id, (2.0, e.s))
        tokens = min(2.0, tokens + (e.s - last) * 0.00005)
        want[e.event_id] = tokens >= 1
        state[e.user_id] = (tokens - want[e.event_id], e.s)
    assert {r.event_id: r.allowed for r in Q[name](spark, SF).collect()} == want and len(set(want.values())) == 2


def test_repeated_queries(spark, events):
    missed, want = {}, {}
    for e in events:
        key = f"{e.user_id}{e.event_type}"
        want[e.event_id] = key in missed and e.s - missed[key] < 60
        if not want[e.event_id]:
            missed[key] = e.s
    assert {r.event_id: r.hit for r in Q["r4_repeat_queries"](spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["r5_outages", "w11_outage_states"])
def test_outages(spark, events, name):
    want, state = {}, defaultdict(lambda: ["CLOSED", 0, 0.0])
    for e in events:
        now = state[e.user_id % 20]
        if now[0] == "OPEN" and e.s - now[2] < 60:
            want[e.event_id] = ("REJECTED", "OPEN")
            continue
        trial = now[0] == "OPEN"
        if e.event_type != "error":
            now[:] = ["CLOSED", 0, 0.0]
            want[e.event_id] = ("PASSED", "CLOSED")
        else:
            now[1] += 1
            trips = trial or now[1] >= 3
            now[0], now[2] = ("OPEN", e.s) if trips else ("CLOSED", now[2])
            want[e.event_id] = ("TRIPPED" if trips else "FAILED", now[0])
    assert {r.event_id: (r.outcome, r.state) for r in Q[name](spark, SF).collect()} == want


def test_memory_of_conversations(spark):
    turns = defaultdict(list)
    for r in table(spark, SF, "conversations").orderBy("conv_id", "turn").collect():
        line = re.sub(r"[.!?]", "", re.sub(r"\s+", " ", r.text)[:120])
        turns[r.conv_id].append(f"{r.role.capitalize()} said: {line}.")
    want = {}
    for conv, lines in turns.items():
        kept = []
        for line in lines:
            kept.append(line)
            while len(" ".join(kept)) > 800 and len(kept) > 1:
                kept.pop(0)
        want[conv] = " ".join(kept)
    assert {r.conv_id: r.memory for r in Q["w7_rolling_memory"](spark, SF).collect()} == want


def test_contexts_and_prompts(spark):
    rows = table(spark, SF, "conversations").orderBy("conv_id", "turn").collect()
    prompts = {(r.conv_id, r.turn): json.loads(r.prompt) for r in Q["p20_build_prompts"](spark, SF).collect()}
    history = defaultdict(list)
    for r in rows:
        if r.role == "user":
            got = prompts.pop((r.conv_id, r.turn))
            assert got[1:] == history[r.conv_id][-12:] + [{"role": "user", "content": r.text}]
            assert got[0]["role"] == "system" and got[0]["content"].endswith(f"Evidence:\n[1] {r.text}\n[2] {r.text.upper()}")
        history[r.conv_id].append({"role": r.role, "content": r.text})
    assert not prompts


def test_both_splitters_cut_alike(spark):
    cases = ["Prof. Kay met Ms. Lee at No. 5, St. Anne vs. Inc. rules. Then? Yes!", 'Pi is 3.14. He said "Go." Now. E.g. this, e.g. that.', "A. B. Smith Jr. left etc. Or not."] + [r.text for r in table(spark, SF, "documents").limit(60).collect() if "\n" not in r.text]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, text string").select("i", T.split_sentences(F.col("text")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: K.sentences(t) for i, t in enumerate(cases)}


def test_texts_of_chunks(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    pieces = defaultdict(int)
    for r in Q["c5_pack_sentences"](spark, SF).collect():
        pieces[r.doc_id] += 1
    assert set(pieces) == {i for i, t in docs.items() if t.strip()}
    for r in Q["c7_chunk_text"](spark, SF).where("kind = 'code'").collect():
        assert r.content_sha256 == hashlib.sha256(b"code").hexdigest()


def test_page_operators(spark):
    pages = {r.page_id: r for r in table(spark, SF, "pages").collect()}
    languages = {r.doc_id: r for r in Q["h19_page_languages"](spark, SF).collect()}
    assert languages and all(r.multilingual == ("," in r.languages) for r in languages.values())
    assert not any(r.value for r in Q["h11_strip_noise"](spark, SF).collect())
    links = defaultdict(set)
    for r in Q["h15_extract_links"](spark, SF).collect():
        links[r.page_id].add(r.url)
    for i, p in pages.items():
        base = re.match(r"https?://[^/?#]+", p.url).group()
        nav = {f"{base}{h}" for h in re.findall(r'<li><a href="(/[^"/?#]+)">', p.html)}
        assert nav <= links[i]
    classes = defaultdict(int)
    for r in Q["h16_classify_link"](spark, SF).collect():
        classes[r["class"]] += 1
    assert sum(classes.values()) == sum(map(len, links.values())) and classes["internal"] > classes["external"]
    assert {r.type for r in Q["s7_document_links"](spark, SF).collect()} == {"pdf"}


def test_knowledge_build(spark):
    units = spark.createDataFrame(
        [("a", "u1", "T", "First text that stays as it is.", "page", 1.0, False, None), ("b", "u2", "T", "Second text with new words in it.", "page", 400.0, True, None), ("c", "u3", "T", "first  TEXT that stays as it is.", "heuristic", 1.0, False, 50.0), ("d", "u4", "T", "Refund policy: money back in thirty days.", "page", 1.0, False, None)],
        "unit_id string, url string, title string, content string, source string, age_days double, failed boolean, ocr double",
    )
    old = B.embed(spark.createDataFrame([("o1", "u1", "T", "First text that stays as it is."), ("o2", "u2", "T", "Second text with old words."), ("o3", "u9", "T", "Gone.")], "chunk_id string, url string, section string, content string"), "content")
    built = B.build_knowledge(units, old, spark.createDataFrame([("o3",)], "chunk_id string"), near=0.99)
    rows = {r.chunk_key: r for r in built.chunks.collect()}
    kept = "a#0" if rows["c#0"].action == "duplicate" else "c#0"  # of two equal contents the smaller key hash stays
    assert rows["b#0"].action == "updated" and rows["b#0"].chunk_id == "o2" and rows["d#0"].action == "created" and rows["d#0"].category == "Policies"
    assert sorted(rows[k].action for k in ("a#0", "c#0")) == (["duplicate", "unchanged"] if kept == "a#0" else ["created", "duplicate"])
    assert rows[kept].cluster_size == 2 and all(r.language == "English" for r in rows.values())
    assert [r.chunk_id for r in built.removed.collect()] == ["o3"]
    vectors = {r.vec_id: r.embedding for r in built.vectors.collect()}
    assert "o3" not in vectors and {"o1", "o2", "d#0"} <= vectors.keys() and abs(sum(x * x for x in vectors["o2"]) - 1) < 1e-6


def test_training_run(spark):
    n = {r.stage: r.n for r in Q["k8_train"](spark, SF).collect()}
    docs = table(spark, SF, "documents").count()
    assert n["vectors"] > 0 and n["edges"] > 0 and n["policies"] > 0 and n["contacts"] > 0 and n["products"] > 0
    assert sum(v for k, v in n.items() if k.startswith("chunks ") and k != "chunks removed") >= docs
    built = Q["k7_build_knowledge"](spark, SF).groupBy("action").count().collect()
    assert {f"chunks {r.action}": r["count"] for r in built} == {k: v for k, v in n.items() if k.startswith("chunks ")}
