"""Rows of chunking, parsing, links, contexts, embeddings and answers against second, independent implementations in plain Python."""

import hashlib
import html as entities
import json
import re
from collections import defaultdict
from itertools import groupby

import numpy as np
import pytest

from quarrykit import registry
from quarrykit.operators import chat as C
from quarrykit.operators import chunks as K
from quarrykit.operators import rules as R
from quarrykit.plans.pages import enriched
from quarrykit.session import table
from tests.conftest import SF

Q = registry.queries()
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def structured(spark):
    tail = "\n\n## Part\n- one\n- two\n\n```\ncode\n```\n| a | b |"
    return {r.doc_id: f"# Title\n\n{r.text}{tail}" if r.doc_id % 3 == 0 else r.text for r in table(spark, SF, "documents").collect()}


def marked(text):
    """(kind, level, line) of each line; None where a block ends."""
    code = False
    for line in text.split("\n"):
        if line.strip()[:3] == "```":
            code = not code
            yield None
        elif code:
            yield "code", 0, line
        elif m := re.fullmatch(r"(#{1,6})\s+(.*)", line):
            yield from (None, ("heading", len(m[1]), m[2].strip()), None)
        elif m := re.fullmatch(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line):
            yield "list", 0, m[1]
        elif line.lstrip()[:1] == "|":
            yield "table", 0, line.strip()
        else:
            yield ("paragraph", 0, line.strip()) if line.strip() else None


def plain_blocks(text):
    return [(key[0], key[1], [x[2] for x in rows]) for key, rows in groupby(marked(text), key=lambda m: m and m[:2]) if key]


def pack(parts, size, overlap, joint):
    """Greedy pieces: ``parts`` are cut to size first; a piece starts with whole trailing parts of the one before."""
    cut = []
    for p in parts:
        cut += [p] if len(p) <= size else [p[i : i + size] for i in range(0, len(p), size - overlap)]
    out, start, at = [], 0, 0
    while at < len(cut):
        at += 1
        if at == len(cut) or len(joint.join(cut[start : at + 1])) > size:
            out.append(joint.join(cut[start:at]))
            back = at
            while back > start and len(joint.join(cut[back - 1 : at])) <= overlap:
                back -= 1
            start = back if at < len(cut) and len(joint.join(cut[back : at + 1])) <= size else at
    return out


def plain_chunks(text, size=800, overlap=120):
    path, held, out = [], [], []

    def add(kind, contents):
        out.extend((kind, path[-1][1] if path else None, " > ".join(t for _, t in path) or None, c) for c in contents if c.strip())

    for kind, level, lines in [*plain_blocks(text), ("end", 0, [])]:
        if kind == "paragraph":
            held += K.sentences(" ".join(lines))
            continue
        add("paragraph", pack(held, size, overlap, " "))
        held = []
        if kind == "heading":
            path = [p for p in path if p[0] < level] + [(level, lines[0])]
        elif kind == "list":
            add("list", pack(["- " + x for x in lines], size, 0, "\n"))
        elif kind != "end":
            add(kind, ["\n".join(lines)])
    return [(i, *c) for i, c in enumerate(out)]


def test_blocks_chunks_and_pieces(spark):
    texts = structured(spark)
    want = {(i, n, kind, level, sha("\n".join(lines))) for i, t in texts.items() for n, (kind, level, lines) in enumerate(plain_blocks(t))}
    assert {tuple(r) for r in Q["c1_parse_blocks"](spark, SF).collect()} == want
    chunks = {(i, n, kind, title, section, sha(c)) for i, t in texts.items() for n, kind, title, section, c in plain_chunks(t)}
    for name in ("c6_chunk_blocks", "x3_chunk_udtf"):
        assert {tuple(r) for r in Q[name](spark, SF).collect()} == chunks
    assert {(r.doc_id, r.chunk_index, r.kind, r.section, r.content_sha256) for r in Q["c7_chunk_text"](spark, SF).collect()} == {(i, n, k, s, h) for i, n, k, _, s, h in chunks}
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    pieces = {(i, n, sha(c)) for i, t in docs.items() for n, kind, *_, c in plain_chunks(t, 400, 60) if kind == "paragraph"}
    assert {tuple(r) for r in Q["c5_pack_sentences"](spark, SF).collect()} == pieces
    assert plain_chunks("# A\nx. y.\n## B\n- i\n- j\n```\nk\n\nl\n```\n# C\n| t |") == [
        (0, "paragraph", "A", "A", "x. y."), (1, "list", "B", "A > B", "- i\n- j"), (2, "code", "B", "A > B", "k\n\nl"), (3, "table", "C", "C", "| t |"),
    ]


def shown(fragment):
    """Text of a piece of HTML without the elements that are not read."""
    return re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", fragment))).strip()


@pytest.fixture(scope="module")
def pages(spark):
    bare = lambda t: re.sub(r"(?s)<(script|style|noscript)\b.*?</\1>|<!--.*?-->", "", t)
    return {r.page_id: (r.url, bare(r.html), r.html) for r in enriched(spark, SF).collect()}


def test_paragraphs_and_navigation(spark, pages):
    """Test pages open <p> without closing it: a paragraph ends where the next block begins."""
    paragraphs = {r.page_id: r.value for r in Q["h3_page_paragraphs"](spark, SF).collect()}
    nav = {r.page_id: r.value for r in Q["h7_page_nav"](spark, SF).collect()}
    for i, (_, body, _) in pages.items():
        body = re.sub(r'<div class="ad">.*?</div>', "", body)
        found = [x for p in re.findall(r"(?s)<p>(.*?)(?=<p>|</p>|</article>|<(?:h\d|ul|ol|table|form|footer|div|section|figure|details|nav)\b|$)", body) if len(x := shown(p)) > 1]
        assert paragraphs[i] == sha("|".join(found)), i
        links = [shown(a) for n in re.findall(r"(?s)<nav\b.*?</nav>", body) for a in re.findall(r"(?s)<a\b[^>]*>(.*?)</a>", n)]
        links = ["About", *links] if i % 6 == 0 else links  # the header that the input adds
        assert nav[i] == "|".join(dict.fromkeys(x for x in links if x)), i


def test_clean_texts(spark, pages):
    got = {r.page_id: r.value for r in Q["h17_clean_text"](spark, SF).collect()}
    for i, (_, body, _) in pages.items():
        if i % 6 in (2, 3, 5):  # what the input adds to these pages has no heading, list or table
            body = re.sub(r'<div class="ad">.*?</div>', "", body)
            parts = [shown(re.search(r"(?s)<title>(.*?)</title>", body)[1]), *map(shown, re.findall(r"(?s)<h[1-4]\b[^>]*>(.*?)</h[1-4]>", body))]
            parts += [x for p in re.findall(r"(?s)<p>(.*?)(?=<p>|</p>|</article>|$)", body) if len(x := shown(p)) > 1]
            assert got[i] == sha("\n\n".join(dict.fromkeys(x for x in parts if x))), i


def test_classes_of_links(spark, pages):
    got = Q["h16_classify_link"](spark, SF).collect()
    assert {(r.page_id, r.url) for r in got} == {tuple(r) for r in Q["h15_extract_links"](spark, SF).collect()}
    listed = lambda host, names: any(host == n or host.endswith("." + n) for n in names)
    for r in got:
        m = re.match(r"https?://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)", r.url)
        home = re.match(r"https?://([^/?#:]+)", pages[r.page_id][0])[1]
        if not m:
            want = "external"
        elif listed(m[1], R.TRACKING):
            want = "tracking"
        elif listed(m[1], R.SOCIAL):
            want = "social"
        elif listed(m[1], R.CDN):
            want = "cdn"
        elif re.search(R.ASSETS, m[2]):
            want = "asset"
        else:
            want = "internal" if m[1].split(".")[-2:] == home.split(".")[-2:] else "external"
        assert r["class"] == want, r


def test_vectors_of_words(spark):
    norms = {r.doc_id: (r.dim, r.norm) for r in Q["k1_embed"](spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        v = np.zeros(64)
        for w in r.text.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % 64] += 1 if h >> 63 else -1
        assert norms[r.doc_id] == (64, 1.0 if v.any() else 0.0)


def test_contexts_and_answers(spark):
    texts = ["hello", "my order tracking", "the price please", "refund policy", "is it in stock", "my order shipment"]
    topics = [None, "order_status", "pricing_inquiry", "policy_inquiry", "inventory_inquiry", "order_status"]
    turns = defaultdict(list)
    for r in table(spark, SF, "conversations").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append(r)
    got = {(r.conv_id, r.turn): json.loads(r.context) for r in Q["l19_chat_context"](spark, SF).collect()}
    for conv, rows in turns.items():
        past, last = [], None
        for n, r in enumerate(rows):
            topic = topics[(conv + r.turn // 2) % 6] if r.role == "user" else None
            switch = topic is not None and last is not None and topic != last
            past, last = ([topic, *[t for t in past if t != topic]], topic) if topic else (past, last)
            context = got.pop((conv, r.turn))
            assert context["turns"] == min(n, 12) and context["recent_topics"] == past[:5] and context["topic_switch"] == switch
            said = texts[(conv + r.turn // 2) % 6]
            assert r.role != "user" or context["entities"] == ("order " in said)  # the word behind an order is its number
    assert not got
    prompts = {(r.conv_id, r.turn): r for r in Q["x2_generate_answers"](spark, SF).collect()}
    users = {(r.conv_id, r.turn) for rows in turns.values() for r in rows if r.role == "user"}
    assert prompts.keys() == users
    refusals = {sha(C.REFUSAL + s) for s in [C.SUFFIX, *C.SUFFIXES.values()]}
    assert all((prompts[k].answer_sha256 in refusals) == (k[0] % 3 == 0) for k in users)
