"""Golden rows and invariants of the library's own operators."""

import random

from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.operators import chat as C
from quarrykit.operators import chunks as K
from quarrykit.operators import retrieval as R
from quarrykit.operators import snapshots as S
from quarrykit.operators.components import components
from quarrykit.plans.text import unsafe_address
from quarrykit.session import table
from quarrykit.sources import pages as P
from tests.conftest import SF


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text")).alias("x")).first().x


def test_sentences_keep_abbreviations_and_decimals(spark):
    text = 'Dr. Smith paid $3.50 today. He said "Go." Then J. K. left! Really? Yes.'
    assert one(spark, text, T.split_sentences) == ["Dr. Smith paid $3.50 today.", 'He said "Go."', "Then J. K. left!", "Really?", "Yes."]


def test_cleaning(spark):
    assert one(spark, "See https://a.b/c?utm_source=x&id=1&fbclid=2 ok? https://a.b/?gclid=9 end", T.strip_tracking_params) == "See https://a.b/c?id=1 ok? https://a.b/ end"
    assert one(spark, "January 5, 2024 and 12 feb 2023", T.normalize_dates) == "2024-01-05 and 2023-02-12"
    assert one(spark, " a\r\n\r\n\r\n\r\nb \t c ", T.normalize_whitespace) == "a\n\nb c"
    assert one(spark, "what?? no.... “x”", T.normalize_punctuation) == 'what? no... "x"'


def test_chunks_cover_the_text():
    rng = random.Random(1)
    text = "\n\n".join("# H" + str(i) if i % 4 == 0 else " ".join(f"Word{rng.randrange(99)} ends." for _ in range(rng.randrange(1, 200))) for i in range(20))
    found = list(K.chunks(text))
    assert [c[0] for c in found] == list(range(len(found)))
    joined = " ".join(c[4] for c in found)
    assert all(w in joined for w in set(text.replace("#", "").split()) if w.startswith("Word"))
    assert max(len(c[4]) for c in found) <= K.SIZE


def test_parser_reads_unclosed_tags():
    page = P.parse_page("<title>T</title><p><b>one<p>two<ul><li>x<li>y</ul><script>var a='</p>'</script><div class=ad>no</div>")
    assert page["paragraphs"] == ["one", "two"] and page["lists"] == [{"ordered": False, "items": ["x", "y"]}] and page["title"] == "T"
    assert P.parse_page(None)["paragraphs"] == [] and P.xml_leaves("<a><b>1</b>") == ("1", "not well-formed")
    assert P.json_leaves('{"a":[1,{"b":" "}],"c":true}') == ("1\ntrue", None) and P.json_leaves("{")[1]


def test_snapshot_null_hash_is_modified(spark):
    prev = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "url string, content_hash string")
    cur = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", None)], "url string, content_hash string")
    assert {r.url: r.change for r in S.snapshot_diff(prev, cur).collect()} == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "new"}


def test_unsafe_addresses(spark):
    rows = {"10.1.2.3": True, "8.8.8.8": False, "172.31.0.1": True, "172.32.0.1": False, "::1": True, "fe80::2": True, "::ffff:127.0.0.1": True, "2001:db8::1": False}
    got = spark.createDataFrame([(k,) for k in rows], "ip string").select("ip", unsafe_address(F.col("ip")).alias("u")).collect()
    assert {r.ip: r.u for r in got} == rows


def test_components_on_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_ann_recall(spark):
    v = table(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id) for r in R.knn(q, v, 10).collect()}
    near = {(r.query_id, r.vec_id) for r in R.ann(q, v, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_rolling_memory_is_bounded(spark):
    rows = spark.createDataFrame([(1, i, "user", f"Line {i} " + "x" * 150) for i in range(30)], "conv_id long, turn long, role string, text string")
    memory = C.rolling_memory(rows).first().memory
    assert len(memory) <= 800 and "Line 29" in memory and "Line 0 " not in memory


def test_white_space_without_regular_expressions(spark):
    """As the pattern of a browser's white space has it; the plain replacements leave no such pattern to the plan."""
    texts = ["", " ", "a", " a\x0b b ", "﻿A\t\r\nB  c　", "x" + T.SPACE_CHARS + "y", "​z ​", "é  ü ", None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    squeezed = F.regexp_replace(F.lower("t"), f"{T.SPACES}+", " ")
    trimmed = lambda c: F.regexp_replace(c, f"^{T.SPACES}+|{T.SPACES}+$", "")
    got = rows.select(T.trim_spaces(F.col("t")), T.content_hash(F.col("t")))
    assert got.collect() == rows.select(trimmed(F.col("t")), F.sha2(trimmed(squeezed), 256)).collect()
    assert "2028" not in got._jdf.queryExecution().toString()


def test_issues_are_found_once(spark):
    from quarrykit.plans.text import QUERIES

    plan = QUERIES["p11_validate_units"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repetitive_content") == 1


def test_policies_are_counted_where_a_piece_stands(spark):
    from quarrykit.operators import rules as R

    texts = ["Our data  protection and GDPR notes", "MONEY-BACK money back within a month", "cancel an order, CANCELATION", "terms & conditions, terms of use", "delivery\ntime of things; shipping", "guarantee warranty warranty", "cookies, cookie and cookies", "nothing of the kind is said here", "personal  data, personal data", None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    for name, _, pattern in R.POLICIES:
        held = " OR ".join(f"contains(lower(t), '{p}')" for p in R.POLICY_PIECES[name])
        assert rows.where(F.regexp_count("t", F.lit("(?i)" + pattern)) > 0).where(f"NOT ({held})").count() == 0
    got = [r[0] and r[0]["policy_type"] for r in rows.select(R.policy(F.col("t"), F.lit(""), F.lit(""))).collect()]
    assert got == ["PRIVACY", "REFUND", "CANCELLATION", "TERMS", "SHIPPING", "WARRANTY", "COOKIES", "OTHER", "PRIVACY", None]


def test_letters_are_counted_by_runs(spark):
    from quarrykit.operators import rules as R

    rows = spark.createDataFrame([("é1 𝒜b!!",), ("!!!! ???? a",), ("",), (None,)], "t string")
    made = R.confidence(F.col("t"), F.lit("page"), F.lit(1.0), F.lit(False), F.lit(1), F.lit(None).cast("double"), F.lit(False))
    assert "regexp_count" not in str(made) and [r[0] for r in rows.select(made).collect()] == [0.8175, 0.73, 0.0, 0.9475]


def test_equal_texts_are_not_hashed_again(spark, tmp_path, monkeypatch):
    from quarrykit.sources.buckets import Live
    from quarrykit.streaming import events as E

    monkeypatch.setattr(E.T, "content_hash", lambda c: F.when(c == "a", F.raise_error(F.lit("hashed"))).otherwise(F.lower(c)))
    live = Live(spark, f"{tmp_path}/live", "chunk_id long, text string, version int", "chunk_id", 2)
    run = E.apply_changes(live, f"{tmp_path}/archive")
    for number, texts in enumerate((["a", "b", None, "d"], ["a", "B c", "e", None])):
        run(spark.createDataFrame([(i, x, number) for i, x in enumerate(texts)], "chunk_id long, text string, seq int"), number)
    assert sorted((r["chunk_id"], r["text"], r["version"]) for r in live.read().collect()) == [(0, "a", 1), (1, "B c", 2), (2, None, None), (3, "d", 1)]


def test_links_leave_the_parser_alone(spark):
    """One Python step a task, that gives out links and no parsed pages."""
    html = '<a href="/a/">x</a><a href="/a#t">y</a><a href="#t">z</a><a href="mailto:m@b.example">m</a><a href="http://[x/">bad</a><a href="">e</a><nav><a href="b?q=1">b</a></nav>'
    pages = spark.createDataFrame([(1, "https://h.example/d/", html), (2, None, '<a href="https://o.example">o</a>'), (3, "https://h.example/", None)], "page_id long, url string, html string")
    found = P.page_links(pages)
    assert sorted(map(tuple, found.collect())) == [(1, "https://h.example/a"), (1, "https://h.example/d/b?q=1"), (2, "https://o.example/")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") >= 1


def test_html_patterns_meet_only_pages_with_a_substring_they_need():
    """What a page may match holds a needed substring (so results stay), and only one pattern on the html has none."""
    import re

    from quarrykit.operators import signals as G
    from quarrykit.plans.technology import CASES

    assert G.needed(r"(?i)\bgtag\s*\(\s*['\"]config['\"]|a\.b+c") == ["config", "a.b"]
    assert G.needed(r"x{0,1}yyz?|(ab)+\$q") == ["yy", "$q"] and G.needed("xy?|ab") == []
    ungated, seen = [], 0
    for _, _, _, *tests in G.RULES:
        for field, pattern in zip(tests[::2], tests[1::2], strict=True):
            if field == "html":
                words = G.literals(pattern) or G.needed(pattern)
                ungated += [] if words else [pattern]
                for case in CASES:
                    if re.search(pattern, case["html"]):
                        seen += 1
                        assert not words or any(w in case["html"].lower() for w in words), (pattern, words)
    assert ungated == [r"\b(G|UA)-[A-Z0-9-]{6,}\b"] and seen > 100


def test_technologies_of_pages_that_are_not_valid_utf8(spark):
    from pyspark.sql import functions as F

    from quarrykit.operators import signals as G

    html = F.concat(F.unhex(F.lit("FF")), F.lit("<p>PAYPAL.buttons () cdn.jsdelivr.net</p>").cast("binary")).cast("string")
    empty = F.array().cast("array<string>")
    site = spark.range(1).select(F.col("id").alias("page_id"), html.alias("html"), F.create_map().cast("map<string,string>").alias("headers"), empty.alias("cookies"), empty.alias("nameservers"), empty.alias("probes"), empty.alias("sitemaps"), F.lit(False).alias("robots"))
    assert {(r["category"], r["name"], r["weight"]) for r in G.hits(site, ["payment", "cdn"]).collect()} == {("payment", "PayPal", 0.85), ("cdn", "JSDelivr", 0.85)}
