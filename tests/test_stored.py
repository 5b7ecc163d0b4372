"""Stored postings, vector indexes and embeddings, sitemap indexes, mentions and conversation memory against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.operators import chat as C
from quarrykit.operators import retrieval as R
from quarrykit.operators import vector_index as V
from quarrykit.operators.postings import Postings
from quarrykit.plans.knowledge import embed
from quarrykit.session import scratch, table
from quarrykit.sources.embeddings import EmbeddingStore
from quarrykit.sources.sitemaps import sitemap_entries, sitemap_urls
from tests.conftest import SF
from tests.test_neighbors import clustered

WORDS = [f"{a}{b}{c}" for a in "bdgkmt" for b in "aeiou" for c in "lnrs"]


def corpus(seed, n):
    rng = random.Random(seed)
    pick = lambda: WORDS[min(int(rng.expovariate(0.06)), len(WORDS) - 1)]
    return [(i, " ".join(pick() for _ in range(rng.randrange(0, 60)))) for i in range(n)]


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_postings_give_the_rows_of_bm25_and_read_no_document_again(spark):
    docs = spark.createDataFrame([*corpus(1, 400), (400, None), (401, "")], "doc_id long, text string")
    queries = spark.createDataFrame([*[(i, t[:120]) for i, t in corpus(2, 25)], (90, "nowhere zz"), (91, None)], "query_id long, text string")
    index = Postings(spark, scratch(spark, "postings"), 8)
    assert index.search(queries, 5).count() == 0
    assert index.extend(docs.where("doc_id < 250"), 3) == 250
    assert rows(index.search(queries, 5)) == rows(R.bm25(queries, docs.where("doc_id < 250"), 5))
    for _ in range(2):
        assert index.extend(docs, 9) == 152  # known ids are left out, a batch that comes again overwrites itself
    for k in (1, 3, 10, 500):
        assert rows(index.search(queries, k)) == rows(R.bm25(queries, docs, k))
    assert Postings(spark, index.path, 8).search(queries, 3).count() == R.bm25(queries, docs, 3).count()


def test_postings_read_the_buckets_of_their_terms(spark):
    index = Postings(spark, scratch(spark, "postings"), 32)
    index.extend(spark.createDataFrame(corpus(3, 200), "doc_id long, text string"), 0)
    one = spark.createDataFrame([("bal",)], "term string")
    plan = index._read("postings", "term string, doc_id long, n long, tf long, bucket int").where(F.col("bucket").isin([r[0] for r in one.select(index._bucket("term")).collect()]))
    assert len({f.split("bucket=")[1].split("/")[0] for f in plan.select("doc_id").where("bucket >= 0").inputFiles()}) >= 1
    explained = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in explained and "bucket" in explained.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_stored_vectors(spark, monkeypatch, spread):
    x = clustered(1500, 40, spread, 11)
    frame = lambda lo, hi: spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(lo, hi)], "vec_id long, embedding array<float>")
    index = V.VectorIndex.build(frame(0, 1200), scratch(spark, "index"))
    for _ in range(2):
        index.extend(frame(1200, 1500), 5)
    index = V.VectorIndex(spark, index.path)  # as another session finds it
    assert index.rows().count() == 1500 and len(index.centres) >= 30
    queries = frame(0, 1500).where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(q, v) for q, v, *_ in rows(R.knn(queries, frame(0, 1500), 10))}
    got = rows(index.search(queries, 10))
    assert len(exact & {(q, v) for q, v, *_ in got}) / len(exact) >= 0.9
    monkeypatch.setattr(V, "BLOCK", 16)  # lists met in blocks
    assert rows(index.search(queries, 10)) == got
    one = queries.where("query_id = 20")
    lists = [r.block for r in index.probed(one, 2).collect()]
    cells = {int(index.cells[i]) for i in lists}
    opened = {int(re.search(r"cell=(\d+)", f).group(1)) for f in _scanned(index.members(lists))}
    assert opened <= cells and len(cells) < len(set(index.cells.tolist()))
    if spread < 1:
        assert index.probes <= len(index.centres) // 3


def _scanned(df):
    """Files that a scan opens, after partition pruning."""
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_known_texts_are_not_encoded_again(spark):
    store = EmbeddingStore(spark, scratch(spark, "embeddings"), "m1", 4)
    first = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c")], "id long, text string")
    second = spark.createDataFrame([(1, "a b"), (6, "new"), (7, "new")], "id long, text string")
    for _ in range(2):
        got = {r.id: r.embedding for r in store.embed(first, "text", 0, embed).collect()}
    want = {r.id: r.embedding for r in embed(first, "text").collect()}
    assert got == want and store.encoded(0) == 3
    assert {r.id: r.embedding for r in store.embed(second, "text", 1, embed).collect()} == {r.id: r.embedding for r in embed(second, "text").collect()}
    assert store.encoded(1) == 1
    store.embed(second.union(first), "text", 2, embed).count()
    assert store.encoded(2) == 0  # a second build of unchanged texts
    assert EmbeddingStore(spark, store.path, "m2", 4).embed(second, "text", 3, embed).count() == 3 and store.encoded(3) == 2  # another model shares nothing


def queue(root, bodies, files, urls):
    """A plain queue."""
    seen, found, left = [], [], [root]
    while left and len(seen) < files and len(found) < urls:
        url = left.pop(0)
        if url in seen:
            continue
        seen.append(url)
        e = sitemap_entries(bodies.get(url))
        left += e["files"]
        for page in e["pages"]:
            if page not in found and len(found) < urls:
                found.append(page)
    return found


def test_sitemap_indexes_in_bounds(spark):
    rng = random.Random(4)
    bodies = {}
    for site in range(6):
        names = [f"s{site}/{i}" for i in range(30)]
        for i, n in enumerate(names):
            if i < 6:
                inner = "".join(f"<sitemap><loc> {rng.choice(names)} </loc></sitemap>" for _ in range(rng.randrange(1, 9)))
                bodies[n] = f'<?xml version="1.0"?><sitemapindex xmlns="http://x">{inner}</sitemapindex>'
            else:
                inner = "".join(f"<url><loc>p{site}/{rng.randrange(60)}&amp;</loc><image:image xmlns:image='i'><image:loc>no</image:loc></image:image></url>" for _ in range(rng.randrange(0, 12)))
                bodies[n] = f"<urlset>{inner}</urlset>"
    bodies |= {"s1/7": "<urlset><url>", "s2/0": "<html/>", "s3/1": None}
    roots = spark.createDataFrame([(s, f"s{s}/0") for s in range(6)] + [(9, "gone"), (10, None)], "site long, url string")
    frame = spark.createDataFrame(list(bodies.items()), "url string, body string")
    for files, urls in ((20, 20_000), (7, 20_000), (20, 11), (1, 5)):
        got = {}
        for r in sitemap_urls(roots, frame, files, urls).orderBy("site", "place").collect():
            got.setdefault(r.site, []).append(r.url)
        assert got == {s: q for s in range(6) if (q := queue(f"s{s}/0", bodies, files, urls))}
    assert sitemap_urls(roots.limit(0), frame).count() == 0


def test_mentions_in_blocks(spark):
    rng = random.Random(5)
    names = [("product", "".join(rng.choice("abAB ") for _ in range(rng.randrange(1, 5)))) for _ in range(60)] + [("service", "Ab"), ("product", " "), ("service", None), ("product", "Über")]
    texts = [(i, "".join(rng.choice("abAB ÜBER") for _ in range(rng.randrange(0, 40)))) for i in range(80)] + [(90, None), (91, "eine über-lange Liste"), (92, "")]
    known = spark.createDataFrame(names, "type string, name string")
    said = spark.createDataFrame(texts, "id long, text string")
    want = {(i, f"{k}_mention", n) for i, t in texts for k, n in names if n and n.strip(" ") and n.lower() in (t or "").lower()}
    for block in (C.BLOCK_BYTES, 900):
        got = C.known_mentions(said, known, ["id"], block=block).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert C.known_mentions(said, known.limit(0), ["id"]).count() == 0


def test_memory_and_topics_of_long_conversations(spark):
    rng = random.Random(6)
    said = [(1, i, rng.choice(["user", "assistant"]), " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 40]))), rng.choice([*C.INTENTS, "unknown"])) for i in range(3000)]
    said += [(2, 0, "x" * 900, "short", "faq"), (3, 0, "user", "y" * 500, "faq"), (3, 1, "z" * 795, "", "complaint"), (4, 0, "user", None, "faq")]
    frame = spark.createDataFrame(said, "conv_id long, turn long, role string, text string, intent string")
    want, topics = {}, {}
    for conv, turn, role, text, intent in said:
        if text is not None:
            kept = want.setdefault(conv, [])
            line = re.sub(r"\s+", " ", text)[:120]
            kept.append(f"{role.capitalize()} said: {re.sub('[.!?]', '', line)}.")
            while len(" ".join(kept)) > 800 and len(kept) > 1:
                kept.pop(0)
            if len(kept[0]) > 800:
                kept[0] = kept[0][-800:]
        past = topics.setdefault(conv, [])
        if role == "user" and intent in C.TOPICS:
            past[:] = [intent, *[t for t in past if t != intent]]
        topics[conv, turn] = past[:5]
    assert {r.conv_id: r.memory for r in C.rolling_memory(frame).collect()} == {c: " ".join(k) for c, k in want.items()} | {4: ""}
    assert {(r.conv_id, r.turn): r.recent_topics for r in C.topics(frame).collect()} == {k: v for k, v in topics.items() if isinstance(k, tuple)}


def test_index_of_the_test_vectors(spark):
    v = table(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id) for r in R.knn(q, v, 10).collect()}
    assert len(exact & {(r.query_id, r.vec_id) for r in R.ann(q, v, 10).collect()}) / len(exact) >= 0.9
    pairs = rows(R.similar_pairs(v, 0.4).select("a", "b"))
    assert len(pairs & rows(R.similar_pairs(v, 0.4, recall=0.95).select("a", "b"))) >= 0.9 * len(pairs) and np.isfinite(len(SF))


def test_terms_are_counted_where_their_document_is():
    """A row for each term of a document; a document without terms (or without a text) keeps one, and one row of each is the first."""
    import pyarrow as pa

    from quarrykit.operators.postings import _counted

    tokens = [["b", "a", "b"], None, [], ["a"]]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 5], pa.int64()), pa.array(tokens, pa.list_(pa.string()))], ["doc_id", "tokens"])
    rows = [tuple(r.values()) for part in _counted(iter([batch, batch.slice(3), batch.slice(1, 2), batch.slice(0, 0)])) for r in part.to_pylist()]
    whole, five, bare = rows[:5], rows[5:6], rows[6:]
    assert {r[:4] for r in whole} == {(7, 3, "b", 2), (7, 3, "a", 1), (5, 1, "a", 1), (8, None, None, 0), (9, 0, None, 0)}
    assert sorted(r[0] for r in whole if r[4]) == [5, 7, 8, 9] and five == [(5, 1, "a", 1, True)] and bare == [(8, None, None, 0, True), (9, 0, None, 0, True)]
