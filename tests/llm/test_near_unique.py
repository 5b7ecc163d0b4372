"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

import random

import corpus_pipeline
from quarrykit.llm import simhash_dedup
from tests.llm.test_operators import SCHEMA, SF, empty, make, prose


def test_similar_texts_of_every_size_fall_together(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(60, 400)) for _ in range(20)]
    common = prose(rng, 12)
    texts += [common + " " + prose(rng, 60) for _ in range(10)]
    for i in range(20):
        w = texts[i].split()
        n = max(1, int(len(w) * (0.004 + 0.0022 * i)))  # similarities on both sides of 0.8
        for at in rng.sample(range(len(w)), n):
            w[at] = "changed"
        texts += [" ".join(w), texts[i].upper()]
    texts += [None, "", "one two", "One two", prose(rng, 8) + " " + "again and " * 40]
    texts += [" ".join(texts[-1].split()[:40])]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    fps = [simhash_dedup.fingerprint((t or "").encode(), 5) for t in texts]
    label = list(range(len(texts)))
    similar, beyond = 0, 0
    links = []
    for j in range(len(texts)):
        for i in range(j):
            close = 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
            apart = (fps[i] ^ fps[j]).bit_count() > 3
            similar, beyond = similar + close, beyond + (close and apart)
            if close or not apart:
                links.append((i, j))
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert beyond >= 5 and len(set(label)) > 30 and similar < 100
    docs = make(spark, texts)
    kept = corpus_pipeline.near_unique(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    groups = simhash_dedup.near_groups(docs, 5, least=0.8).collect()
    assert {r.doc_id: r.component_id for r in groups} == dict(enumerate(label))
    nameless = spark.createDataFrame([(None, texts[0], None, None, None, None, None, None, None, None)], SCHEMA)
    assert corpus_pipeline.near_unique(spark, docs.unionByName(nameless), SF).where("doc_id IS NULL").count() == 1
    assert corpus_pipeline.near_unique(spark, empty(spark), SF).count() == 0
