"""Queries over the knowledge graph, embeddings, whole builds, lookups and the remaining technology categories."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat as C
from ..operators import chunks as K
from ..operators import retrieval as R
from ..operators import rules
from ..operators import snapshots as S
from ..session import durable, scratch, table
from ..sources.embeddings import EmbeddingStore
from .chat import _INTENT
from .inputs import derive, sql_of
from .pages import PAGES, _structured, content_units, enriched
from .pages import _cat as _categories
from .pages import _parsed as parsed

QUERIES, ORACLE = {}, {}

# Knowledge graph
def link_entities(sources: DataFrame, entities: DataFrame, k: int = 3, least: float = 0.6) -> DataFrame:
    """source_id, entity_id, score, rank. sources: id, text, embedding; entities: id, name, embedding.

    Mentions come from a join on words (the name's first word, then the whole name with boundaries), similar pairs
    from blocked products of which each source keeps its k best.
    """
    word = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)
    first = entities.where(F.length(F.trim("name")) >= 3).select(F.col("id").alias("entity_id"), F.lower(F.trim("name")).alias("name"), word(F.col("name"))[0].alias("w"))
    words = sources.select(F.col("id").alias("source_id"), F.explode(F.array_distinct(word(F.col("text")))).alias("w"))
    pairs = words.join(first, "w").join(sources.select(F.col("id").alias("source_id"), F.lower("text").alias("body")), "source_id")
    padded = F.concat(F.lit(" "), F.regexp_replace("body", r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    said = pairs.where(padded.contains(F.concat(F.lit(" "), F.regexp_replace("name", r"[^\p{L}\p{N}]+", " "), F.lit(" ")))).select("source_id", "entity_id", F.lit(True).alias("mentioned"))
    vectors = lambda df, key: df.where("embedding IS NOT NULL").select(F.col("id").alias(key), "embedding")
    near = R.knn(vectors(sources, "query_id"), vectors(entities, "vec_id"), k, least).select(F.col("query_id").alias("source_id"), F.col("vec_id").alias("entity_id"), "score")
    # A mention raises a score and never lowers it, so whatever ranks among the k best is mentioned or among the k nearest.
    named = said.join(vectors(sources, "source_id").withColumnRenamed("embedding", "x"), "source_id", "left").join(vectors(entities, "entity_id").withColumnRenamed("embedding", "y"), "entity_id", "left")
    named = named.select("source_id", "entity_id", "mentioned", F.round(R.dot(F.col("x"), F.col("y")), 6).alias("own"))
    both = named.join(near, ["source_id", "entity_id"], "full_outer").withColumn("score", F.coalesce("own", "score"))
    score = F.least(F.lit(1.0), F.when(F.col("mentioned"), F.greatest(F.lit(0.85), F.coalesce("score", F.lit(0.0)))).otherwise(F.col("score")))
    return R.top(both.select("source_id", "entity_id", F.round(score, 6).alias("score")), "source_id", [F.desc("score"), F.asc("entity_id")], k)


def _link_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(s, d, "embeddings")
    sources = v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.concat(F.lit("We use item"), F.col("vec_id") % 31, F.lit(" and more")).alias("text"), "embedding")
    return sources, v.where("vec_id % 2 = 1").select(F.col("vec_id").alias("id"), F.concat(F.lit("Item"), "vec_id").alias("name"), "embedding")


QUERIES["j7_link_entities"] = lambda s, d: link_entities(*_link_inputs(s, d), least=0.3)
_dot = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_links = f"""(SELECT a.vec_id AS source_id, b.vec_id AS entity_id, CASE WHEN a.vec_id % 31 = b.vec_id THEN greatest(0.85, CASE WHEN {_dot} >= 0.3 THEN {_dot} ELSE 0 END) ELSE {_dot} END AS score FROM embeddings a, embeddings b
  WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND (a.vec_id % 31 = b.vec_id OR {_dot} >= 0.3))"""
ORACLE["j7_link_entities"] = f"SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, entity_id) AS rank FROM {_links} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, entity_id) <= 3"


# Embeddings
DIM = 64


def lexical_vector(text: str | None, dim: int = DIM) -> list[float]:
    """Hashed word counts of unit norm: a stand-in where no model is available."""
    v = np.zeros(dim)
    for w in (text or "").lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def lexical_encoder() -> Callable[[pd.Series], list[list[float]]]:
    """Makes the stand-in encoder (a model's maker loads it here)."""
    return lambda texts: [lexical_vector(t) for t in texts]


def embed(df: DataFrame, column: str = "text", make: Callable[[], Callable[[pd.Series], list[list[float]]]] = lexical_encoder) -> DataFrame:
    """``df`` with ``embedding``: one vector a text. ``make`` is called once a task and returns a function of a series of texts, so a
    model is loaded once and meets its texts batch by batch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for texts in batches:
            yield pd.Series(encode(texts), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("embedding", F.pandas_udf(run, "array<double>")(F.col(column)))


def _series(f):
    def run(s: pd.Series) -> pd.Series:
        return f(s)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return run


def letter_encoder() -> Callable[[pd.Series], list[list[float]]]:
    """An encoder plugged in: the shares of five vowels."""
    return lambda texts: [[(t or "").count(c) / max(1, len(t or "")) for c in "aeiou"] for t in texts]


_letters = lambda i: F.round(F.get("embedding", F.lit(i)) * F.greatest(F.length("text"), F.lit(1))).cast("long")
QUERIES["x1_plugged_encoder"] = lambda s, d: embed(table(s, d, "documents").select("doc_id", "text"), make=letter_encoder).select("doc_id", F.size("embedding").alias("dim"), *[_letters(i).alias(c) for i, c in enumerate("aeiou")])
ORACLE["x1_plugged_encoder"] = "SELECT doc_id, 5 AS dim, " + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::BIGINT AS {c}" for c in "aeiou") + " FROM documents"
QUERIES["k1_embed"] = lambda s, d: embed(table(s, d, "documents").select("doc_id", "text")).select("doc_id", F.size("embedding").alias("dim"), F.round(R.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Two builds on one store: the documents as they were, then as they are."""
    store, rows = EmbeddingStore(s, scratch(s, "embeddings"), "lexical-1", 8), []
    for batch, name in enumerate(("doc_prev", "doc_cur")):
        found = store.embed(derive(s, d, name).select("doc_id", "text"), "text", batch, embed)
        rows.append(found.agg(F.lit(batch).alias("build"), F.count(F.lit(1)).alias("texts"), F.lit(store.encoded(batch)).cast("long").alias("encoded"), F.round(F.sum(R.dot(F.col("embedding"), F.col("embedding"))), 3).alias("norms")))
    return rows[0].unionByName(rows[1])


QUERIES["k1_stored_embeddings"] = _stored
ORACLE["k1_stored_embeddings"] = f"""SELECT 0 AS build, count(*) AS texts, count(DISTINCT text) AS encoded, round(count_if(text <> '')::DOUBLE, 3) AS norms FROM {sql_of('doc_prev')}
UNION ALL SELECT 1, count(*), count(DISTINCT text) FILTER (WHERE text NOT IN (SELECT text FROM {sql_of('doc_prev')})), round(count_if(text <> '')::DOUBLE, 3) FROM {sql_of('doc_cur')}"""


def generate_answers(prompts: DataFrame, fn) -> DataFrame:
    """conv_id, turn, answer, unmatched: refused rows bypass ``fn`` (a function of a prompt's JSON) and get the refusal text."""
    answer = F.when(F.col("answered"), F.pandas_udf(_series(lambda s: s.map(fn)), "string")(F.col("prompt"))).otherwise(C.refusal_message(F.col("intent")))
    return prompts.withColumn("answer", answer).withColumn("unmatched", C.grounding_audit(F.col("answer"), F.col("prompt")))


def _extractive(prompt: str | None) -> str:
    return "From the evidence: " + (prompt or "")[-60:]


def _answers(s: SparkSession, d: str) -> DataFrame:
    rows = C.with_intent(derive(s, d, "chat")).where("role = 'user'")
    evidence = rows.select("conv_id", "turn", F.array("text").alias("sources"))
    prompts = C.build_prompts(derive(s, d, "chat"), evidence).select("conv_id", "turn", F.to_json("prompt").alias("prompt"))
    return generate_answers(prompts.join(rows.select("conv_id", "turn", "intent"), ["conv_id", "turn"]).withColumn("answered", F.col("conv_id") % 3 != 0), _extractive).select("conv_id", "turn", F.sha2("answer", 256).alias("answer_sha256"), F.size("unmatched").alias("unmatched"))


QUERIES["x2_generate_answers"] = _answers


# Lookups by intent, category, policy type and endpoint.
QUICK = {"greeting": ["view_products", "view_services", "contact_support"], "product_inquiry": ["view_pricing", "talk_to_human"], "service_inquiry": ["view_pricing", "talk_to_human"], "pricing_inquiry": ["view_products", "talk_to_human"], "order_status": ["track_order", "contact_support"], "complaint": ["talk_to_human", "contact_support"], "human_request": ["talk_to_human"], "policy_inquiry": ["view_faqs", "contact_support"]}
KNOWLEDGE = {"product_inquiry": "Products", "service_inquiry": "Services", "pricing_inquiry": "Products", "policy_inquiry": "Policies", "contact_inquiry": "Contact"}
TOOLS = {"order_status": "getOrderStatus", "appointment_inquiry": "getAppointments", "inventory_inquiry": "getInventory", "product_inquiry": "getProducts", "service_inquiry": "getServices"}
SCOPES = {"Products": "PRODUCTS", "Services": "SERVICES", "FAQs": "FAQS", "Blogs": "BLOGS", "Policies": "SUPPORT_ARTICLES", "Pricing": "PRICING", "Shipping": "SHIPPING"}
_map = lambda m: F.create_map(*[F.lit(x) for k, v in m.items() for x in (k, ",".join(v) if isinstance(v, list) else v)])
_case = lambda c, m, e="NULL": f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{','.join(v) if isinstance(v, list) else v}'" for k, v in m.items()) + f" ELSE {e} END"
QUERIES["l18_suggestions"] = lambda s, d: C.with_intent(derive(s, d, "chat")).where("role = 'user'").select("conv_id", "turn", F.coalesce(_map(QUICK)[F.col("intent")], F.lit("view_faqs,contact_support")).alias("actions"), _map(KNOWLEDGE)[F.col("intent")].alias("category"), _map(TOOLS)[F.col("intent")].alias("tool"))
ORACLE["l18_suggestions"] = f"SELECT conv_id, turn, {_case('intent', QUICK, chr(39) + 'view_faqs,contact_support' + chr(39))} AS actions, {_case('intent', KNOWLEDGE)} AS category, {_case('intent', TOOLS)} AS tool FROM {_INTENT} WHERE role = 'user'"
QUERIES["l27_scope_of"] = lambda s, d: rules.categorize(derive(s, d, "chunks")).select("chunk_id", _map(SCOPES)[F.col("category")].alias("scope"))
ORACLE["l27_scope_of"] = f"SELECT chunk_id, {_case('category', SCOPES)} AS scope FROM {_categories}"

# Phrases.
BENEFIT = r"(?i)\b(helps? you|so (?:that )?you can|which means|allow(?:s|ing) you to|enjoy|experience|save (?:time|money)|no more|without the hassle|designed to make)\b"
DEPENDENCY = r"(?i)\b(requires?|depends? on|needs?|must (?:already )?have|prerequisite|before you can|in conjunction with|only available (?:with|to)|first requires?)\b"


def phrases(c: Column, pattern: str, most: int = 5) -> Column:
    found = F.slice(F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: (F.length(s) >= 15) & s.rlike(pattern)), 1, most)
    return F.when(F.size(found) > 0, found)


_desc = lambda: F.concat(F.lit("It helps you save time "), F.col("doc_id"), F.lit(". It requires the base kit. "), "text", F.lit(" You can enjoy it. Everything else depends on you."))
_descq = "'It helps you save time ' || doc_id || '. It requires the base kit. ' || text || ' You can enjoy it. Everything else depends on you.'"
QUERIES["l10_benefits"] = lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(phrases(_desc(), BENEFIT), "|").alias("benefits"), F.array_join(phrases(_desc(), DEPENDENCY), "|").alias("dependencies"))
_ph = lambda p: f"array_to_string(list_filter(list_transform(string_split(regexp_replace({_descq}, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda x: trim(x)), lambda x: length(x) >= 15 AND regexp_matches(x, '{p}'))[1:5], '|')"
ORACLE["l10_benefits"] = f"SELECT doc_id, {_ph(BENEFIT)} AS benefits, {_ph(DEPENDENCY)} AS dependencies FROM documents"
DEPARTMENTS = [("Sales", r"(?i)\bsales\b"), ("Support", r"(?i)\b(support|help\s*desk)\b"), ("Human Resources", r"(?i)\b(hr|human\s*resources)\b"), ("Careers", r"(?i)\bcareers?\b"), ("Billing", r"(?i)\bbilling\b"), ("Customer Service", r"(?i)\bcustomer\s*service\b")]
CONTACT_TITLES = ["Sales desk", "Support - Berlin Office", "Contact us: Madrid", "Careers", "Get a quote", "About"]


def contact(title: Column) -> Column:
    kind = F.when(title.rlike(r"(?i)\b(support|help\s*desk|customer\s*service|technical\s*support|helpline)\b"), "SUPPORT").when(title.rlike(r"(?i)\b(sales|buy\s*now|purchase\s*inquiry|get\s*a\s*quote|request\s*a\s*quote)\b"), "SALES").otherwise("GENERAL")
    department = None
    for name, p in DEPARTMENTS:
        department = F.when(title.rlike(p), name) if department is None else department.when(title.rlike(p), name)
    office = F.regexp_extract(title, r"\b([A-Z][a-zA-Z]+)\s+(?:Office|Branch|Location)\b", 1)
    named = F.regexp_extract(title, r"Contact(?:\s*Us|\s*us)?\s*[-–:]\s*([A-Z][a-zA-Z]+)\b", 1)
    return F.struct(kind.alias("kind"), department.alias("department"), F.coalesce(F.nullif(office, F.lit("")), F.nullif(named, F.lit(""))).alias("branch"))


QUERIES["l7_extract_contact"] = lambda s, d: table(s, d, "pages").select("page_id", contact(F.element_at(F.array(*map(F.lit, CONTACT_TITLES)), (F.col("page_id") % 6 + 1).cast("int"))).alias("c")).select("page_id", "c.kind", "c.department", "c.branch")
ORACLE["l7_extract_contact"] = "SELECT page_id, ['SALES', 'SUPPORT', 'GENERAL', 'GENERAL', 'SALES', 'GENERAL'][page_id % 6 + 1] AS kind, ['Sales', 'Support', NULL, 'Careers', NULL, NULL][page_id % 6 + 1] AS department, [NULL, 'Berlin', 'Madrid', NULL, NULL, NULL][page_id % 6 + 1] AS branch FROM pages"

# Chunk parts as their own queries
QUERIES["c2_split_code_fences"] = lambda s, d: K.chunk_texts(_structured(s, d)).where("kind = 'code'").select("doc_id", "content")
ORACLE["c2_split_code_fences"] = "SELECT doc_id, 'code' AS content FROM documents WHERE doc_id % 3 = 0"
QUERIES["c5_pack_sentences"] = lambda s, d: K.chunk_texts(table(s, d, "documents").select("doc_id", "text"), size=400, overlap=60).where("kind = 'paragraph'").select("doc_id", "chunk_index", F.sha2("content", 256).alias("content_sha256"))
QUERIES["c6_chunk_blocks"] = lambda s, d: K.chunk_texts(_structured(s, d)).select("doc_id", "chunk_index", "kind", "title", "section", F.sha2("content", 256).alias("content_sha256"))


def _pictures(s: SparkSession, d: str) -> DataFrame:
    said = lambda t, n: F.struct(F.lit(t).alias("text"), F.lit(n).alias("confidence"))
    return table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.array(said("Sale today", 91.5), said("  ", 10.0))).otherwise(F.array().cast("array<struct<text:string,confidence:double>>")).alias("ocr"))


QUERIES["c9_content_units"] = lambda s, d: content_units(parsed(s, d), table(s, d, "documents"), _pictures(s, d)).where("kind <> 'page'").select("unit_id", "kind", "title", "ocr", F.length("content").alias("n_chars"))
ORACLE["c9_content_units"] = """SELECT 'doc:' || doc_id AS unit_id, 'document' AS kind, NULL::VARCHAR AS title, NULL::DOUBLE AS ocr, length(text) AS n_chars FROM documents
UNION ALL SELECT 'faq:' || page_id || ':0', 'faq', 'Why?', NULL, length('Q: Why?' || chr(10) || 'A: Because.') FROM pages WHERE page_id % 6 = 4
UNION ALL SELECT 'picture:' || page_id || ':0', 'picture', replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), 91.5, 10 FROM pages WHERE page_id % 3 = 0"""


def page_languages(docs: DataFrame) -> DataFrame:
    """doc_id, languages of lines of 40 characters or more, multilingual."""
    from .text import detect_language

    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).where(F.length("text") >= 40).select(F.struct("doc_id", "i").alias("key"), "text")
    found = detect_language(lines, "key").where("language <> 'und'")
    return found.groupBy("key.doc_id").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages")).withColumn("multilingual", F.col("languages").contains(","))


QUERIES["h19_page_languages"] = lambda s, d: page_languages(table(s, d, "documents"))
