"""Queries over text cleaning, predicates, hashing and language rules, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table
from .inputs import derive, sql_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SP = T.SPACES


def put(template: str, x: str) -> str:
    return template.replace("@@", x)


def trim(x: str) -> str:
    return put(f"regexp_replace(@@, '^{SP}+|{SP}+$', '', 'g')", x)


def words_in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def on(name: str, source: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], where: tuple[str, str] | None = None, key: str = "doc_id") -> None:
    """Register a projection of a derived input."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = derive(spark, sf_dir, source)
        rows = rows.where(where[0]) if where else rows
        return rows.select(*key.split(", "), *[c.alias(n) for n, c in columns().items()])

    QUERIES[name] = run
    picked = ", ".join(f"{e} AS {n}" for n, e in sql.items())
    ORACLE[name] = f"SELECT {key}, {picked} FROM {sql_of(source)} d" + (f" WHERE {where[1]}" if where else "")


_ws = trim(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(@@, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
_strip = f"regexp_replace(@@, '{T.CONTROLS}', '', 'g')"
_nums = "translate(@@, '０１２３４５６７８９．，', '0123456789.,')"
_punct = "replace(translate(@@, '‘’‚‛“”„‟–—', '''''''''\"\"\"\"--'), '…', '...')"
for _mark in "!?,;:":
    _punct = f"regexp_replace({_punct}, '[{_mark}]{{2,}}', '{_mark}', 'g')"
_punct = rf"regexp_replace({_punct}, '\.{{4,}}', '...', 'g')"
_urls = "@@"
for _name in T.TRACKING_PARAMS:
    _urls = rf"""regexp_replace({_urls}, '(https?://[^\s)"''<>]*?[?&]){_name}=[^&#\s)"''<>]*&?', '\1', 'g')"""
_urls = rf"""regexp_replace({_urls}, '(https?://[^\s)"''<>]*?)[?&]+([\s)"''<>#]|$)', '\1\2', 'g')"""
_dates = "@@"
for _n, _m in enumerate(T.MONTHS, 1):
    _dates = rf"regexp_replace({_dates}, '(?i)\b(?:{_m})\s+(\d\d),?\s+(\d{{4}})\b', '\2-{_n:02d}-\1', 'g')"
    _dates = rf"regexp_replace({_dates}, '(?i)\b(?:{_m})\s+(\d),?\s+(\d{{4}})\b', '\2-{_n:02d}-0\1', 'g')"
    _dates = rf"regexp_replace({_dates}, '(?i)\b(\d\d)\s+(?:{_m}),?\s+(\d{{4}})\b', '\2-{_n:02d}-\1', 'g')"
    _dates = rf"regexp_replace({_dates}, '(?i)\b(\d)\s+(?:{_m}),?\s+(\d{{4}})\b', '\2-{_n:02d}-0\1', 'g')"

on("p1_strip_invalid_unicode", "decorated", lambda: {"cleaned": T.strip_invalid_unicode(F.col("text"))}, {"cleaned": put(_strip, "text")})
on("p2_nfc", "decorated", lambda: {"cleaned": T.nfc(F.col("text"))}, {"cleaned": "nfc_normalize(text)"})
on("p3_normalize_whitespace", "decorated", lambda: {"cleaned": T.normalize_whitespace(F.col("text"))}, {"cleaned": put(_ws, "text")})
on("p4_normalize_numbers", "decorated", lambda: {"cleaned": T.normalize_numbers(F.col("text"))}, {"cleaned": put(_nums, "text")})
on("p5_normalize_punctuation", "decorated", lambda: {"cleaned": T.normalize_punctuation(F.col("text"))}, {"cleaned": put(_punct, "text")})
on("p6_strip_tracking_params", "decorated", lambda: {"cleaned": T.strip_tracking_params(F.col("text"))}, {"cleaned": put(_urls, "text")})
on("p7_normalize_dates", "decorated", lambda: {"cleaned": T.normalize_dates(F.col("text"))}, {"cleaned": put(_dates, "text")})
on(
    "p8_normalize_text", "decorated", lambda: {"cleaned": T.normalize_text(F.col("text"))},
    {"cleaned": put(_dates, put(_urls, put(_punct, put(_nums, put(_ws, f"nfc_normalize({put(_strip, 'text')})")))))},
)
on("p9_sanitize_message", "chat", lambda: {"cleaned": T.sanitize_message(F.concat(F.lit(" \x01"), F.col("text"), F.lit("\t ")))}, {"cleaned": "left(" + trim(r"regexp_replace(' ' || chr(1) || text || chr(9) || ' ', '[\x00-\x08\x0B-\x1F\x7F]', '', 'g')") + ", 4000)"}, key="conv_id, turn")
on("p10_escape_html", "decorated", lambda: {"escaped": T.escape_html(F.concat(F.lit("<b>'&\""), F.col("text")))}, {"escaped": "replace(replace(replace(replace(replace('<b>''&\"' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"})

def _iss() -> Column:
    return T.unit_issues(F.col("text"), F.col("source"))


_iss_sql = rf"""list_filter([
  CASE WHEN coalesce(length({trim('source')}), 0) = 0 THEN 'missing_source' END,
  CASE WHEN length({trim('text')}) = 0 THEN 'empty_content' END,
  CASE WHEN (length(text) - length(replace(text, '�', ''))) / greatest(length(text), 1) > 0.05 THEN 'encoding_broken' END,
  CASE WHEN length({trim('text')}) BETWEEN 1 AND 9 THEN 'content_too_short' END,
  CASE WHEN len(list_filter(regexp_split_to_array(lower(text), '{SP}+'), lambda x: x <> '')) >= 20
    AND len(list_distinct(list_filter(regexp_split_to_array(lower(text), '{SP}+'), lambda x: x <> ''))) / len(list_filter(regexp_split_to_array(lower(text), '{SP}+'), lambda x: x <> '')) < 0.15 THEN 'repetitive_content' END
], lambda x: x IS NOT NULL)"""
on("p11_validate_units", "decorated", lambda: {"issues": F.array_join(_iss(), ","), "valid": ~F.arrays_overlap(_iss(), F.array(*map(F.lit, T.ERRORS)))},
   {"issues": f"array_to_string({_iss_sql}, ',')", "valid": f"NOT list_has_any({_iss_sql}, ['missing_source', 'empty_content', 'encoding_broken'])"})
# The issues of a text are found once for both columns.
QUERIES["p11_validate_units"] = lambda s, d: derive(s, d, "decorated").select("doc_id", _iss().alias("found")).select("doc_id", F.array_join("found", ",").alias("issues"), (~F.arrays_overlap("found", F.array(*map(F.lit, T.ERRORS)))).alias("valid"))


def search_candidates(chunks: DataFrame, category: str | None = None, language: str | None = None, category_col: str = "source") -> DataFrame:
    """Chunks that no earlier chunk duplicates, with optional equality filters (pushed to the scan)."""
    rows = chunks
    if category is not None:
        rows = rows.where(F.col(category_col) == category)
    if language is not None:
        rows = rows.where(F.col("lang") == language)
    first = rows.groupBy(T.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    return rows.join(first.select("doc_id"), "doc_id", "left_semi")


QUERIES["p12_search_candidates"] = lambda s, d: search_candidates(table(s, d, "documents"), language="en").select("doc_id", "source", "n_chars")
_norm = trim(f"regexp_replace(lower(text), '{SP}+', ' ', 'g')")
_hash = f"sha256({_norm})"
ORACLE["p12_search_candidates"] = f"SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY {_hash} ORDER BY doc_id) rn FROM documents WHERE lang = 'en') WHERE rn = 1"


def newest(df: DataFrame, limit: int, order: str, key: str, status: Column | None = None) -> DataFrame:
    return (df.where(status) if status is not None else df).orderBy(F.desc(order), F.desc(key)).limit(limit)


QUERIES["p13_newest"] = lambda s, d: newest(table(s, d, "events"), 50, "ts", "event_id", F.col("event_type") == "purchase").select("event_id", "user_id", "value")
ORACLE["p13_newest"] = "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50"

def _inj() -> Column:
    return T.matched_patterns(F.col("text"), T.INJECTION_PATTERNS)


_inj_sql = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(text, '{p}') THEN {k} END" if "(?!" not in p
    # RE2 has no lookahead: count what follows against what the assistant phrase covers
    else f"CASE WHEN len(regexp_extract_all(text, '(?i)act\\s+as\\s+')) > len(regexp_extract_all(text, '(?i)act\\s+as\\s+an?\\s+assistant\\b')) THEN {k} END"
    for k, p in enumerate(T.INJECTION_PATTERNS, 1)) + "], lambda x: x IS NOT NULL)"
on("p14_flag_prompt_injection", "decorated", lambda: {"suspicious": F.size(_inj()) > 0, "matched": F.array_join(_inj().cast("array<string>"), ",")},
   {"suspicious": f"len({_inj_sql}) > 0", "matched": f"array_to_string({_inj_sql}, ',')"})


def redact_columns(df: DataFrame, pattern: str = T.PRICE_KEYS) -> DataFrame:
    """``df`` without the columns (and without the struct fields, at any depth) whose names look like prices."""
    import re

    def inner(c: Column, kind) -> Column:
        from pyspark.sql import types as K

        if isinstance(kind, K.StructType):
            kept = [f for f in kind.fields if not re.search(pattern, f.name)]
            return F.when(c.isNotNull(), F.struct(*[inner(c[f.name], f.dataType).alias(f.name) for f in kept])) if kept else F.lit(None)
        if isinstance(kind, K.ArrayType) and isinstance(kind.elementType, K.StructType):
            return F.transform(c, lambda x: inner(x, kind.elementType))
        return c

    return df.select(*[inner(df[f.name], f.dataType).alias(f.name) for f in df.schema.fields if not re.search(pattern, f.name)])


def _redacted(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").withColumn("deal", F.struct("l_discount", "l_quantity", F.struct(F.col("l_extendedprice").alias("unit_price"), "l_tax").alias("money")))
    return redact_columns(lines).select("l_orderkey", "l_linenumber", F.col("deal.l_quantity").alias("quantity"), F.col("deal.money.l_tax").alias("tax"), F.to_json("deal").rlike("price").alias("leaks"))


QUERIES["p15_redact_pricing"] = _redacted
ORACLE["p15_redact_pricing"] = "SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_tax AS tax, false AS leaks FROM lineitem"


def encrypt(c: Column, key: Column) -> Column:
    """AES-GCM with a random initial vector: iv, cipher text and tag."""
    return F.base64(F.aes_encrypt(c, key, F.lit("GCM")))


def decrypt(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")


def _key() -> Column:
    return F.unhex(F.lit("00112233445566778899aabbccddeeff00112233445566778899aabbccddeeff"))


on("p16_encrypt_round_trip", "chat", lambda: {"plain": decrypt(encrypt(F.col("text"), _key()), _key())}, {"plain": "text"}, key="conv_id, turn")

QUERIES["p17_is_js_shell"] = lambda s, d: table(s, d, "pages").select("page_id", T.is_js_shell(F.col("html"), 900).alias("shell"))
ORACLE["p17_is_js_shell"] = rf"""
SELECT page_id, regexp_matches(html, '(?i)<script') AND length({trim(r"regexp_replace(regexp_replace(regexp_replace(b, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')")}) < 900 AS shell
FROM (SELECT *, CASE WHEN regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) = '' THEN html ELSE regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) END AS b FROM pages)"""

# Reserved IPv4 blocks (first address, prefix length).
RESERVED = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]


def unsafe_address(ip: Column) -> Column:
    """IPv4 in a reserved block, or IPv6 loopback, unspecified, link-local, unique-local or mapped IPv4 in such a block."""
    v4 = F.regexp_extract(F.lower(ip), r"^(?:::ffff:)?(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
    byte = lambda k: F.element_at(F.split(F.nullif(v4, F.lit("")), r"\."), k).cast("long")
    number = byte(1) * 16777216 + byte(2) * 65536 + byte(3) * 256 + byte(4)
    inside = F.lit(False)
    for first, bits in RESERVED:
        a, b, c, d = map(int, first.split("."))
        low = a << 24 | b << 16 | c << 8 | d
        inside = inside | number.between(low, low + (1 << 32 - bits) - 1)
    return F.coalesce(inside, F.lit(False)) | F.lower(ip).rlike(r"^(::1|::|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*)$")


def _ip() -> Column:
    n = F.col("event_id")
    plain = F.concat_ws(".", *[(n * k % m).cast("string") for k, m in ((7, 256), (31, 256), (11, 200), (3, 250))])
    return F.when(n % 50 == 0, "fe80::1").when(n % 50 == 1, F.concat(F.lit("::ffff:10.0.0."), (n % 250).cast("string"))).otherwise(plain)


QUERIES["p18_unsafe_address"] = lambda s, d: table(s, d, "events").select("event_id", unsafe_address(_ip()).alias("unsafe"))
ORACLE["p18_unsafe_address"] = """
SELECT event_id, CASE WHEN event_id % 50 IN (0, 1) THEN true ELSE a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254)
  OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND ((b = 0 AND c IN (0, 2)) OR (b = 88 AND c = 99) OR b = 168))
  OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100))) OR (a = 203 AND b = 0 AND c = 113) END AS unsafe
FROM (SELECT event_id, event_id * 7 % 256 AS a, event_id * 31 % 256 AS b, event_id * 11 % 200 AS c FROM events)"""


def stale_embeddings(chunks: DataFrame, model: str, version: str) -> DataFrame:
    return chunks.where(~(F.col("model").eqNullSafe(model) & F.col("version").eqNullSafe(version)))


QUERIES["p19_stale_embeddings"] = lambda s, d: stale_embeddings(
    table(s, d, "embeddings").select("vec_id", F.when(F.col("label") != 3, F.lit("m1")).alias("model"), F.when(F.col("vec_id") % 4 == 0, "v1").otherwise("v2").alias("version")), "m1", "v2"
)
ORACLE["p19_stale_embeddings"] = "SELECT vec_id, CASE WHEN label <> 3 THEN 'm1' END AS model, CASE WHEN vec_id % 4 = 0 THEN 'v1' ELSE 'v2' END AS version FROM embeddings WHERE label = 3 OR vec_id % 4 = 0"

on("a1_content_hash", "decorated", lambda: {"content_hash": T.content_hash(F.col("text"))}, {"content_hash": _hash})


def exact_duplicates(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per content: its hash, the smallest id and the number of rows. Only hashes and ids are shuffled."""
    return df.groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies"))


QUERIES["a2_exact_duplicates"] = lambda s, d: exact_duplicates(table(s, d, "documents"))
ORACLE["a2_exact_duplicates"] = f"SELECT {_hash} AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1"


def canonical_of(df: DataFrame, cluster: str, key: str = "doc_id") -> DataFrame:
    """The longest member of each cluster (ties: smallest id), by a map-side maximum."""
    best = F.max(F.struct(F.length("text").alias("n"), (-F.col(key)).alias("k"))).alias("best")
    return df.groupBy(cluster).agg(best).select(cluster, (-F.col("best.k")).alias("canonical_id"), F.col("best.n").alias("n_chars"))


QUERIES["a4_canonical_of"] = lambda s, d: canonical_of(table(s, d, "documents").withColumn("cluster", F.col("doc_id") % 40), "cluster")
ORACLE["a4_canonical_of"] = "SELECT doc_id % 40 AS cluster, doc_id AS canonical_id, length(text) AS n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 40 ORDER BY length(text) DESC, doc_id) = 1"


def seen_stats(items: DataFrame) -> DataFrame:
    """category, distinct items and repeats; blank contents are ignored."""
    rows = items.where(F.length(T.trim_spaces(F.col("content"))) > 0)
    per = rows.groupBy("category", T.content_hash(F.col("content")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("category").agg(F.count(F.lit(1)).alias("distinct_items"), F.sum(F.col("n") - 1).alias("repeats"))


def _seen(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    paragraphs = docs.select(F.lit("paragraph").alias("category"), F.explode(F.split("text", "\n")).alias("content"))
    pages = table(s, d, "pages").select(F.lit("page").alias("category"), F.col("html").alias("content"))
    return seen_stats(docs.select(F.lit("document").alias("category"), F.col("text").alias("content")).unionByName(paragraphs).unionByName(pages))


QUERIES["a6_seen_stats"] = _seen
_c = trim(f"regexp_replace(lower(content), '{SP}+', ' ', 'g')")
ORACLE["a6_seen_stats"] = f"""
SELECT category, count(DISTINCT {_c}) AS distinct_items, count(*) - count(DISTINCT {_c}) AS repeats FROM (
  SELECT 'document' AS category, text AS content FROM documents UNION ALL SELECT 'paragraph', unnest(string_split(text, chr(10))) FROM documents
  UNION ALL SELECT 'page', html FROM pages) WHERE length({trim('content')}) > 0 GROUP BY 1"""

_w = "regexp_extract_all(lower(text), '[a-z]+')"
_hl = f"len(list_filter({_w}, lambda w: w IN {words_in(T.HINGLISH)}))"
on("l1_looks_like_hinglish", "decorated", lambda: {"hinglish": T.looks_like_hinglish(F.col("text"))}, {"hinglish": f"{_hl} >= 2 AND {_hl} / greatest(len({_w}), 1) >= 0.08"})

# Frequent function words by language, used for language detection without a model.
MARKERS = {
    "en": ["the", "and", "of", "to", "in", "is", "with", "that", "for", "this", "was", "from"],
    "fr": ["le", "la", "les", "des", "et", "un", "une", "dans", "pour", "avec", "est", "qui"],
    "de": ["der", "die", "das", "und", "ist", "mit", "von", "zu", "den", "für", "nicht", "auf"],
    "es": ["el", "los", "las", "que", "con", "por", "una", "para", "se", "su", "como", "no"],
}


def _one_of(values: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(values)


def detect_language(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, language and hits: the language with most marker words (ties by code); no hit or under 10 characters: und."""
    hits = [F.size(F.filter(F.col("w"), _one_of(m))) for m in MARKERS.values()]
    scored = docs.select(key, F.col("text"), F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(\p{L}+)"), 1).alias("w")).select(key, F.col("text"), F.array_sort(F.array(*[F.struct((-h).alias("n"), F.lit(k).alias("code")) for k, h in zip(MARKERS, hits, strict=True)])).alias("s"))
    top = F.col("s")[0]
    known = (top["n"] < 0) & (F.length(F.col("text")) >= 10)
    return scored.select(key, F.when(known, top["code"]).otherwise("und").alias("language"), F.when(known, -top["n"]).otherwise(0).alias("hits"))


QUERIES["l2_detect_language"] = lambda s, d: detect_language(table(s, d, "documents"))
_lh = {k: rf"len(list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda w: w IN {words_in(m)}))" for k, m in MARKERS.items()}
ORACLE["l2_detect_language"] = f"""
SELECT doc_id, CASE WHEN n > 0 AND length(text) >= 10 THEN code ELSE 'und' END AS language, CASE WHEN length(text) >= 10 THEN n ELSE 0 END AS hits FROM (
  SELECT doc_id, text, code, n FROM (SELECT doc_id, text, unnest(['en', 'fr', 'de', 'es']) AS code, unnest([{', '.join(_lh.values())}]) AS n FROM documents)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) = 1)"""


def chunk_language(docs: DataFrame) -> DataFrame:
    """Hinglish first, then the detector; texts poor in letters or without a verdict count as English."""
    found = detect_language(docs)
    rows = docs.select("doc_id", T.looks_like_hinglish(F.col("text")).alias("h"), (F.regexp_count(F.col("text"), F.lit(r"\p{L}")) / F.greatest(F.length(F.regexp_replace(F.col("text"), r"\s", "")), F.lit(1))).alias("density"), F.length(F.col("text")).alias("n"))
    names = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("language")]
    language = F.when(F.col("h"), "Hinglish").otherwise(F.coalesce(name, F.lit("English")))
    confidence = F.when((F.col("h") | name.isNotNull()) & (F.col("n") >= 100), "high").otherwise("low")
    return rows.join(found, "doc_id").select("doc_id", language.alias("language"), confidence.alias("confidence"))


QUERIES["l3_chunk_language"] = lambda s, d: chunk_language(derive(s, d, "decorated"))
ORACLE["l3_chunk_language"] = f"""
SELECT doc_id, CASE WHEN h THEN 'Hinglish' WHEN n = 0 OR length(text) < 10 THEN 'English' ELSE map {{'en': 'English', 'fr': 'French', 'de': 'German', 'es': 'Spanish'}}[code] END AS language,
  CASE WHEN length(text) >= 100 AND (h OR n > 0) THEN 'high' ELSE 'low' END AS confidence FROM (
  SELECT doc_id, text, code, n, {_hl} >= 2 AND {_hl} / greatest(len({_w}), 1) >= 0.08 AS h
  FROM (SELECT doc_id, text, unnest(['en', 'fr', 'de', 'es']) AS code, unnest([{', '.join(_lh.values())}]) AS n FROM {sql_of('decorated')} d)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) = 1)"""

on("t1_tokenize", "decorated", lambda: {"tokens": F.array_join(T.tokenize(F.col("text")), " ")},
   {"tokens": rf"array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda w: w NOT IN {words_in(T.STOPWORDS)}), ' ')"})
on("c3_looks_like_code", "decorated", lambda: {"code": T.looks_like_code(F.concat(F.when(F.col("doc_id") % 3 == 0, "def f(x):\n  return x;\n").otherwise(""), F.col("text")))},
   {"code": r"""(SELECT len(l) >= 2 AND len(list_filter(l, lambda x: regexp_matches(x, '[{};]\s*$|^\s*(def|class|import|function|const|let|var|return|if|for|while)\b|=>|</?[a-z]+>'))) / greatest(len(l), 1) >= 0.5
   FROM (SELECT list_filter(string_split(CASE WHEN d.doc_id % 3 = 0 THEN 'def f(x):' || chr(10) || '  return x;' || chr(10) ELSE '' END || d.text, chr(10)), lambda x: length(trim(x)) > 0) AS l))"""})  # fmt: skip
QUERIES["c4_split_sentences"] = lambda s, d: table(s, d, "documents").select("doc_id", F.size(T.split_sentences(F.col("text"))).alias("n_sentences"))
ORACLE["c4_split_sentences"] = rf"""
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(2))) END AS n_sentences
FROM (SELECT doc_id, regexp_replace(regexp_replace({trim('text')}, '([.!?])\s+', '\1' || chr(2), 'g'), '(^|[^\p{{L}}\p{{N}}_])([A-Z]|Mr|Ms|Dr|Sr|Jr|St|vs|No|Mrs|etc|Inc|Ltd|Prof|e\.g|i\.e)\.\x02', '\1\2. ', 'g') AS t FROM documents)"""
