"""Queries over connector health, requests and streams, with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import health as H
from ..operators.folds import Breaker, Repeats, Streak, TokenBucket
from ..session import scratch, table
from ..sources.buckets import Live
from ..streaming import events as E
from .inputs import INPUTS, derive, sql_of
from .text import SP, trim

QUERIES, ORACLE = {}, {}
HEALTH, REQ = sql_of("health"), sql_of("requests")
_le = ", ".join(f"count_if(seconds <= {b})::BIGINT AS le_{str(b).replace('.', '_')}" for b in H.BUCKETS)
_health = "SELECT connector_id, floor(100 * (0.7 * avg(availability) + 0.3 * greatest(0, 1 - coalesce(avg(latency_ms), 5000) / 5000)) + 0.5)::INT AS score FROM (SELECT *, row_number() OVER (PARTITION BY connector_id ORDER BY ts DESC, event_id DESC) AS rn FROM " + HEALTH + ") WHERE rn <= 20 GROUP BY 1"

QUERIES["a21_health_score"] = lambda s, d: H.health_score(derive(s, d, "health"))
ORACLE["a21_health_score"] = _health
QUERIES["w3_connector_status"] = lambda s, d: H.connector_status(derive(s, d, "health"))
ORACLE["w3_connector_status"] = f"""SELECT connector_id, CASE WHEN n = 0 THEN 'CONNECTED' WHEN n >= 3 THEN 'DISCONNECTED' ELSE 'DEGRADED' END AS status FROM (
  SELECT connector_id, coalesce(min(CASE WHEN status = 'CONNECTED' THEN rn END) - 1, count(*)) AS n FROM (SELECT *, row_number() OVER (PARTITION BY connector_id ORDER BY ts DESC, event_id DESC) AS rn FROM {HEALTH}) GROUP BY 1)"""
QUERIES["a24_request_histogram"] = lambda s, d: H.request_histogram(derive(s, d, "requests"))
ORACLE["a24_request_histogram"] = f"SELECT method, route, status, count(*) AS n, round(sum(seconds), 6) AS total, {_le} FROM {REQ} GROUP BY ALL"
QUERIES["w11_outage_states"] = lambda s, d: H.outage_states(derive(s, d, "health"))
QUERIES["r3_rate_limit_batch"] = lambda s, d: H.rate_limit(table(s, d, "events"), 2, 0.00005)


def _connectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    checks, k = derive(s, d, "health"), F.col("connector_id")
    status = H.connector_status(checks)
    valid = F.when(k % 3 != 0, k % 5 != 1)
    rows = status.select(k, F.concat(F.when(k % 3 != 0, "https://api").otherwise("http://api"), k, F.lit(".example")).alias("base_url"), F.when(k % 4 == 0, "NONE").otherwise("API_KEY").alias("auth_method"), "status", valid.alias("cert_valid"), F.when(k % 3 != 0, k * 7).alias("cert_days"))
    found = table(s, d, "events").where("user_id % 20 <> 19").select((F.col("user_id") % 20).alias("connector_id"), F.concat(F.lit("/api/"), "event_type").alias("path")).distinct()
    return rows, found.select("connector_id", "path", ((k + F.length("path")) % 3 != 0).alias("validated")), checks


QUERIES["a22_connector_report"] = lambda s, d: H.connector_report(*_connectors(s, d))
ORACLE["a22_connector_report"] = f"""
WITH st AS ({ORACLE['w3_connector_status']}), hs AS ({_health}), la AS (SELECT connector_id, last(latency_ms ORDER BY ts, event_id) AS latency_ms FROM {HEALTH} GROUP BY 1),
e AS (SELECT connector_id, count(*) AS found, count_if((connector_id + length(path)) % 3 <> 0) AS valid FROM (SELECT DISTINCT user_id % 20 AS connector_id, '/api/' || event_type AS path FROM events WHERE user_id % 20 <> 19) GROUP BY 1),
r AS (SELECT connector_id, connector_id % 3 <> 0 AS https, connector_id % 4 = 0 AS bare, status, CASE WHEN connector_id % 3 <> 0 THEN connector_id % 5 <> 1 END AS cert, connector_id * 7 <= 30 AS soon, coalesce(found, 0) AS found, coalesce(valid, 0) AS valid, score AS health_score, latency_ms
  FROM st JOIN hs USING (connector_id) JOIN la USING (connector_id) LEFT JOIN e USING (connector_id)),
p AS (SELECT *, CASE WHEN https THEN 40 ELSE 0 END + CASE WHEN bare THEN 0 ELSE 20 END + CASE WHEN valid > 0 THEN 15 ELSE 0 END + CASE WHEN status = 'CONNECTED' THEN 15 ELSE 0 END + CASE WHEN cert AND NOT soon THEN 10 ELSE 0 END AS security_score FROM r)
SELECT connector_id, health_score, security_score, CASE WHEN valid = 0 THEN 'incompatible' WHEN valid < found OR health_score < 70 THEN 'partial' ELSE 'compatible' END AS compatibility, latency_ms,
  coalesce(nullif(concat_ws(',', CASE WHEN NOT https THEN 'plain_http' END, CASE WHEN bare AND found > 0 THEN 'no_auth' END, CASE WHEN found = 0 THEN 'no_endpoints' WHEN valid = 0 THEN 'none_validated' WHEN valid < found THEN 'some_failed' END, CASE WHEN health_score < 50 THEN 'degraded' END,
    CASE WHEN NOT cert THEN 'cert_untrusted' WHEN cert AND soon THEN 'cert_expiring' END, CASE WHEN security_score < 70 THEN 'security_below_70' END), ''), 'no_action') AS recommendations FROM p"""
QUERIES["l6_recency"] = lambda s, d: table(s, d, "events").select("event_id", F.round(H.recency(F.when(F.col("event_id") % 11 != 0, (F.lit("2024-02-01").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400 * 20), F.col("event_type") == "view"), 6).alias("recency"))
ORACLE["l6_recency"] = "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0.75 ELSE round(greatest(0.3, pow(0.5, greatest(0, (epoch(TIMESTAMP '2024-02-01') - epoch_us(ts) / 1e6) / 86400 * 20) / CASE WHEN event_type = 'view' THEN 720 ELSE 180 END)), 6) END AS recency FROM events"
_st = lambda: F.element_at(F.array(*map(F.lit, (401, 403, 404, 429, 503, 200, 200, 200, 200))), (F.col("event_id") % 9 + 1).cast("int"))
_er = lambda: F.element_at(F.array(*map(F.lit, ("Request timed out", "getaddrinfo ENOTFOUND", "bad certificate", "weird"))), (F.col("event_id") % 4 + 1).cast("int"))
_stq, _erq = "[401, 403, 404, 429, 503, 200, 200, 200, 200][event_id % 9 + 1]", "['Request timed out', 'getaddrinfo ENOTFOUND', 'bad certificate', 'weird'][event_id % 4 + 1]"
QUERIES["l20_classify_error"] = lambda s, d: table(s, d, "events").select("event_id", H.classify_error(_st(), _er()).alias("error_class"))
ORACLE["l20_classify_error"] = f"SELECT event_id, CASE {_stq} WHEN 401 THEN 'UNAUTHORIZED' WHEN 403 THEN 'FORBIDDEN' WHEN 404 THEN 'NOT_FOUND' WHEN 429 THEN 'RATE_LIMITED' WHEN 503 THEN 'SERVER_ERROR' ELSE ['TIMEOUT', 'DNS_FAILURE', 'TLS_FAILURE', 'UNKNOWN'][event_id % 4 + 1] END AS error_class FROM events"
_PATHS = [("Products", "products"), ("orders/1", "orders"), ("offerings", "services"), ("members", "users"), ("reservations", "appointments"), ("warehouse", "inventory"), ("taxonomy", "categories"), ("news", "blogs"), ("questions", "faqs"), ("Search", "search"), ("x", "custom"), ("tickets", "custom")]
QUERIES["l21_endpoint_category"] = lambda s, d: table(s, d, "events").select("event_id", H.endpoint_category(F.concat(F.lit("/api/"), F.element_at(F.array(*[F.lit(x) for x, _ in _PATHS]), (F.col("event_id") % 12 + 1).cast("int")))).alias("category"))
ORACLE["l21_endpoint_category"] = f"SELECT event_id, [{', '.join(repr(c) for _, c in _PATHS)}][event_id % 12 + 1] AS category FROM events"


def _openapi(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    many = F.concat(F.lit('{"openapi":"3.0","paths":{'), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit('"/item'), i, F.lit('":{"get":{}}'))), ","), F.lit("}}"))
    some = F.concat(F.lit('{"swagger":"2.0","paths":{"/users":{"get":{"summary":"a"},"post":{}},"/orders/'), k, F.lit('":{"get":{}},"/faq":{"delete":{}}}}'))
    doc = F.when(k % 5 == 0, many).when(k % 5 == 1, some).when(k % 5 == 2, F.lit('{"paths":{"/a":{"get":{}}}}')).when(k % 5 == 3, F.lit("not json")).otherwise(F.lit('{"openapi":"3.1"}'))
    return table(s, d, "events").select("event_id", F.explode(H.openapi_get_endpoints(doc)).alias("e")).select("event_id", "e.category", "e.path")


QUERIES["l21_openapi_get_endpoints"] = _openapi
ORACLE["l21_openapi_get_endpoints"] = """SELECT event_id, 'products' AS category, '/item' || i AS path FROM events, range(1, 26) r(i) WHERE event_id % 5 = 0
UNION ALL SELECT event_id, unnest(['users', 'orders']), unnest(['/users', '/orders/' || event_id]) FROM events WHERE event_id % 5 = 1"""
QUERIES["l22_response_check"] = lambda s, d: table(s, d, "events").select("event_id", F.array_join(H.response_check(_st(), F.when(F.col("event_id") % 5 == 0, "oops").when(F.col("event_id") % 5 == 1, "3").otherwise(F.col("props")), F.col("event_id") % 4000), ",").alias("problems"))
ORACLE["l22_response_check"] = f"SELECT event_id, concat_ws(',', CASE WHEN {_stq} IN (401, 403) THEN 'auth_rejected' END, CASE WHEN {_stq} <> 200 THEN 'not_ok' END, CASE WHEN event_id % 5 = 0 THEN 'not_json' END, CASE WHEN event_id % 5 = 1 THEN 'not_object' END, CASE WHEN event_id % 4000 > 3000 THEN 'slow' END) AS problems FROM events"
QUERIES["l23_cert_expiring"] = lambda s, d: table(s, d, "orders").select("o_orderkey", F.coalesce(F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")) <= 30, F.lit(False)).alias("expiring"))
ORACLE["l23_cert_expiring"] = "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) <= 30 AS expiring FROM orders"
QUERIES["j16_first_success"] = lambda s, d: H.first_success(table(s, d, "events").select((F.col("event_id") / 5).cast("long").alias("request_id"), F.col("user_id").alias("connector_id"), F.when(F.col("event_id") % 6 == 0, "PENDING").otherwise("CONNECTED").alias("status"), (F.col("event_id") * 7 % 4).alias("priority"), F.col("ts").alias("created"), (F.col("event_type") != "error").alias("succeeded")))
ORACLE["j16_first_success"] = "SELECT event_id // 5 AS request_id, user_id AS connector_id FROM events WHERE event_id % 6 <> 0 AND event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY event_id // 5 ORDER BY event_id * 7 % 4, ts, user_id) = 1"


def append_log(df: DataFrame, path: str) -> DataFrame:
    """Append-only log partitioned by day."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)
    return df.sparkSession.read.parquet(path)


QUERIES["s11_append_log"] = lambda s, d: (lambda p, e: (append_log(e.where("event_id % 2 = 0"), p), append_log(e.where("event_id % 2 = 1"), p))[1].groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")))(scratch(s, "log"), table(s, d, "events"))
ORACLE["s11_append_log"] = "SELECT ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1"

# Streams
QUERIES["r1_first_seen"] = lambda s, d: E.finish(E.first_seen(E.stream(s, d, "documents")))
ORACLE["r1_first_seen"] = f"SELECT DISTINCT sha256({trim(f'''regexp_replace(lower(text), '{SP}+', ' ', 'g')''')}) AS content_hash FROM documents"


_said = lambda: F.concat(F.lit(" Error "), F.col("user_id") % 50, F.lit(" on  "), "event_type")
QUERIES["r1_repeats"] = lambda s, d: E.finish(E.repeats(E.stream(s, d, "events").select(_said().alias("text"), "ts"))).withColumn("first_at", F.col("first_at").cast("timestamp_ntz"))
ORACLE["r1_repeats"] = """
WITH e AS (SELECT sha256('error ' || user_id % 50 || ' on ' || event_type) AS h, ts, event_id FROM events),
f AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY h ORDER BY ts, event_id)) > 1800000000, true)::INT AS f FROM e),
g AS (SELECT *, sum(f) OVER (PARTITION BY h ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT h AS content_hash, min(ts) AS first_at, count(*) - 1 AS repeats FROM g GROUP BY h, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""


QUERIES["r2_sessions"] = lambda s, d: E.finish(E.sessions(E.stream(s, d, "events"))).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")
ORACLE["r2_sessions"] = """
WITH e AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800000000, true)::INT AS f FROM events),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS started, count(*) AS n FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""


def _requests(s: SparkSession, d: str) -> DataFrame:
    e = E.stream(s, d, "events")
    return s.sql(INPUTS["requests"], events=e)


QUERIES["r6_request_metrics"] = lambda s, d: E.finish(E.request_metrics(_requests(s, d))).withColumn("hour", F.col("hour").cast("timestamp_ntz"))
ORACLE["r6_request_metrics"] = f"""SELECT * FROM (SELECT date_trunc('hour', ts) AS hour, method, route, status, count(*) AS n, round(sum(seconds), 6) AS total, {_le} FROM {REQ} GROUP BY 1, 2, 3, 4)
WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
def _r3(s: SparkSession, d: str) -> DataFrame:
    return E.folded(E.timed_rows(E.stream(s, d, "events").select("user_id", "event_id", "ts")), "user_id", TokenBucket(2, 0.00005))[0]


def _r4(s: SparkSession, d: str) -> DataFrame:
    return E.folded(E.timed_rows(E.stream(s, d, "events").select(F.concat("user_id", "event_type").alias("key"), "event_id", "ts")), "key", Repeats(60.0))[0]


def _r5(s: SparkSession, d: str) -> DataFrame:
    calls = E.stream(s, d, "events").select((F.col("user_id") % 20).alias("connector_id"), "event_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return E.folded(E.timed_rows(calls), "connector_id", Breaker(3, 60.0))[0]


def _r8(s: SparkSession, d: str) -> DataFrame:
    weak = ((F.col("conv_id") * 7 + F.col("turn") * 3) % 10).isin(9, 0, 1, 2, 3)
    turns = E.stream(s, d, "conversations").where("role = 'assistant'").select("conv_id", F.col("turn").alias("event_id"), (F.col("turn") * 1_000_000).alias("at"), weak.alias("weak"))
    return E.folded(turns, "conv_id", Streak())[0]


QUERIES |= {"r3_rate_limit": _r3, "r4_repeat_queries": _r4, "r5_outages": _r5, "r8_escalations": _r8}
ORACLE["r8_escalations"] = """WITH t AS (SELECT *, CASE WHEN (conv_id * 7 + turn * 3) % 10 IN (9, 0, 1, 2, 3) THEN 1 ELSE 0 END AS weak FROM conversations WHERE role = 'assistant'),
g AS (SELECT *, sum(1 - weak) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS k FROM t)
SELECT turn AS event_id, conv_id, n::INTEGER AS streak, n >= 2 AS escalate FROM (SELECT *, sum(weak) OVER (PARTITION BY conv_id, k ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM g)"""


def _apply(s: SparkSession, d: str) -> DataFrame:
    folder = scratch(s, "apply")
    live = Live(s, f"{folder}/live", "chunk_id long, text string, version int", "chunk_id", 64)
    prev = derive(s, d, "doc_prev").select(F.col("doc_id").alias("chunk_id"), "text", F.lit(0).alias("seq"))
    cur = derive(s, d, "doc_cur").select(F.col("doc_id").alias("chunk_id"), "text", F.lit(1).alias("seq"))
    for name, changes in (("a", prev), ("b", cur)):  # a batch a snapshot, from where the stream left off
        changes.write.parquet(f"{folder}/in/{name}")
        rows = s.readStream.schema(prev.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        run = E.apply_changes(live, f"{folder}/archive")
        rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return live.read().select("chunk_id", "version", F.sha2("text", 256).alias("text_sha256"))


QUERIES["r7_apply_changes"] = _apply
ORACLE["r7_apply_changes"] = f"""SELECT coalesce(c.doc_id, p.doc_id) AS chunk_id, 1 + coalesce(c.text <> p.text, false)::INT AS version, sha256(coalesce(c.text, p.text)) AS text_sha256
FROM {sql_of('doc_prev')} p FULL OUTER JOIN {sql_of('doc_cur')} c ON p.doc_id = c.doc_id"""


def _notified(s: SparkSession, d: str) -> DataFrame:
    """Comparison reports arrive as a stream (one an order); each gives its events on every channel that wants them."""
    from .snapshots import _settings, notifications

    k = F.col("o_orderkey")
    reports = E.stream(s, d, "orders").select(F.create_map(F.lit("added"), k % 3, F.lit("changed"), k % 4).alias("entities"), (k % 5).alias("deleted"))
    return E.finish(notifications(reports, _settings(s, d))).groupBy("event", "channel").agg(F.count(F.lit(1)).alias("n"))


QUERIES["r9_notify"] = _notified
ORACLE["r9_notify"] = """
WITH e AS (SELECT 'NEW_PRODUCTS' AS event FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT 'PRICE_CHANGES' FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT 'REMOVED_PAGES' FROM orders WHERE o_orderkey % 5 > 0)
SELECT event, channel, count(*) AS n FROM (SELECT event, unnest(['DASHBOARD', 'LOG', 'WEBHOOK']) AS channel FROM e UNION ALL SELECT event, 'EMAIL' FROM e WHERE event = 'PRICE_CHANGES') GROUP BY ALL"""
