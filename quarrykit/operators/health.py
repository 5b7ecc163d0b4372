"""Connector health, outage episodes, rate limits and request metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import Breaker, TokenBucket, fold, microseconds

# Fixed value: upper bounds of the latency histogram in seconds.
BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def health_score(checks: DataFrame, last: int = 20) -> DataFrame:
    """connector_id, score of the last ``last`` checks: 70 % availability, 30 % latency against 5 s (none: 5 s)."""
    newest = F.row_number().over(Window.partitionBy("connector_id").orderBy(F.desc("ts"), F.desc("event_id")))
    recent = checks.withColumn("rn", newest).where(F.col("rn") <= last)
    latency = F.coalesce(F.avg("latency_ms"), F.lit(5000.0))
    score = 100 * (0.7 * F.avg("availability") + 0.3 * F.greatest(F.lit(0.0), 1 - latency / 5000))
    return recent.groupBy("connector_id").agg(F.floor(score + 0.5).cast("int").alias("score"))


def connector_status(checks: DataFrame) -> DataFrame:
    """connector_id, status from the newest checks: CONNECTED, DISCONNECTED after three failures in a row, else DEGRADED.

    Needs the times of the last success and of failures after it, so three plain aggregates and one join do.
    """
    key = F.struct("ts", "event_id")
    good = checks.where("status = 'CONNECTED'").groupBy("connector_id").agg(F.max(key).alias("last_good"))
    rows = checks.select("connector_id", "status", key.alias("at")).join(good, "connector_id", "left")
    failing = F.count_if(F.col("last_good").isNull() | (F.col("at") > F.col("last_good")))
    return rows.groupBy("connector_id").agg(failing.alias("n")).select("connector_id", F.when(F.col("n") == 0, "CONNECTED").when(F.col("n") >= 3, "DISCONNECTED").otherwise("DEGRADED").alias("status"))


def request_histogram(requests: DataFrame, *keys: str | Column) -> DataFrame:
    """Per method, route, status (and further keys): count, sum of seconds and cumulative buckets."""
    le = [F.count_if(F.col("seconds") <= b).alias(f"le_{str(b).replace('.', '_')}") for b in BUCKETS]
    return requests.groupBy(*keys, "method", "route", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 6).alias("total"), *le)


def outage_states(calls: DataFrame, limit: int = 3, reset: float = 60.0) -> DataFrame:
    """event_id, connector_id, outcome, state after each call, folded in time order per connector over as many tasks as its log needs."""
    rows = calls.select("connector_id", "event_id", microseconds(F.col("ts")).alias("at"), (F.col("status") == "CONNECTED").alias("ok"))
    return fold(rows, "connector_id", Breaker(limit, reset))[0]


def rate_limit(requests: DataFrame, most: float, per_second: float) -> DataFrame:
    """event_id, user_id, allowed by a token bucket per user, in time order."""
    return fold(requests.select("user_id", "event_id", microseconds(F.col("ts")).alias("at")), "user_id", TokenBucket(most, per_second))[0]


def classify_error(status: Column, error: Column) -> Column:
    e = F.lower(error)
    return (
        F.when(status == 401, "UNAUTHORIZED").when(status == 403, "FORBIDDEN").when(status == 404, "NOT_FOUND").when(status == 429, "RATE_LIMITED").when(status >= 500, "SERVER_ERROR")
        .when(e.rlike("timeout|timed out|aborted"), "TIMEOUT").when(e.rlike("enotfound|dns|getaddrinfo"), "DNS_FAILURE").when(e.rlike("certificate|tls|ssl"), "TLS_FAILURE").otherwise("UNKNOWN")
    )


# Endpoint categories by parts of the path, in order.
ENDPOINTS = {
    "products": "product|item|sku", "orders": "order|purchase|transaction", "services": "service|offering", "users": "user|customer|account|member", "appointments": "appointment|booking|reservation|schedule",
    "inventory": "inventory|stock|warehouse", "categories": "categor|collection|taxonomy", "blogs": "blog|post|article|news", "faqs": "faq|question", "search": "search|query",
}


def endpoint_category(path: Column) -> Column:
    out = None
    for name, words in ENDPOINTS.items():
        out = F.when(F.lower(path).rlike(words), name) if out is None else out.when(F.lower(path).rlike(words), name)
    return out.otherwise("custom")


def openapi_get_endpoints(doc: Column, most: int = 25) -> Column:
    """array<struct<category, path>>: the first paths with a GET operation of an OpenAPI or Swagger document, none if it is neither."""
    parsed = F.from_json(doc, "struct<openapi:string,swagger:string,paths:map<string,map<string,string>>>")
    stated = parsed["openapi"].isNotNull() | parsed["swagger"].isNotNull()
    gets = F.transform(F.filter(F.map_entries(parsed["paths"]), lambda e: F.map_contains_key(e["value"], "get")), lambda e: F.struct(endpoint_category(e["key"]).alias("category"), e["key"].alias("path")))
    return F.when(stated & parsed["paths"].isNotNull(), F.slice(gets, 1, most)).otherwise(F.array().cast("array<struct<category:string,path:string>>"))


def connector_report(connectors: DataFrame, endpoints: DataFrame, checks: DataFrame) -> DataFrame:
    """connector_id, health_score, security_score (40, 20, 15, 15 and 10 points), compatibility, last latency and recommendations (codes).

    connectors: connector_id, base_url, auth_method, status, cert_valid (null: not checked), cert_days; endpoints: connector_id, path,
    validated; checks: connector_id, ts, event_id, status, latency_ms, availability.
    """
    said = endpoints.groupBy("connector_id").agg(F.count(F.lit(1)).alias("found"), F.count_if("validated").alias("valid"))
    last = checks.groupBy("connector_id").agg(F.max_by("latency_ms", F.struct("ts", "event_id")).alias("latency_ms"))
    rows = connectors.join(said, "connector_id", "left").join(last, "connector_id", "left").join(health_score(checks).withColumnRenamed("score", "health_score"), "connector_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.withColumn("found", none("found")).withColumn("valid", none("valid")).withColumn("checked", F.col("health_score").isNotNull()).withColumn("health_score", none("health_score"))
    https, expiring = F.col("base_url").startswith("https://"), F.coalesce(F.col("cert_days") <= 30, F.lit(False))
    points = F.when(https, 40).otherwise(0) + F.when(F.col("auth_method") != "NONE", 20).otherwise(0) + F.when(F.col("valid") > 0, 15).otherwise(0) + F.when(F.col("status") == "CONNECTED", 15).otherwise(0) + F.when(F.coalesce("cert_valid", F.lit(False)) & ~expiring, 10).otherwise(0)
    rows = rows.withColumn("security_score", F.least(F.lit(100), points))
    advice = F.array_compact(F.array(
        F.when(~https, "plain_http"), F.when((F.col("auth_method") == "NONE") & (F.col("found") > 0), "no_auth"), F.when(F.col("found") == 0, "no_endpoints").when(F.col("valid") == 0, "none_validated").when(F.col("valid") < F.col("found"), "some_failed"),
        F.when((F.col("health_score") < 50) & F.col("checked"), "degraded"), F.when(~F.col("cert_valid"), "cert_untrusted").when(F.col("cert_valid") & expiring, "cert_expiring"), F.when(F.col("security_score") < 70, "security_below_70"),
    ))
    fits = F.when(F.col("valid") == 0, "incompatible").when((F.col("valid") < F.col("found")) | (F.col("health_score") < 70), "partial").otherwise("compatible")
    return rows.select("connector_id", "health_score", "security_score", fits.alias("compatibility"), "latency_ms", F.when(F.size(advice) > 0, F.array_join(advice, ",")).otherwise("no_action").alias("recommendations"))


def response_check(status: Column, body: Column, ms: Column) -> Column:
    """Problems of a logged response: auth_rejected, not_ok, not_json, not_object, slow."""
    parsed = F.try_parse_json(body)
    return F.array_compact(F.array(
        F.when(status.isin(401, 403), "auth_rejected"),
        F.when(~status.between(200, 299), "not_ok"),
        F.when(parsed.isNull(), "not_json"),
        F.when(parsed.isNotNull() & ~body.rlike(r"^\s*[\[{]"), "not_object"),
        F.when(ms > 3000, "slow"),
    ))


def first_success(attempts: DataFrame) -> DataFrame:
    """request_id, connector_id: of usable connectors (CONNECTED or DEGRADED), by priority then creation, the first that succeeded."""
    usable = attempts.where("status IN ('CONNECTED', 'DEGRADED') AND succeeded")
    return usable.groupBy("request_id").agg(F.min_by("connector_id", F.struct("priority", "created", "connector_id")).alias("connector_id"))


def recency(age_days: Column, evergreen: Column) -> Column:
    decayed = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / F.when(evergreen, 720.0).otherwise(180.0))
    return F.when(age_days.isNull(), 0.75).otherwise(F.greatest(F.lit(0.3), decayed))
