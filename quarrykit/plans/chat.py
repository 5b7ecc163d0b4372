"""Queries over conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat as C
from ..session import table
from .inputs import derive, sql_of
from .text import words_in

QUERIES, ORACLE = {}, {}
CHAT, SCORED = sql_of("chat"), sql_of("scored")


def _bounded(w: str) -> str:
    return "(?i)(^|[^A-Za-z0-9_])" + w.replace("'", "''") + "($|[^A-Za-z0-9_])"


_hits = {k: " + ".join(f"regexp_matches(text, '{_bounded(w)}')::INT" for w in ws) for k, ws in C.INTENTS.items()}
_names = "[" + ", ".join(f"'{k}'" for k in C.INTENTS) + "]"
_INTENT = f"""(SELECT conv_id, turn, role, text, coalesce(intent, 'unknown') AS intent, CASE WHEN h IS NULL THEN 0 ELSE round(least(h / 3.0, 1.0), 6) END AS intent_confidence FROM (SELECT * FROM {CHAT}) m LEFT JOIN (
  SELECT conv_id, turn, intent, h FROM (SELECT conv_id, turn, unnest({_names}) AS intent, unnest([{', '.join(_hits.values())}]) AS h, unnest(range(16)) AS place FROM {CHAT})
  WHERE h >= 1 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY least(h / 3.0, 1.0) DESC, place) = 1) USING (conv_id, turn))"""

QUERIES["l12_detect_intent"] = lambda s, d: C.with_intent(derive(s, d, "chat")).select("conv_id", "turn", "intent", "intent_confidence")
ORACLE["l12_detect_intent"] = f"SELECT conv_id, turn, intent, intent_confidence FROM {_INTENT}"
QUERIES["w1_question_answer_pairs"] = lambda s, d: C.answer_pairs(table(s, d, "conversations")).select("conv_id", "turn", "text", "answer")
ORACLE["w1_question_answer_pairs"] = "SELECT conv_id, turn, text, answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'"
_streak = f"""(SELECT conv_id, coalesce(min(CASE WHEN confidence >= 0.35 THEN rn END) - 1, count(*)) AS streak FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM {SCORED} WHERE role = 'assistant') WHERE rn <= 10 GROUP BY 1)"""
QUERIES["w2_ungrounded_streak"] = lambda s, d: C.ungrounded_streak(derive(s, d, "scored"))
ORACLE["w2_ungrounded_streak"] = f"SELECT * FROM {_streak}"
QUERIES["w4_recent_turns"] = lambda s, d: C.recent_turns(table(s, d, "conversations"), 3).select("conv_id", "turn", F.array_join(F.transform("recent", lambda r: F.concat(r["turn"], F.lit(":"), r["role"])), ",").alias("recent"))
ORACLE["w4_recent_turns"] = "SELECT conv_id, turn, coalesce(array_to_string(list(turn || ':' || role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS recent FROM conversations"


def _topical(s: SparkSession, d: str) -> DataFrame:
    """Conversations whose user turns change topic: the template follows the turn as well."""
    rows = derive(s, d, "chat").withColumn("text", F.when(F.col("role") == "user", F.element_at(F.array(*map(F.lit, TOPIC_TEXTS)), ((F.col("conv_id") + F.floor(F.col("turn") / 2)) % 6 + 1).cast("int"))).otherwise(F.col("text")))
    return C.topics(C.with_intent(rows))


TOPIC_TEXTS = ["hello", "my order tracking", "the price please", "refund policy", "is it in stock", "my order shipment"]
TOPIC_INTENTS = [None, "order_status", "pricing_inquiry", "policy_inquiry", "inventory_inquiry", "order_status"]
_tl = "[" + ", ".join(f"'{x}'" if x else "NULL" for x in TOPIC_INTENTS) + "]"
_topic = f"(SELECT *, CASE WHEN role = 'user' THEN {_tl}[(conv_id + turn // 2) % 6 + 1] END AS t FROM conversations)"
QUERIES["w5_recent_topics"] = lambda s, d: _topical(s, d).select("conv_id", "turn", F.array_join("recent_topics", ",").alias("recent_topics"))
ORACLE["w5_recent_topics"] = f"""SELECT a.conv_id, a.turn, coalesce(string_agg(t, ',' ORDER BY last DESC), '') AS recent_topics FROM (SELECT conv_id, turn FROM conversations) a LEFT JOIN LATERAL (
  SELECT t, max(turn) AS last FROM {_topic} b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND t IS NOT NULL GROUP BY t) ON true GROUP BY 1, 2"""
QUERIES["w6_topic_switch"] = lambda s, d: _topical(s, d).select("conv_id", "turn", "topic_switch")
ORACLE["w6_topic_switch"] = f"SELECT conv_id, turn, coalesce(t <> last_value(t IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS topic_switch FROM {_topic}"
QUERIES["w7_rolling_memory"] = lambda s, d: C.rolling_memory(table(s, d, "conversations"))
_sess = "SELECT event_id, user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, coalesce({0} > 30, true)::INT AS f FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 60e6 AS idle FROM events))"
QUERIES["w9_sessionize"] = lambda s, d: C.sessionize(table(s, d, "events")).select("event_id", "user_id", "session")
ORACLE["w9_sessionize"] = _sess.format("idle")
QUERIES["w9_sessionize_rounded"] = lambda s, d: C.sessionize(table(s, d, "events"), rounded=True).select("event_id", "user_id", "session")
ORACLE["w9_sessionize_rounded"] = _sess.format("round(idle)")

_pairs = f"""(SELECT conv_id, turn, text, ac FROM (SELECT *, lead(role) OVER w AS nr, lead(confidence) OVER w AS ac FROM (SELECT * REPLACE (CASE WHEN role = 'user' THEN 'Question ' || conv_id % 23 ELSE text END AS text) FROM {SCORED}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"""


def _scored_pairs(s: SparkSession, d: str) -> DataFrame:
    rows = derive(s, d, "scored").withColumn("text", F.when(F.col("role") == "user", F.concat(F.lit("Question "), F.col("conv_id") % 23)).otherwise(F.col("text")))
    return C.answer_pairs(rows)


_weak = lambda: F.coalesce(F.col("answer_confidence") < 0.35, F.lit(True))
QUERIES["a15_chat_totals"] = lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).agg(F.count(F.lit(1)).alias("conversations"), F.count_if((F.col("conv_id") % 3 == 0) & (F.col("last") > 2)).alias("resolved"), F.count_if(F.col("conv_id") % 8 == 4).alias("escalated"))
ORACLE["a15_chat_totals"] = "SELECT count(*) AS conversations, count_if(conv_id % 3 = 0 AND last > 2)::BIGINT AS resolved, count_if(conv_id % 8 = 4)::BIGINT AS escalated FROM (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)"
QUERIES["a16_chat_response_time"] = lambda s, d: derive(s, d, "scored").where("role = 'assistant'").groupBy((F.col("conv_id") % 10).alias("shard")).agg(F.round(F.avg("took_ms"), 6).alias("mean_ms"))
ORACLE["a16_chat_response_time"] = f"SELECT conv_id % 10 AS shard, round(avg(took_ms), 6) AS mean_ms FROM {SCORED} WHERE role = 'assistant' GROUP BY 1"
QUERIES["a17_chat_length"] = lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("mean_messages"))
ORACLE["a17_chat_length"] = "SELECT round(avg(n), 6) AS mean_messages FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)"
QUERIES["a18_chat_satisfaction"] = lambda s, d: derive(s, d, "scored").agg(F.count_if(F.col("feedback") == "like").alias("likes"), F.count_if(F.col("feedback") == "dislike").alias("dislikes")).withColumn("rate", F.round(F.try_divide("likes", F.col("likes") + F.col("dislikes")), 6))
ORACLE["a18_chat_satisfaction"] = f"SELECT count_if(feedback = 'like')::BIGINT AS likes, count_if(feedback = 'dislike')::BIGINT AS dislikes, round(count_if(feedback = 'like') / nullif(count(feedback), 0), 6) AS rate FROM {SCORED}"
QUERIES["a19_top_questions"] = lambda s, d: C.top_questions(_scored_pairs(s, d))
ORACLE["a19_top_questions"] = f"SELECT text AS question, count(*) AS times FROM {_pairs} GROUP BY 1 ORDER BY 2 DESC, min(conv_id * 1000 + turn) LIMIT 10"
QUERIES["a19_failed_questions"] = lambda s, d: C.top_questions(_scored_pairs(s, d).where(_weak()))
ORACLE["a19_failed_questions"] = f"SELECT text AS question, count(*) AS times FROM {_pairs} WHERE coalesce(ac < 0.35, true) GROUP BY 1 ORDER BY 2 DESC, min(conv_id * 1000 + turn) LIMIT 10"
QUERIES["a20_knowledge_coverage"] = lambda s, d: _scored_pairs(s, d).agg(F.round(1 - F.avg(_weak().cast("int")), 6).alias("coverage"))
ORACLE["a20_knowledge_coverage"] = f"SELECT round(1 - avg(coalesce(ac < 0.35, true)::INT), 6) AS coverage FROM {_pairs}"

QUERIES["l13_extract_entities"] = lambda s, d: derive(s, d, "chat").select("conv_id", "turn", F.explode(C.entities(F.col("text"))).alias("e")).select("conv_id", "turn", "e.type", "e.value")
_x = lambda p, g=0: f"unnest(regexp_extract_all(text, '{p}', {g}))"
_date = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b"
ORACLE["l13_extract_entities"] = rf"""
SELECT conv_id, turn, 'email' AS type, lower({_x(T.EMAIL)}) AS value FROM {CHAT}
UNION ALL SELECT conv_id, turn, 'order_id', upper({_x(r'(?i)(?:\border\s*#?|\bord[-\s]?|#)\s*([a-z0-9]{4,15})\b', 1)}) FROM {CHAT}
UNION ALL SELECT conv_id, turn, 'money', {_x(T.MONEY)} FROM {CHAT} UNION ALL SELECT conv_id, turn, 'date', {_x(_date)} FROM {CHAT}"""


def _known(s: SparkSession, d: str) -> DataFrame:
    products = table(s, d, "part").select(F.lit("product").alias("type"), F.concat(F.initcap(F.split("p_name", " ")[0]), F.lit(" "), "p_partkey").alias("name"))
    return products.unionByName(table(s, d, "supplier").select(F.lit("service").alias("type"), F.concat(F.lit("Plan"), "s_suppkey").alias("name")))


def _naming(s: SparkSession, d: str) -> DataFrame:
    k = F.col("conv_id")
    said = table(s, d, "part").select((F.col("p_partkey") - 1).alias("conv_id"), F.concat(F.lit(" about the "), F.upper(F.split("p_name", " ")[0]), F.lit(" "), "p_partkey", F.lit("s and my plan"), F.col("p_partkey") % 7, F.lit("?")).alias("more"))
    return table(s, d, "conversations").where("role = 'user'").join(said, "conv_id", "left").select(k, "turn", F.concat("text", F.coalesce("more", F.lit(""))).alias("text"))


QUERIES["l13_known_mentions"] = lambda s, d: C.known_mentions(_naming(s, d), _known(s, d), ["conv_id", "turn"])
ORACLE["l13_known_mentions"] = """WITH n AS (SELECT 'product_mention' AS type, upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) || ' ' || p_partkey AS name FROM part UNION ALL SELECT 'service_mention', 'Plan' || s_suppkey FROM supplier),
t AS (SELECT conv_id, turn, text || coalesce(' about the ' || upper(split_part(p_name, ' ', 1)) || ' ' || p_partkey || 's and my plan' || p_partkey % 7 || '?', '') AS text FROM conversations LEFT JOIN part ON conv_id = p_partkey - 1 WHERE role = 'user')
SELECT conv_id, turn, type, name AS value FROM t JOIN n ON contains(lower(text), lower(name))"""


def _turns(s: SparkSession, d: str) -> DataFrame:
    """User messages with intent, whether their answer was grounded, and ungrounded answers just before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    conf = F.when((F.col("conv_id") * 7 + F.col("turn") * 3) % 10 != 9, ((F.col("conv_id") * 7 + F.col("turn") * 3) % 10) / 10.0)
    rows = C.with_intent(derive(s, d, "chat")).withColumn("bad", (F.coalesce(conf, F.lit(0.0)) < 0.35).cast("int"))
    return rows.withColumn("streak", F.coalesce(F.lag("bad").over(w), F.lit(0))).withColumn("grounded", F.col("bad") == 0).where("role = 'user'")


QUERIES["l14_escalation"] = lambda s, d: C.escalation(_turns(s, d)).select("conv_id", "turn", "reason", "channel")
_any = lambda ps: "regexp_matches(text, '(?i)" + "|".join(f"(?:{p})" for p in ps) + "')"
ORACLE["l14_escalation"] = f"""
WITH t AS (SELECT *, coalesce(lag(bad) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS streak FROM (SELECT *, CASE WHEN (conv_id * 7 + turn * 3) % 10 IN (9, 0, 1, 2, 3) THEN 1 ELSE 0 END AS bad FROM {_INTENT})),
r AS (SELECT conv_id, turn, CASE WHEN {_any(C.SENSITIVE)} THEN 'SENSITIVE_TOPIC' WHEN {_any(C.LEGAL)} THEN 'LEGAL' WHEN {_any(C.BILLING)} THEN 'BILLING_DISPUTE' WHEN intent = 'human_request' THEN 'HUMAN_REQUESTED' WHEN intent = 'complaint' THEN 'COMPLAINT'
  WHEN bad = 1 AND streak >= 1 AND intent IN {words_in(C.TECHNICAL)} THEN 'TECHNICAL_BEYOND_KNOWLEDGE' WHEN bad = 1 AND streak >= 1 THEN 'REPEATED_FAILURE' END AS reason FROM t WHERE role = 'user')
SELECT *, CASE WHEN reason IN ('SENSITIVE_TOPIC', 'HUMAN_REQUESTED') THEN 'LIVE_AGENT' WHEN reason = 'LEGAL' THEN 'EMAIL' WHEN reason IS NOT NULL THEN 'TICKET' END AS channel FROM r"""
QUERIES["l15_grounding_audit"] = lambda s, d: derive(s, d, "decorated").select("doc_id", F.array_join(F.array_sort(C.grounding_audit(F.concat(F.coalesce("text", F.lit("")), F.lit(" and $7.50")), F.concat(F.lit("list price $ 7.50, $"), F.col("doc_id") % 40, F.lit(".50")))), ",").alias("unmatched"))
ORACLE["l15_grounding_audit"] = rf"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text || ' and $7.50', '{T.MONEY}'), lambda x: regexp_replace(x, '\s', '', 'g')), lambda x: x NOT IN ('$7.50', '$' || doc_id % 40 || '.50')))), ','), '') AS unmatched FROM {sql_of('decorated')}"""
QUERIES["l16_refusal_message"] = lambda s, d: C.with_intent(derive(s, d, "chat")).where("role = 'user'").select("conv_id", "turn", C.refusal_message(F.col("intent")).alias("message"))
ORACLE["l16_refusal_message"] = f"SELECT conv_id, turn, '{C.REFUSAL.replace(chr(39), chr(39) * 2)}' || CASE intent " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in C.SUFFIXES.items()) + f" ELSE '{C.SUFFIX.replace(chr(39), chr(39) * 2)}' END AS message FROM {_INTENT} WHERE role = 'user'"
QUERIES["l19_chat_context"] = lambda s, d: C.recent_turns(_topical(s, d), 12).select("conv_id", "turn", F.struct(F.size("recent").alias("turns"), "recent_topics", "topic_switch", F.size(C.entities(F.col("text"))).alias("entities")).alias("context")).select("conv_id", "turn", F.to_json("context").alias("context"))
QUERIES["p20_build_prompts"] = lambda s, d: C.build_prompts(table(s, d, "conversations"), table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array("text", F.upper("text")).alias("sources"))).select("conv_id", "turn", F.size("prompt").alias("parts"), F.to_json("prompt").alias("prompt"))
QUERIES["s12_export_transcripts"] = lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), "turn", F.lit("] "), F.upper("role"), F.lit(": "), "text").alias("line")))).alias("ls")).select("conv_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n\n").alias("transcript"))
ORACLE["s12_export_transcripts"] = "SELECT conv_id, string_agg('[' || turn || '] ' || upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1"
