"""Conversation analytics: windows over turns, intents, entities, escalation, memory."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import once
from ..session import attach, durable

# Intents with their keywords, in order.
INTENTS = {
    "greeting": ["hi", "hello", "hey", "good morning", "good afternoon", "good evening", "namaste", "salaam", "yo"],
    "goodbye": ["bye", "goodbye", "see you", "talk later", "that's all", "thats all", "no more questions", "thank you bye"],
    "product_inquiry": ["product", "item", "buy", "purchase", "specs", "specification", "available", "model", "catalog", "catalogue", "features of"],
    "service_inquiry": ["service", "services", "offer", "provide", "consultation", "package", "plan"],
    "pricing_inquiry": ["price", "pricing", "cost", "how much", "quote", "discount", "fee", "charges", "rate"],
    "order_status": ["order status", "my order", "track order", "tracking", "shipment", "delivery status", "where is my order", "order number"],
    "appointment_inquiry": ["appointment", "book a slot", "schedule", "reschedule", "booking", "available slot", "meeting time"],
    "inventory_inquiry": ["in stock", "stock", "availability", "out of stock", "how many left", "inventory"],
    "faq": ["faq", "frequently asked", "how do i", "how to", "what is", "can i", "do you"],
    "policy_inquiry": ["policy", "refund", "return", "cancellation", "cancel", "warranty", "terms", "privacy", "shipping policy", "exchange"],
    "contact_inquiry": ["contact", "phone number", "email address", "office hours", "location", "address", "opening hours", "where are you located"],
    "complaint": ["complaint", "not working", "broken", "terrible", "worst", "unhappy", "disappointed", "unacceptable", "poor service", "angry"],
    "human_request": ["human", "agent", "real person", "representative", "talk to someone", "speak to someone", "customer support", "live chat with", "connect me"],
    "feedback_positive": ["thanks", "thank you", "great", "awesome", "helpful", "perfect", "love it", "amazing", "excellent"],
    "feedback_negative": ["not helpful", "useless", "wrong answer", "that's wrong", "doesn't help", "not what i asked"],
    "small_talk": ["how are you", "who are you", "what can you do", "are you a bot", "are you human", "your name"],
}
NOT_TOPICS = ["greeting", "goodbye", "small_talk", "feedback_positive", "feedback_negative", "unknown"]
SENSITIVE = [r"\bdata\s+breach\b", r"\bhacked\b", r"security\s+vulnerability", r"\binjur(y|ed)\b", r"\bemergency\b", r"self[\s-]?harm", r"\bsuicide\b", r"medical\s+emergency", r"allergic\s+reaction"]
LEGAL = [r"\blawsuit\b", r"\blawyer\b", r"\battorney\b", r"legal\s+action", r"\bsue\s+(you|us)\b", r"\bgdpr\b", r"data\s+protection\s+officer", r"\bsubpoena\b"]
BILLING = [r"charged\s+(twice|incorrectly)", r"unauthorized\s+charge", r"billing\s+dispute", r"refund\s+my\s+money", r"dispute\s+this\s+charge", r"\bchargeback\b"]
TECHNICAL = ["product_inquiry", "service_inquiry", "inventory_inquiry", "appointment_inquiry", "order_status"]
REFUSAL = "I don't have verified information about that in our knowledge base right now."
SUFFIXES = {
    "complaint": " I'd like to connect you with our support team so they can look into this properly — would that be alright?",
    "human_request": " Let me connect you with a member of our team.",
    "order_status": " I'd recommend contacting our support team directly with your order details so they can look this up for you.",
}
SUFFIX = " I don't want to guess, so I'd recommend reaching out to our support team for a definitive answer — or let me know if there's something else I can help with."
MIN_CONFIDENCE = 0.35
TOPICS = [i for i in INTENTS if i not in NOT_TOPICS]
#: Bytes of known names that one automaton may hold.
BLOCK_BYTES = 32 << 20


def word_bounded(keyword: str) -> str:
    """An ASCII word boundary on both sides, whatever the engine thinks of accents."""
    import re

    return rf"(?i)(?<![A-Za-z0-9_]){re.escape(keyword)}(?![A-Za-z0-9_])".replace(r"\ ", " ")


def intent_candidates(c: Column) -> Column:
    """array<struct<confidence, intent, hits>>, most confident first, ties in declared order.

    A keyword is looked for as a substring first, and only where that is found with its boundaries.
    """

    def of(texts: Column) -> Column:
        rows = []
        for place, (intent, words) in enumerate(INTENTS.items()):
            hits = sum(((texts["low"].contains(w) & texts["text"].rlike(word_bounded(w))).cast("int") for w in words), F.lit(0))
            rows.append(F.struct((-F.least(hits / 3.0, F.lit(1.0))).alias("order"), F.lit(place).alias("place"), F.lit(intent).alias("intent"), hits.alias("hits")))
        return F.array_sort(F.filter(F.array(*rows), lambda r: r["order"] <= -0.3))

    return once(F.struct(F.coalesce(c, F.lit("")).alias("text"), F.lower(F.coalesce(c, F.lit(""))).alias("low")), of)


def with_intent(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds intent (or unknown), confidence and candidates (names)."""

    def settled(c: Column) -> Column:
        best = F.get(c, F.lit(0))
        return F.struct(F.coalesce(best["intent"], F.lit("unknown")).alias("intent"), F.round(F.coalesce(-best["order"], F.lit(0.0)), 6).alias("intent_confidence"), F.transform(c, lambda r: r["intent"]).alias("candidates"))

    rows = messages.withColumn("__i", once(intent_candidates(F.col(text)), settled))
    return rows.select(*messages.columns, "__i.*")


def by_turn() -> Window:
    return Window.partitionBy("conv_id").orderBy("turn")


def answer_pairs(messages: DataFrame) -> DataFrame:
    """User messages whose next message, of any role, is the assistant's."""
    w = by_turn()
    rows = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    rows = rows.withColumn("answer_confidence", F.lead("confidence").over(w)) if "confidence" in messages.columns else rows
    return rows.where("role = 'user' AND next_role = 'assistant'").drop("next_role")


def ungrounded_streak(messages: DataFrame) -> DataFrame:
    """conv_id, streak: leading run, newest first, of assistant answers without 0.35 confidence, among the last ten."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = messages.where("role = 'assistant'").withColumn("rn", newest).where("rn <= 10")
    grounded = F.coalesce(F.col("confidence") >= MIN_CONFIDENCE, F.lit(False))
    return last.groupBy("conv_id").agg((F.coalesce(F.min(F.when(grounded, F.col("rn"))) - 1, F.count(F.lit(1)))).alias("streak"))


def recent_turns(messages: DataFrame, n: int = 12) -> DataFrame:
    return messages.withColumn("recent", F.collect_list(F.struct("turn", "role")).over(by_turn().rowsBetween(-n, -1)))


def topic(intent: Column) -> Column:
    return F.when(~intent.isin(NOT_TOPICS), intent)


def topics(messages: DataFrame, n: int = 5) -> DataFrame:
    """Adds recent_topics (distinct, newest first, up to and with this user message) and topic_switch.

    The topics are the intents of the rules, so a row needs the last turn of each and no list of what was said before.
    """
    w = by_turn()
    said = F.when(F.col("role") == "user", topic(F.col("intent")))
    rows = messages.withColumn("__t", said).withColumn("__n", F.row_number().over(w))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    lasts = F.array_compact(F.array(*[F.when(F.col(f"__l{i}").isNotNull(), F.struct((-F.col(f"__l{i}")).alias("at"), F.lit(t).alias("topic"))) for i, t in enumerate(TOPICS)]))
    rows = rows.withColumns({f"__l{i}": F.max(F.when(F.col("__t") == t, F.col("__n"))).over(upto) for i, t in enumerate(TOPICS)})
    last = F.last("__t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    recent = F.slice(F.transform(F.array_sort(lasts), lambda x: x["topic"]), 1, n)
    return rows.withColumn("recent_topics", recent).withColumn("topic_switch", F.coalesce(F.col("__t") != last, F.lit(False))).select(*messages.columns, "recent_topics", "topic_switch")


def rolling_memory(messages: DataFrame, longest: int = 800) -> DataFrame:
    """conv_id, memory: one sentence per turn; whole leading sentences go while it is too long, then characters from the left.

    What stays is the longest run of last sentences that fits. A sentence has at least eight characters and a space before it, so no more
    than ``longest`` / 9 of them can fit: only so many last turns of a conversation are looked at, kept before the shuffle.
    """
    line = F.concat(F.initcap("role"), F.lit(" said: "), F.regexp_replace(F.left(F.regexp_replace("text", r"\s+", " "), F.lit(120)), r"[.!?]", ""), F.lit("."))
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = messages.withColumn("__r", last).where(F.col("__r") <= longest // 9 + 1).select("conv_id", F.struct("turn", line.alias("line")).alias("l"))
    lines = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("l")).alias("ls")).select("conv_id", F.filter(F.transform("ls", lambda x: x["line"]), lambda x: x.isNotNull()).alias("ls"))
    run = lambda i: F.array_join(F.slice("ls", i, F.size("ls")), " ")
    starts = F.filter(F.sequence(F.lit(1), F.size("ls")), lambda i: F.length(run(i)) <= longest)
    fit = F.when(F.size("ls") == 0, "").when(F.size(starts) > 0, run(F.array_min(starts))).otherwise(F.right(F.element_at("ls", -1), F.lit(longest)))
    return lines.select("conv_id", fit.alias("memory"))


def sessionize(events: DataFrame, minutes: int = 30, rounded: bool = False) -> DataFrame:
    """Adds session (number within the user): a new one after more than ``minutes`` idle (rounded to minutes if asked)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    idle = (micros - F.lag(micros).over(w)) / 60e6
    fresh = F.coalesce((F.round(idle) if rounded else idle) > minutes, F.lit(True)).cast("int")
    return events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def any_of(c: Column, patterns: list[str]) -> Column:
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def escalation(df: DataFrame) -> DataFrame:
    """Adds reason and channel. ``df``: text, intent, grounded, streak."""
    t, i = F.col("text"), F.col("intent")
    repeated = ~F.col("grounded") & (F.col("streak") + 1 >= 2)
    reason = (
        F.when(any_of(t, SENSITIVE), "SENSITIVE_TOPIC").when(any_of(t, LEGAL), "LEGAL").when(any_of(t, BILLING), "BILLING_DISPUTE")
        .when(i == "human_request", "HUMAN_REQUESTED").when(i == "complaint", "COMPLAINT")
        .when(repeated & i.isin(TECHNICAL), "TECHNICAL_BEYOND_KNOWLEDGE").when(repeated, "REPEATED_FAILURE")
    )
    channel = F.when(reason.isin("SENSITIVE_TOPIC", "HUMAN_REQUESTED"), "LIVE_AGENT").when(reason == "LEGAL", "EMAIL").when(reason.isNotNull(), "TICKET")
    return df.withColumn("reason", reason).withColumn("channel", channel)


def top_questions(pairs: DataFrame, k: int = 10) -> DataFrame:
    """question (first spelling), times: answered questions grouped without case, most frequent first."""
    grouped = pairs.groupBy(F.lower(T.trim_spaces(F.col("text"))).alias("q")).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("conv_id", "turn", "text")).alias("first"))
    return grouped.orderBy(F.desc("times"), "first.conv_id", "first.turn").limit(k).select(F.col("first.text").alias("question"), "times")


def entities(c: Column) -> Column:
    """array<struct<type, value>> of e-mails, links, order numbers, amounts, dates and phones (7 digits or more)."""
    found = lambda p, group=0: F.regexp_extract_all(c, F.lit(p), group)
    tag = lambda kind, xs, f=lambda x: x: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("type"), f(x).alias("value")))
    date = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b"
    phone = r"(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{3,4}[\s.-]?\d{3,4}(?:[\s.-]?\d{2,4})?"
    dates = found(date)
    phones = F.filter(F.array_except(found(phone), dates), lambda x: F.length(F.regexp_replace(x, r"\D", "")) >= 7)
    return F.concat(
        tag("email", found(T.EMAIL), F.lower),
        tag("url", found(r"https?://[^\s<>\"')]+")),
        tag("order_id", F.regexp_extract_all(c, F.lit(r"(?i)(?:\border\s*#?|\bord[-\s]?|#)\s*([a-z0-9]{4,15})\b"), 1), F.upper),
        tag("money", found(r"[$€£₹¥]\s?\d[\d,]*(?:\.\d{1,2})?")),
        tag("date", dates, F.lower),
        tag("phone", phones, lambda x: F.regexp_replace(x, r"\D", "")),
    )


def known_mentions(messages: DataFrame, names: DataFrame, keys: list[str], text: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """``keys``, type, value: known names (``names``: type, name) that stand anywhere in a text, whatever their case.

    Names go into an automaton that finds all of them in one pass over a text. A dictionary of more than ``block`` bytes is split by a
    hash into blocks of at most about that size, each an automaton and a pass of its own, so what a task holds does not grow with it.
    """
    attach(messages.sparkSession)
    known = durable(names.where(F.trim("name") != "").select(F.col("type").cast("string").alias("type"), F.col("name").cast("string").alias("name"), F.lower("name").alias("low")).distinct())
    size = known.agg(F.coalesce(F.sum(F.octet_length("low") + F.octet_length("name") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // block))
    said = messages.select(*keys, F.lower(text).alias("__body"))
    said = durable(said) if parts > 1 else said
    found = None
    for part in range(parts):
        rows = known.where(F.pmod(F.xxhash64("low"), F.lit(parts)) == part).collect()  # a block of the checked size
        hits = said.select(*keys, F.inline(_mentions([(r["low"], r["type"], r["name"]) for r in rows])(F.col("__body"))))
        found = hits if found is None else found.unionByName(hits)
    return found


def _mentions(names: list[tuple[str, str, str]]):
    """UDF: array<struct<type, value>> of the names in a lower-cased text, each once."""
    ready: list = []

    def automaton():
        import ahocorasick

        made = ahocorasick.Automaton()
        by_low: dict[str, list[tuple[str, str]]] = {}
        for low, kind, name in names:
            by_low.setdefault(low, []).append((kind, name))
        for low, entries in by_low.items():
            made.add_word(low, entries)
        made.make_automaton()
        return made

    def run(bodies: pd.Series) -> pd.Series:
        if not ready:
            ready.append(automaton() if names else None)
        search = ready[0]
        out = []
        for body in bodies:
            hits = {} if search is None or not body else {id(e): e for _, e in search.iter(body)}
            out.append([{"type": f"{kind}_mention", "value": name} for entries in hits.values() for kind, name in entries])
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"bodies": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<type:string,value:string>>")


def grounding_audit(answer: Column, sources: Column) -> Column:
    """Amounts in the answer that no source has."""
    figures = lambda c: F.transform(F.regexp_extract_all(c, F.lit(T.MONEY), 0), lambda x: F.regexp_replace(x, r"\s", ""))
    return F.array_except(figures(answer), figures(sources))


def refusal_message(intent: Column) -> Column:
    suffix = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[intent]
    return F.concat(F.lit(REFUSAL), F.coalesce(suffix, F.lit(SUFFIX)))


def build_prompts(messages: DataFrame, evidence: DataFrame, n: int = 12) -> DataFrame:
    """conv_id, turn, prompt array<struct<role, content>> for each user message: rules with numbered evidence, recent turns, message.

    evidence: conv_id, turn, sources (array<string>, best first).
    """
    rules = ["Answer only from the evidence.", "Name the source of each claim.", "Say so when the evidence has no answer.", "Never invent prices, dates or policies.", "Keep to the visitor's language.", "Be brief and polite."]
    recent = messages.withColumn("recent", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(by_turn().rowsBetween(-n, -1)))
    rows = recent.where("role = 'user'").join(evidence, ["conv_id", "turn"], "left")
    numbered = F.array_join(F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda x, i: F.concat(F.lit("["), i + 1, F.lit("] "), x)), "\n")
    system = F.struct(F.lit("system").alias("role"), F.concat(F.lit("\n".join(rules) + "\n\nEvidence:\n"), numbered).alias("content"))
    return rows.select("conv_id", "turn", F.concat(F.array(system), "recent", F.array(F.struct("role", F.col("text").alias("content")))).alias("prompt"))
