r"""Tool-call linking and canonical chat formatting, in DataFrame functions only.

``link_calls`` joins calls and results by (conversation, identifier), orders calls topologically by what they depend on,
validates arguments against the tools' schemas and serialises each call with its result as canonical JSON (keys in
alphabetical order, no white space, nulls left out). ``format_chat`` puts messages and calls of whole conversations in order,
a row each, so no conversation is ever gathered in one place.

Topological level: 0 without known dependencies, else one more than the highest level it depends on. Each round replaces a call's open
dependencies by what those depend on (a call acts on a level x as max(a, x + b), and such functions compose), which doubles the reach,
as long as it and they wait for ``WIDTH`` calls at most; otherwise it drops its settled ones only. So the rounds are logarithmic in the depth where calls lie
in chains or ladders of up to ``WIDTH`` calls abreast, and at most the depth otherwise. What cannot be settled lies on or behind a cycle and has no level.

Validation errors, sorted: bad_json, unknown_tool, missing:x, type:x, range:x, enum:x, extra:x. Argument types are those of
JSON (string, integer, number, boolean).

Defined cases: several distinct calls of one identifier: the one with the smallest (turn, name, arguments, depends_on; nulls first) stands and is linked,
each other one is a row of status repeat; several distinct results: the one with the smallest (content, turn) answers, each other one is a row of
status repeat; equal rows are one row, counted in ``copies`` and ``result_copies``; a result whose call does not exist is an orphan row; a call without a result has
status no_result; a call without a turn is a call like others; unknown dependencies are ignored; a null conv_id or call_id matches nothing (each such
call is its own, each such result its own orphan row); null texts are left out of the JSON; further columns play no part; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

#: tool, argument, type, required, minimum, maximum, allowed values.
SCHEMAS = [
    ("search", "query", "string", True, None, None, None),
    ("search", "limit", "integer", True, 1.0, 20.0, None),
    ("summarize", "max_words", "integer", True, 10.0, 500.0, None),
    ("summarize", "text", "string", True, None, None, None),
    ("translate", "target", "string", True, None, None, ["de", "en", "es", "fr"]),
    ("translate", "text", "string", False, None, None, None),
]
#: Open dependencies through which a call looks ahead, and the end of the counting of what hangs on a cycle.
WIDTH, FARTHEST = 8, 1 << 40
_RULE = "argument string, type string, required boolean, minimum double, maximum double, allowed array<string>"


def _rules(schemas: list[tuple]) -> Column:
    """map<tool, array<rule>> of a literal list."""
    rows: dict[str, list[Column]] = {}
    for tool, *values in schemas:
        kinds = [part.split(" ") for part in _RULE.split(", ")]
        fields = [(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(kind).alias(name) for v, (name, kind) in zip(values, kinds, strict=True)]
        rows.setdefault(tool, []).append(F.struct(*fields))
    return F.create_map(*[x for tool, rules in rows.items() for x in (F.lit(tool), F.array(*rules))])


def _faults(given: Column, rules: Column) -> Column:
    """Errors of one call: ``given`` is map<string,variant>, ``rules`` its tool's."""

    def of(rule: Column) -> Column:
        value = F.try_element_at(given, rule["argument"])
        kind = F.schema_of_variant(value)
        number = F.try_variant_get(value, "$", "double")
        fits = (
            F.when(rule["type"] == "string", kind == "STRING")
            .when(rule["type"] == "integer", kind == "BIGINT")
            .when(rule["type"] == "number", kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT"))
            .otherwise(kind == "BOOLEAN")
        )
        fault = (
            F.when(value.isNull(), F.when(rule["required"], F.lit("missing:")))
            .when(~fits, F.lit("type:"))
            .when((number < rule["minimum"]) | (number > rule["maximum"]), F.lit("range:"))
            .when(~F.array_contains(rule["allowed"], F.try_variant_get(value, "$", "string")), F.lit("enum:"))
        )
        return F.concat(fault, rule["argument"])

    extra = F.filter(F.map_keys(given), lambda k: ~F.exists(rules, lambda r: r["argument"] == k))
    return F.array_sort(F.array_compact(F.concat(F.transform(rules, of), F.transform(extra, lambda k: F.concat(F.lit("extra:"), k)))))


def levels(calls: DataFrame, width: int = WIDTH) -> DataFrame:
    """conv_id, call_id, level of the calls that have one; ``calls``: conv_id, call_id, depends_on."""
    key = ["conv_id", "call_id"]
    ids = calls.select(*key).where("conv_id IS NOT NULL AND call_id IS NOT NULL").distinct()
    edges = calls.select(*key, F.explode("depends_on").alias("dep")).distinct()
    edges = edges.join(ids.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi")
    deps = edges.groupBy(*key).agg(F.collect_list(F.struct("dep", F.lit(1).cast("long").alias("more"))).alias("deps"))  # a call's own list
    none = F.array().cast("array<struct<dep:string,more:bigint>>")
    now = durable(ids.join(deps, key, "left").select(*key, F.lit(0).cast("long").alias("least"), F.coalesce("deps", none).alias("deps")))
    settled: list[DataFrame] = []
    while True:
        ready = now.where(F.size("deps") == 0).select(*key, F.col("least").cast("int").alias("level"))
        if ready.isEmpty():  # the lowest open call would have been settled by the last round, so what is left hangs on cycles
            break
        settled.append(ready)
        if len(settled) == 20:
            settled = [durable(_union(settled))]
        done = _union(settled).select("conv_id", F.col("call_id").alias("dep"), F.col("level").cast("long").alias("far_least"), none.alias("far"))
        far = done.unionByName(now.where(F.size("deps") > 0).select("conv_id", F.col("call_id").alias("dep"), F.col("least").alias("far_least"), F.col("deps").alias("far")))
        parts = now.where(F.size("deps") > 0).select(*key, "least", (F.size("deps") <= width).alias("narrow"), F.inline("deps")).join(far, ["conv_id", "dep"])
        behind = F.when(F.col("narrow") & (F.size("far") <= width), F.transform("far", lambda x: F.struct(x["dep"].alias("dep"), _sum(x["more"], F.col("more")).alias("more"))))
        step = parts.groupBy(*key, "narrow").agg(
            F.max("least").alias("least"),
            F.max(F.when(F.size("far") == 0, _sum(F.col("far_least"), F.col("more")))).alias("reached"),
            F.collect_list(F.when(F.size("far") > 0, F.struct("dep", "more"))).alias("own"),
            F.max(F.when(behind.isNotNull(), _sum(F.col("far_least"), F.col("more")))).alias("deeper"),
            F.flatten(F.collect_list(F.when(F.col("narrow"), F.coalesce(behind, F.array(F.struct("dep", "more")))))).alias("further"),  # at most width ** 2
        )
        longest = lambda d: F.array_max(F.transform(F.filter("further", lambda x: x["dep"] == d), lambda x: x["more"]))
        once = F.transform(F.array_distinct(F.transform("further", lambda x: x["dep"])), lambda d: F.struct(d.alias("dep"), longest(d).alias("more")))
        step = step.withColumn("once", once)
        jump = F.col("narrow") & (F.size("once") <= width)
        now = durable(step.select(
            *key, F.greatest("least", "reached", F.when(jump, F.col("deeper"))).alias("least"), F.when(jump, F.col("once")).otherwise(F.col("own")).alias("deps")
        ))
    return _union(settled) if settled else now.select(*key, F.col("least").cast("int").alias("level"))


def _sum(a: Column, b: Column) -> Column:
    return F.least(a + b, F.lit(FARTHEST))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _distinct(rows: DataFrame, values: list[str], first: str) -> DataFrame:
    """Distinct rows with ``copies`` and whether they come first of their identifier; rows without an identifier are each their own."""
    named = rows.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id", *values).agg(F.count(F.lit(1)).alias("copies"))
    lowest = named.groupBy("conv_id", "call_id").agg(F.min(F.struct(*values)).alias("lowest"))
    named = named.join(lowest, ["conv_id", "call_id"]).withColumn(first, F.struct(*values).eqNullSafe(F.col("lowest"))).drop("lowest")
    nameless = rows.where("conv_id IS NULL OR call_id IS NULL").select("conv_id", "call_id", *values, F.lit(1).cast("long").alias("copies"), F.lit(True).alias(first))
    return named.unionByName(nameless)


def link_calls(calls: DataFrame, results: DataFrame, schemas: list[tuple] = SCHEMAS) -> DataFrame:
    """One row per distinct call and per distinct result that no call shows: conv_id, call_id, turn, part, level, status, errors, copies, result_copies, json."""
    calls = calls.select("conv_id", F.col("call_id").cast("string").alias("call_id"), "turn", "name", "arguments", "depends_on")
    results = results.select("conv_id", F.col("call_id").cast("string").alias("call_id"), F.col("turn").alias("result_turn"), "content")
    asked = _distinct(calls, ["turn", "name", "arguments", "depends_on"], "standing").withColumn("is_call", F.lit(True))
    answers = _distinct(results, ["content", "result_turn"], "answering").withColumnRenamed("copies", "result_copies").withColumn("answered", F.lit(True))
    known = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    linked = asked.where("standing").where(known).join(answers.where("answering").where(known), ["conv_id", "call_id"], "full_outer")
    linked = linked.join(levels(asked.where("standing")), ["conv_id", "call_id"], "left")
    rest = asked.where(f"NOT standing OR NOT ({known})").unionByName(answers.where(f"NOT answering OR NOT ({known})"), allowMissingColumns=True)
    linked = linked.unionByName(rest, allowMissingColumns=True).withColumn("rules", F.try_element_at(_rules(schemas), F.col("name")))
    is_call = F.col("is_call").isNotNull()
    parsed = F.try_parse_json("arguments")
    given = F.try_variant_get(parsed, "$", "map<string,variant>")
    faults = F.when(given.isNull(), F.array(F.lit("bad_json"))).when(F.col("rules").isNull(), F.array(F.lit("unknown_tool"))).otherwise(_faults(given, F.col("rules")))
    errors = F.when(is_call, F.array_join(faults, ";")).otherwise(F.lit(""))
    status = (
        F.when(F.when(is_call, ~F.col("standing")).otherwise(~F.col("answering")), "repeat")
        .when(~is_call, "orphan")
        .when(errors != "", "invalid")
        .when(F.col("answered").isNull(), "no_result")
        .otherwise("ok")
    )
    json = F.to_json(F.struct(
        parsed.alias("arguments"), F.col("content"),
        F.when(F.size("depends_on") > 0, F.array_sort("depends_on")).alias("depends_on"),
        F.col("call_id").alias("id"), F.col("level"), F.col("name"),
    ))
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return linked.select(
        "conv_id", "call_id", F.when(is_call, F.col("turn")).otherwise(F.col("result_turn")).alias("turn"), F.when(is_call, 1).otherwise(2).alias("part"), "level",
        status.alias("status"), errors.alias("errors"), count("copies"), count("result_copies"), json.alias("json"),
    )


def format_chat(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: list[tuple] = SCHEMAS) -> DataFrame:
    """Rows of whole conversations in order of (conv_id, turn, part, level, call_id): part 0 is a message, 1 a call, 2 a result without its call."""
    text = messages.select(
        "conv_id", "turn", F.lit(0).alias("part"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("call_id"),
        F.lit("message").alias("status"), F.lit("").alias("errors"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("result_copies"),
        F.to_json(F.struct(F.col("text").alias("content"), F.col("role"))).alias("json"),
    )
    return text.unionByName(link_calls(calls, results, schemas))


def derived(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off a chat log: each assistant turn calls a tool, the user turn after it holds the result."""
    c, t = F.col("conv_id"), F.col("turn")
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    size = F.length("text")
    call_id = lambda turn: F.concat(F.lit("call-"), c, F.lit("-"), turn)
    kind = (c + t) % 3
    target = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es", "xx"))), ((c * 3 + t) % 5 + 1).cast("int"))
    words = F.when(c % 4 == 0, F.concat(F.lit('"'), size % 600, F.lit('"'))).otherwise((size % 600).cast("string"))
    arguments = (
        F.when(kind == 0, F.concat(F.lit('{ "query": "'), word, F.lit('", "limit": '), size % 25, F.lit(" }")))
        .when(kind == 1, F.concat(F.lit('{"text": "'), word, F.lit('", "target":"'), target, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"max_words": '), words, F.lit(', "style" : "'), word, F.lit('"}')))
    )
    asked = conversations.where("role = 'assistant'").select(
        "conv_id", call_id(t).alias("call_id"), "turn",
        F.element_at(F.array(*map(F.lit, ("search", "translate", "summarize"))), (kind + 1).cast("int")).alias("name"),
        arguments.alias("arguments"),
        F.when((c % 2 == 0) & (t > 1), F.array(call_id(t - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    answers = conversations.where("role = 'user' AND turn > 0 AND (conv_id * 7 + turn) % 10 <> 0").select(
        "conv_id", call_id(t - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return asked, answers


def digest(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    return format_chat(rows, *derived(rows))


ORACLE = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, regexp_extract(text, '[A-Za-z]+') AS w, length(text) AS n FROM conversations),
a AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS id, (conv_id + turn) % 3 AS k, w, n,
         CASE WHEN conv_id % 2 = 0 AND turn > 1 THEN 'call-' || conv_id || '-' || (turn - 2) END AS dep,
         ['en', 'de', 'fr', 'es', 'xx'][(conv_id * 3 + turn) % 5 + 1] AS target
  FROM m WHERE role = 'assistant'),
lv AS (
  SELECT conv_id, id, 0 AS level FROM a WHERE dep IS NULL OR NOT EXISTS (SELECT 1 FROM a b WHERE b.conv_id = a.conv_id AND b.id = a.dep)
  UNION ALL SELECT a.conv_id, a.id, lv.level + 1 FROM a JOIN lv ON a.conv_id = lv.conv_id AND a.dep = lv.id),
r AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || (turn - 1) AS id, text AS content
  FROM m WHERE role = 'user' AND turn > 0 AND (conv_id * 7 + turn) % 10 <> 0),
e AS (
  SELECT a.*, lv.level,
    CASE k WHEN 0 THEN CASE WHEN n % 25 BETWEEN 1 AND 20 THEN '' ELSE 'range:limit' END
      WHEN 1 THEN CASE WHEN target = 'xx' THEN 'enum:target' ELSE '' END
      ELSE 'extra:style;missing:text' || CASE WHEN conv_id % 4 = 0 THEN ';type:max_words'
        WHEN n % 600 BETWEEN 10 AND 500 THEN '' ELSE ';range:max_words' END END AS errors,
    CASE k WHEN 0 THEN '{"limit":' || (n % 25) || ',"query":"' || w || '"}'
      WHEN 1 THEN '{"target":"' || target || '","text":"' || w || '"}'
      ELSE '{"max_words":' || CASE WHEN conv_id % 4 = 0 THEN '"' || (n % 600) || '"' ELSE '' || (n % 600) END || ',"style":"' || w || '"}' END AS args
  FROM a JOIN lv USING (conv_id, id))
SELECT conv_id, turn, 0 AS part, CAST(NULL AS INTEGER) AS level, CAST(NULL AS VARCHAR) AS call_id, 'message' AS status, '' AS errors, 1 AS copies, 0 AS result_copies,
       '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text) || ',' END || '"role":' || to_json(role) || '}' AS json
FROM m
UNION ALL
SELECT coalesce(e.conv_id, r.conv_id), coalesce(e.turn, r.turn), CASE WHEN e.id IS NULL THEN 2 ELSE 1 END, level, coalesce(e.id, r.id),
       CASE WHEN e.id IS NULL THEN 'orphan' WHEN errors <> '' THEN 'invalid' WHEN r.id IS NULL THEN 'no_result' ELSE 'ok' END,
       coalesce(errors, ''), (e.id IS NOT NULL)::BIGINT, (r.id IS NOT NULL)::BIGINT,
       '{' || CASE WHEN e.id IS NULL THEN '' ELSE '"arguments":' || args || ',' END
       || CASE WHEN content IS NULL THEN '' ELSE '"content":' || to_json(content) || ',' END
       || CASE WHEN dep IS NULL THEN '' ELSE '"depends_on":["' || dep || '"],' END
       || '"id":"' || coalesce(e.id, r.id) || '"'
       || CASE WHEN e.id IS NULL THEN '' ELSE ',"level":' || level || ',"name":"' || ['search', 'translate', 'summarize'][k + 1] || '"' END || '}'
FROM e FULL OUTER JOIN r ON e.conv_id = r.conv_id AND e.id = r.id
"""
