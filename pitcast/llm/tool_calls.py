"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitcast.llm.common import stage

#: JSON type names of a schema and the value types that satisfy them (beginnings of Spark's names); integers beyond 64 bits are decimals of scale 0.
KINDS = {
    "string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": "BIGINT|DECIMAL|DOUBLE", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT",
}
#: What tells a message apart from plain text that cannot be read as JSON.
MARKS = r'^\s*\{[\s\S]*"(tool_calls|tool_call_id)"'
CALL = ["conv_id", "call_id"]


def calls_of(messages: DataFrame) -> DataFrame:
    """``conv_id, call_id, turn, seq, copies, name, arguments, after`` of every call in the messages.

    A call without an identifier is named by its place; of calls that repeat an identifier in a conversation the first counts.
    """
    body = F.try_parse_json(F.col("text"))
    found = messages.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.posexplode(F.try_variant_get(body, "$.tool_calls", "array<variant>")).alias("seq", "call")
    )
    named = found.select(
        "conv_id",
        F.coalesce(F.try_variant_get("call", "$.id", "string"), F.concat(F.lit("at-"), F.coalesce("turn", F.lit(-1)), F.lit("-"), "seq")).alias("call_id"),
        F.struct("turn", "seq", F.to_json("call").alias("call")).alias("place"),
    )
    first = named.groupBy(*CALL).agg(F.min("place").alias("place"), F.count("*").alias("copies"))
    call = F.parse_json(F.col("place.call"))
    parsed = first.select(
        *CALL, "place.turn", F.col("place.seq").cast("long").alias("seq"), "copies", F.try_variant_get(call, "$.name", "string").alias("name"),
        F.try_variant_get(call, "$.arguments", "variant").alias("arguments"), F.try_variant_get(call, "$.after", "array<string>").alias("after"),
    )
    # arguments come as an object or as its JSON text
    text = F.try_parse_json(F.try_variant_get("arguments", "$", "string"))
    is_text = F.schema_of_variant("arguments") == "STRING"
    return parsed.withColumn("arguments", F.when(is_text, text).otherwise(F.col("arguments")))


def results_of(messages: DataFrame) -> DataFrame:
    """``conv_id, call_id, result_turn, result, n_results`` of every identifier that a message answers; the first answer counts."""
    body = F.try_parse_json(F.col("text"))
    answers = messages.select(
        "conv_id", F.try_variant_get(body, "$.tool_call_id", "string").alias("call_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.to_json(F.try_variant_get(body, "$.content", "variant")).alias("content")).alias("answer"),
    ).where("call_id IS NOT NULL")
    first = answers.groupBy(*CALL).agg(F.min("answer").alias("answer"), F.count("*").alias("n_results"))
    return first.select(*CALL, F.col("answer.turn").alias("result_turn"), F.col("answer.content").alias("result"), "n_results")


def problems(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> Column:
    """Sorted complaints about a call's arguments; ``schemas`` gives type and need of each parameter of each tool."""
    rules = F.create_map(*[x for tool, fields in schemas.items() for x in (F.lit(tool), F.array(*[
        F.struct(F.lit(k).alias("name"), F.lit(kind).alias("kind"), F.lit(need).alias("need")) for k, (kind, need) in fields.items()
    ]))])
    given = F.try_variant_get(arguments, "$", "map<string,variant>")
    rule = F.try_element_at(rules, name)

    def fits(x: Column) -> Column:
        kind = F.schema_of_variant(given[x["name"]])
        return F.coalesce(*[
            F.when(x["kind"] == want, kind.rlike(f"^({names})")) for want, names in KINDS.items()
        ], F.lit(False))

    has = lambda x: F.map_contains_key(given, x["name"])
    missing = F.transform(F.filter(rule, lambda x: x["need"] & ~has(x)), lambda x: F.concat(F.lit("missing "), x["name"]))
    wrong = F.transform(F.filter(rule, lambda x: has(x) & ~fits(x)), lambda x: F.concat(F.lit("type "), x["name"]))
    extra = F.transform(F.array_except(F.map_keys(given), F.transform(rule, lambda x: x["name"])), lambda k: F.concat(F.lit("unexpected "), k))
    return (
        F.when(name.isNull() | rule.isNull(), F.array(F.lit("unknown tool")))
        .when(given.isNull(), F.array(F.lit("malformed arguments")))
        .otherwise(F.array_sort(F.concat(missing, wrong, extra)))
    )


def unreadable(messages: DataFrame) -> DataFrame:
    """``conv_id, call_id, turn, copies, message`` of texts that look like messages and that no parser accepts, as they repeat a key or break off."""
    lost = messages.where(F.col("text").rlike(MARKS) & F.try_parse_json("text").isNull())
    rows = lost.groupBy("conv_id", F.col("turn").cast("long").alias("turn"), "text").agg(F.count("*").alias("copies"))
    named = F.concat_ws("-", F.lit("unreadable"), F.coalesce("turn", F.lit(-1)), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 8))
    return rows.withColumn("call_id", named).select("conv_id", "call_id", "turn", "copies", F.to_json(F.struct(F.col("call_id").alias("id"), "text")).alias("message"))


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: 0 for calls that wait for none, else one more than the latest call they wait for.

    Only references to earlier calls of the conversation count, so there are no cycles. Each round moves levels one
    reference further along the calls that changed; rounds are as many as the longest chain, whatever the number of
    conversations, and a long conversation spreads over tasks by call.
    """
    places = calls.select(*CALL, F.struct("turn", "seq").alias("place"))
    waits = calls.select(*CALL, F.struct("turn", "seq").alias("place"), F.explode("after").alias("cause"))
    edges = stage(
        waits.join(places.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("place").alias("before")), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("cause") == F.col("k")))
        .where("before < place").select(*CALL, "cause").distinct(), "waits",
    )
    known = edges.select(*CALL).distinct().withColumn("level", F.lit(1))
    changed = known = stage(known, "levels")
    while True:
        step = edges.join(changed.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), "level"), edges.conv_id.eqNullSafe(F.col("c")) & (edges.cause == F.col("k")))
        raised = step.groupBy(*CALL).agg((F.max("level") + 1).alias("level"))
        changed = stage(raised, "raised")
        if changed.isEmpty():
            return known
        known = stage(known.unionByName(changed).groupBy(*CALL).agg(F.max("level").alias("level")), "levels")


def link_tool_calls(messages: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> DataFrame:
    """One row per call, unasked result or unreadable message: ``conv_id, call_id, turn, seq, level, name, copies, result_turn, n_results, problems, message``.

    ``messages(conv_id, turn, role, text)`` hold JSON: ``tool_calls`` with ``id, name, arguments, after`` or ``tool_call_id`` with
    ``content``. Calls and results are pre-aggregated by identifier and meet in one hash join. ``level, turn, seq`` is a
    topological order: a call comes after all earlier calls that ``after`` names. ``message`` has sorted keys and no blanks.

    Null, empty and plain texts are no messages. A text with the keys of a message that is no valid JSON, such as one that
    repeats a key, is a row of its own with the problem ``unreadable message`` and its whole text. Repeated rows count in ``copies`` and ``n_results``. References to unknown or
    later calls are ignored for the order. A result without a call has a null ``turn``; a null ``conv_id`` is a conversation of its
    own. Empty tables give no rows, and other columns are ignored.
    """
    calls = stage(calls_of(messages), "calls")
    order = levels(calls).select(F.col("conv_id").alias("o1"), F.col("call_id").alias("o2"), "level")
    results = results_of(messages).select(F.col("conv_id").alias("r1"), F.col("call_id").alias("r2"), "result_turn", "result", "n_results")
    linked = calls.join(results.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("r1")) & (F.col("call_id") == F.col("r2")), "full")
    linked = linked.withColumns({"conv_id": F.coalesce("conv_id", "r1"), "call_id": F.coalesce("call_id", "r2")})
    linked = linked.join(order, F.col("conv_id").eqNullSafe(F.col("o1")) & (F.col("call_id") == F.col("o2")), "left")
    level = F.coalesce("level", F.lit(0)).cast("long")
    message = F.to_json(F.struct(
        "arguments", F.col("call_id").alias("id"), level.alias("level"), "name", F.try_parse_json("result").alias("result"),
    ))
    rows = linked.select(
        "conv_id", "call_id", "turn", "seq", level.alias("level"), "name", F.coalesce("copies", F.lit(0)).alias("copies"), "result_turn",
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(F.col("copies").isNull(), "unasked result").otherwise(F.concat_ws("; ", problems(F.col("name"), F.col("arguments"), schemas))).alias("problems"),
        message.alias("message"),
    )
    lost = unreadable(messages).select(
        "conv_id", "call_id", "turn", F.lit(None).cast("long").alias("seq"), F.lit(0).cast("long").alias("level"), F.lit(None).cast("string").alias("name"), "copies",
        F.lit(None).cast("long").alias("result_turn"), F.lit(0).cast("long").alias("n_results"), F.lit("unreadable message").alias("problems"), "message",
    )
    return rows.unionByName(lost)
