"""Chat formatting with linked tool calls, in DataFrame functions only.

An assistant's message that is a JSON object with `tool_calls` (a list of objects with id, name and arguments, one of
them with an id or a name) holds calls, beside a message where it has `content` too; a tool's message that is a JSON
object with `tool_call_id` and `content` is a result. Results are joined to calls by conversation and identifier, calls
are put in topological order of the results their arguments name ({"$ref": id}), arguments are checked against the
tools' schemas, and every message is written as canonical JSON: keys in order, no white space. All joins are by conversation and identifier, so a conversation of any length is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Tools by name: parameters with (type, required). Types: string, integer, number, boolean, array, object.
TOOLS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "lookup": {"key": ("string", True)},
    "calculate": {"expression": ("string", True)},
}
#: Names that Spark gives the types of JSON values. Integers beyond 64 bits are decimals without a scale.
_TYPES = {"string": "^STRING", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))", "number": "^(BIGINT|DOUBLE|DECIMAL)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT"}
_CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"
_RESULT = "struct<tool_call_id:string,content:string>"


def _holds_calls() -> Column:
    found = F.exists(F.from_json("text", _CALLS)["tool_calls"], lambda c: c["id"].isNotNull() | c["name"].isNotNull())
    return F.coalesce((F.col("role") == "assistant") & F.ltrim("text").startswith("{") & found, F.lit(False))


def _key() -> Column:
    """What tells calls of a conversation apart in their order: identifiers, or else arguments, which set the level."""
    return F.coalesce(F.concat(F.lit("="), "call_id"), F.concat(F.lit("?"), F.coalesce("arguments", F.lit(""))))


def tool_calls(messages: DataFrame) -> DataFrame:
    """conv_id, turn, call_id (null where a call has none), name, arguments (canonical JSON, null where it is no JSON
    object), nth in its message."""
    parsed = F.from_json("text", _CALLS)["tool_calls"]
    calls = messages.where(_holds_calls()).select("conv_id", "turn", F.posexplode(parsed).alias("nth", "c"))
    arguments = F.try_parse_json(F.coalesce("c.arguments", F.lit("{}")))
    canonical = F.when(F.schema_of_variant(arguments).startswith("OBJECT"), F.to_json(arguments))
    return calls.select("conv_id", "turn", "nth", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), canonical.alias("arguments"))


def tool_results(messages: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, content of results."""
    parsed = F.from_json("text", _RESULT)
    results = messages.where((F.col("role") == "tool") & F.ltrim("text").startswith("{")).select("conv_id", "turn", parsed.alias("r"))
    return results.where("r.tool_call_id is not null").select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))


def validated(calls: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """calls with `valid`: the tool is known, arguments are an object with all that is required and nothing unknown or
    of another type. A number without a fraction is an integer however it is written (1.0, 1e3, more than 64 bits), as
    JSON Schema has it. Objects that name a key twice are no arguments."""
    valid = F.lit(False)
    value = F.try_parse_json("arguments")
    keys = F.json_object_keys("arguments")
    for name, parameters in tools.items():
        ok = F.size(F.array_except(keys, F.array(*map(F.lit, parameters)).cast("array<string>"))) == 0
        for key, (kind, required) in parameters.items():
            part = F.variant_get(value, F.lit(f"$['{key}']"), "variant")
            right = F.schema_of_variant(part).rlike(_TYPES[kind])
            if kind == "integer":
                number = F.when(F.schema_of_variant(part) == "DOUBLE", F.try_variant_get(part, "$", "double"))
                right = right | F.coalesce((number == F.floor(number)) | (F.abs(number) > 1e15), F.lit(False))
            ok = ok & (F.coalesce(right, F.lit(False)) if required else F.coalesce(right, ~F.array_contains(keys, key)))
        valid = F.when(F.col("name") == name, ok).otherwise(valid)
    return calls.withColumn("valid", F.col("arguments").isNotNull() & F.coalesce(valid, F.lit(False)))


def _named() -> Column:
    """Identifiers of the calls whose results the arguments name."""
    found = F.regexp_extract_all("arguments", F.lit(r'"\$ref":"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.get_json_object(F.concat(F.lit('{"v":"'), x, F.lit('"}')), "$.v")))


def _chain_ends(one: DataFrame) -> DataFrame:
    """conv_id, key, to, steps from conv_id, key, to of calls that each name one other: where the chain that begins with
    a call leaves these calls, and after how many steps. Calls on a cycle, or that lead to one, are left out. Each round
    doubles the steps that are looked ahead."""
    chains = written(one.select("conv_id", "key", "to", F.lit(1).cast("long").alias("steps")), "chains")
    n, ahead = chains.count(), 1
    while True:
        after = chains.select("conv_id", F.col("key").alias("to"), F.col("to").alias("then"), F.col("steps").alias("more"))
        held = written(chains.join(after, ["conv_id", "to"], "left"), "chains")
        if ahead > n or held.where("then is not null").isEmpty():
            return held.where("then is null").select("conv_id", "key", "to", "steps")
        chains = held.select("conv_id", "key", F.coalesce("then", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        ahead *= 2


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, key, level: 0 for calls that name no other call's result, else one more than the calls they name.

    Calls on a cycle, or that name one, have no level. Chains of calls that name one other each are followed by
    doubling; only calls that name several take a join for each level of theirs.
    """
    one = calls.groupBy("conv_id", _key().alias("key")).agg(F.min_by("arguments", F.struct("turn", "nth")).alias("arguments"))
    needs = one.select("conv_id", "key", F.explode(F.transform(_named(), lambda x: F.concat(F.lit("="), x))).alias("need"))
    known = one.select("conv_id", F.col("key").alias("need"))
    needs = written(needs.join(known, ["conv_id", "need"]), "needs")  # names of calls that there are
    first = one.join(needs.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_anti").select("conv_id", "key", F.lit(0).cast("long").alias("level"))
    if needs.isEmpty():
        return first.withColumn("level", F.col("level").cast("int"))
    first = written(first, "levels")
    counted = needs.groupBy("conv_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("to"))
    ends = written(_chain_ends(counted.where("n = 1")), "ends")
    several = needs.join(counted.where("n > 1").select("conv_id", "key"), ["conv_id", "key"])
    several = several.join(ends.select("conv_id", F.col("key").alias("need"), "to", "steps"), ["conv_id", "need"], "left")
    several = written(several.select("conv_id", "key", F.coalesce("to", "need").alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "needs")
    done = written(first.join(several.select("conv_id", F.col("to").alias("key")).distinct(), ["conv_id", "key"], "left_semi"), "levels")
    total = -1
    while (after := done.count()) != total:
        total = after
        held = several.join(done.withColumnRenamed("key", "to"), ["conv_id", "to"], "left")
        ready = held.groupBy("conv_id", "key").agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        ready = ready.where("open = 0").select("conv_id", "key", "level")
        done = written(done.unionByName(ready.join(done, ["conv_id", "key"], "left_anti")), "levels")
    found = written(first.unionByName(done.join(first, ["conv_id", "key"], "left_anti")), "levels")
    chained = ends.join(found.withColumnRenamed("key", "to"), ["conv_id", "to"]).select("conv_id", "key", (F.col("level") + F.col("steps")).alias("level"))
    return found.unionByName(chained).withColumn("level", F.col("level").cast("int"))


def format_chat(messages: DataFrame, tools: dict[str, dict[str, tuple[str, bool]]] = TOOLS) -> DataFrame:
    """One row for each message, call and result: conv_id, turn, nth, kind, call_id, linked, valid, level, json.

    kind is message, call or result. A message with calls gives a row for each call and, where its content isn't null,
    a message with that content; calls without an identifier have a null call_id and aren't linked. A call is linked when a result names it, a result when a call at an earlier or
    the same turn has its identifier (the first such call, where several share it). A conversation is written by
    ordering its rows by turn, level (null last), nth and kind (messages before calls). Messages that
    look like JSON but don't parse are plain messages; of a key that a message names twice the last one counts, and
    arguments that do so are null; numbers of more than 38 digits are written as doubles; null texts and roles are JSON nulls; rows with a null conversation or turn stay, linked with nothing;
    repeated rows give repeated rows. An empty table gives an empty result.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    calls = validated(tool_calls(rows), tools)
    results = tool_results(rows)
    is_call = _holds_calls()
    is_result = F.coalesce((F.col("role") == "tool") & F.ltrim("text").startswith("{") & F.from_json("text", _RESULT)["tool_call_id"].isNotNull(), F.lit(False))
    content = F.when(is_call, F.from_json("text", _CALLS)["content"]).otherwise(F.col("text"))
    plain = rows.where(~is_result & (~is_call | content.isNotNull())).select(
        "conv_id", "turn", F.lit(0).alias("nth"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("boolean").alias("linked"), F.lit(None).cast("boolean").alias("valid"), F.lit(0).alias("level"),
        F.to_json(F.struct(content.alias("content"), "role", "turn"), {"ignoreNullFields": "false"}).alias("json"),
    )
    answered = results.groupBy("conv_id", "call_id").agg(F.max("turn").alias("last"))
    asked = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("first"), F.min_by("name", F.struct("turn", "nth")).alias("name"))
    canonical = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    member = lambda key, column: F.regexp_extract(F.to_json(F.struct(column.alias(key)), {"ignoreNullFields": "false"}), r"(?s)^\{(.*)\}$", 1)
    out_calls = calls.join(answered, ["conv_id", "call_id"], "left").withColumn("key", _key()).join(levels(calls), ["conv_id", "key"], "left").select(
        "conv_id", "turn", "nth", F.lit("call").alias("kind"), "call_id", F.coalesce(F.col("last") >= F.col("turn"), F.lit(False)).alias("linked"), "valid", "level",
        canonical(F.concat(F.lit('"arguments":'), F.coalesce("arguments", F.lit("null"))), member("id", F.col("call_id")), member("name", F.col("name")), F.lit('"role":"assistant"'), member("turn", F.col("turn"))).alias("json"),
    )
    out_results = results.join(asked, ["conv_id", "call_id"], "left").withColumn("linked", F.coalesce(F.col("first") <= F.col("turn"), F.lit(False))).select(
        "conv_id", "turn", F.lit(0).alias("nth"), F.lit("result").alias("kind"), "call_id", "linked", F.lit(None).cast("boolean").alias("valid"), F.lit(0).alias("level"),
        canonical(member("content", F.col("content")), member("id", F.col("call_id")), member("name", F.when(F.col("linked"), F.col("name"))), F.lit('"role":"tool"'), member("turn", F.col("turn"))).alias("json"),
    )
    return plain.unionByName(out_calls).unionByName(out_results)
