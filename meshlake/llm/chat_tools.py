"""Linking of tool calls and their results in chats, and their canonical JSON.

Only DataFrame and SQL functions are used.

Method
    1. Calls and results are hash-joined by (conversation, identifier), each side first reduced to one row per identifier
       (the earliest turn), so that no identifier multiplies rows. What else carries the identifier is joined to that one row
       and returned with a status of its own.
    2. Order: a result comes after its call, a call after the results that it names in ``after``. Positions start as turns;
       in the end ``position = max(own, predecessor + 1)``. Conversations in which no edge goes against the turns need no
       round. In the others each round hands the positions of nodes without open predecessors on and takes their edges
       away; at the same time an edge from a node with one predecessor is moved to that predecessor (pointer jumping), so a
       chain takes a number of rounds that grows with the logarithm of its length. Calls that wait for several results
       in each step of a chain may take a round a step. Rounds go on until none takes an edge away; what still has an open
       predecessor then is in a cycle or depends on one, and nothing else is. No conversation is gathered in one place:
       positions are keys, not row numbers.
    3. Arguments are parsed as JSON variants and checked against the tool's parameters: unknown tool, no object, missing
       parameter, unexpected parameter, wrong type.
    4. Each message is one JSON object with sorted keys, no white space and arguments in canonical form.

Defined results
    Repeated rows collapse to one. Further calls with an identifier that an earlier call has are ``repeated call``, further
    results ``second result``; they stay at their turn and take no part in links or order. Calls without a result are ``unanswered``, results without a call ``orphan``. Calls in a
    cycle keep their turn as position and are marked ``cyclic``. Rows with a null conversation, turn or identifier are left
    out. What depends on a cycle is marked like it. Null contents are null in the JSON; null or malformed arguments fail validation and appear as null.
    A number of any size without a fraction is an integer, however it is written; beyond 38 digits JSON numbers are doubles.
    Texts of any length are used whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import Scratch

#: A turn counts so many positions, which leaves room for what is moved behind it.
SPREAD = 1 << 20
#: More steps than any chain without a cycle can have.
MOST_STEPS = 1 << 40
#: Types of a parameter, and the variant types that stand for them. Fixed values.
TYPES = {"string": "STRING", "integer": r"(BIGINT|DECIMAL\(\d+,0\))", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT<.*>", "array": "ARRAY<.*>"}


def argument_errors(name: Column, arguments: Column, tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted list of what is wrong with a call. ``tools``: per tool, per parameter its type and whether it is required."""
    parsed = F.try_parse_json(arguments)
    kind = F.schema_of_variant(parsed)
    errors = F.when(F.lit(True), F.array(F.lit("unknown tool")))
    for tool in sorted(tools):
        found = []
        for parameter, (type_name, required) in sorted(tools[tool].items()):
            value = F.try_variant_get(parsed, f"$.{parameter}", "variant")
            absent = value.isNull() | F.is_variant_null(value)
            fits = F.schema_of_variant(value).rlike(f"^{TYPES[type_name]}$")
            if type_name == "integer":
                real = F.try_variant_get(parsed, f"$.{parameter}", "double")
                fits |= (F.schema_of_variant(value) == "DOUBLE") & F.coalesce(real == F.rint(real), F.lit(False))
            wrong = ~fits
            found.append(F.when(absent, F.lit(f"missing {parameter}") if required else F.lit(None)).when(wrong, F.lit(f"wrong type {parameter}")))
        keys = F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*map(F.lit, sorted(tools[tool]))).cast("array<string>"))
        checks = F.array_sort(F.array_compact(F.concat(F.array(*found).cast("array<string>"), F.transform(keys, lambda k: F.concat(F.lit("unexpected "), k)))))
        checks = F.when(parsed.isNull() | ~kind.startswith("OBJECT"), F.array(F.lit("no object"))).otherwise(checks)
        errors = F.when(name == tool, checks).otherwise(errors)
    return errors


def _positions(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes(conv_id, node, position)`` moved behind their predecessors; ``cyclic`` where that has no end."""
    key = ["conv_id", "node"]
    up = nodes.select("conv_id", F.col("node").alias("earlier"), F.col("position").alias("p"))
    edges = edges.join(up, ["conv_id", "earlier"]).join(nodes, key)
    moving = scratch.keep(edges.where("position <= p").select("conv_id").distinct())
    if moving.isEmpty():
        return nodes.withColumn("cyclic", F.lit(False))
    # position >= position of earlier + steps
    links = scratch.keep(edges.join(moving, "conv_id", "left_semi").select(*key, "earlier", F.lit(1).cast("long").alias("steps")).distinct())
    values = scratch.keep(nodes.join(moving, "conv_id", "left_semi"))
    while True:
        before = values.select("conv_id", F.col("node").alias("earlier"), F.col("position").alias("p"))
        open_of = links.groupBy("conv_id", F.col("node").alias("earlier")).agg(F.count("*").alias("n"), F.min("earlier").alias("first"), F.min("steps").alias("more"))
        seen = scratch.keep(links.join(before, ["conv_id", "earlier"]).join(open_of, ["conv_id", "earlier"], "left"))
        if seen.where("n is null").isEmpty():
            break
        moved = seen.where("n is null or n = 1").groupBy(*key).agg(F.max(F.col("p") + F.col("steps")).alias("least"))
        new_values = scratch.keep(values.join(moved, key, "left").select(*key, F.greatest("position", "least").alias("position")))
        # steps of a cycle would double without end
        new_links = seen.where("n is not null").select(
            *key,
            F.when(F.col("n") == 1, F.col("first")).otherwise(F.col("earlier")).alias("earlier"),
            F.when(F.col("n") == 1, F.least(F.col("steps") + F.col("more"), F.lit(MOST_STEPS))).otherwise(F.col("steps")).alias("steps"),
        )
        new_links = scratch.keep(new_links.groupBy(*key, "earlier").agg(F.max("steps").alias("steps")))
        scratch.drop(seen, links, values)
        links, values = new_links, new_values
    cyclic = links.select(*key).distinct().withColumn("cyclic", F.lit(True))
    found = nodes.join(values.withColumnRenamed("position", "moved"), key, "left").join(cyclic, key, "left")
    return found.select(*key, F.when(F.col("cyclic"), F.col("position")).otherwise(F.coalesce("moved", "position")).alias("position"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def link(calls: DataFrame, results: DataFrame, tools: dict, *, max_rounds: int | None = None) -> DataFrame:
    """``conv_id, position, kind, turn, call_id, name, status, errors, json``, one row per call and per result.

    ``calls(conv_id, turn, call_id, name, arguments, after)``: ``arguments`` is JSON text, ``after`` an array of identifiers
    whose results the call uses. ``results(conv_id, turn, call_id, content)``. ``max_rounds`` is accepted from older callers
    and has no effect: ordering goes on until it is done.
    """
    scratch = Scratch(calls.sparkSession, "chat")
    key = ["conv_id", "call_id"]
    some = "conv_id is not null and turn is not null and call_id is not null"
    all_calls = calls.where(some).select(*key, F.struct("turn", "name", "arguments", "after").alias("call")).distinct()
    all_results = results.where(some).select(*key, F.struct("turn", "content").alias("result")).distinct()
    calls, results = all_calls.groupBy(*key).agg(F.min("call").alias("call")), all_results.groupBy(*key).agg(F.min("result").alias("result"))
    both = scratch.keep(calls.join(results, key, "full"))

    nodes = both.select("conv_id", F.explode(F.filter(F.array(
        F.struct(F.concat(F.lit("c:"), "call_id").alias("node"), F.col("call.turn").cast("long").alias("turn")),
        F.struct(F.concat(F.lit("r:"), "call_id").alias("node"), F.col("result.turn").cast("long").alias("turn")),
    ), lambda x: x["turn"].isNotNull())).alias("n")).select("conv_id", "n.node", (F.col("n.turn") * SPREAD).alias("position"))
    answered = both.where("call is not null and result is not null").select("conv_id", F.concat(F.lit("c:"), "call_id").alias("earlier"), F.concat(F.lit("r:"), "call_id").alias("node"))
    used = both.where("call is not null").select("conv_id", F.explode("call.after").alias("e"), "call_id")
    used = used.select("conv_id", F.concat(F.lit("r:"), "e").alias("earlier"), F.concat(F.lit("c:"), "call_id").alias("node"))
    placed = _positions(nodes, answered.unionByName(used), scratch)

    linked = from_calls(both.where("call is not null"), F.when(F.col("result").isNull(), "unanswered").otherwise("linked"), tools)
    linked = linked.unionByName(from_results(both.where("result is not null"), F.when(F.col("call").isNull(), "orphan").otherwise("linked")))
    out = linked.join(placed, ["conv_id", "node"])
    out = out.withColumn("status", F.when(F.col("cyclic"), "cyclic").otherwise(F.col("status")))
    # what shares an identifier with an earlier call or result
    first = both.select(*key, F.col("call").alias("call_1"), F.col("result").alias("result_1"))
    more = from_calls(all_calls.join(first, key).where("call <> call_1"), F.lit("repeated call"), tools)
    also = all_results.join(first, key).where("result <> result_1").select(*key, F.col("call_1").alias("call"), "result")
    more = more.unionByName(from_results(also, F.lit("second result")))
    columns = ["conv_id", "position", "kind", "turn", "call_id", "name", "status", "errors", "json"]
    return out.select(*columns).unionByName(more.withColumn("position", F.col("turn").cast("long") * SPREAD).select(*columns))


def from_calls(rows: DataFrame, status: Column, tools: dict) -> DataFrame:
    """Rows with ``call`` as messages."""
    arguments = F.to_json(F.try_parse_json(F.col("call.arguments")))
    return rows.select(
        "conv_id", "call_id", F.concat(F.lit("c:"), "call_id").alias("node"), F.lit("call").alias("kind"), F.col("call.turn").alias("turn"), F.col("call.name").alias("name"),
        status.alias("status"),
        argument_errors(F.col("call.name"), F.col("call.arguments"), tools).alias("errors"),
        F.concat(F.lit('{"arguments":'), F.coalesce(arguments, F.lit("null")), F.lit(',"call_id":'), _text("call_id"), F.lit(',"name":'), _text("call.name"), F.lit(',"type":"call"}')).alias("json"),
    )


def from_results(rows: DataFrame, status: Column) -> DataFrame:
    """Rows with ``result``, and their ``call`` if there is one, as messages."""
    return rows.select(
        "conv_id", "call_id", F.concat(F.lit("r:"), "call_id").alias("node"), F.lit("result").alias("kind"), F.col("result.turn").alias("turn"), F.col("call.name").alias("name"),
        status.alias("status"),
        F.array().cast("array<string>").alias("errors"),
        F.concat(F.lit('{"call_id":'), _text("call_id"), F.lit(',"content":'), _text("result.content"), F.lit(',"type":"result"}')).alias("json"),
    )


def _text(column: str) -> Column:
    """A string as JSON, null as null."""
    boxed = F.to_json(F.array(F.col(column)))
    return F.substr(boxed, F.lit(2), F.length(boxed) - 2)


def dialogue_calls(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chats of ``(conv_id, turn, role, text)`` as calls and results.

    A user turn is a call of ``reply`` with identifier ``conv_id:turn``, which uses the reply two turns before; any assistant
    turn is the result of the turn before it.
    """
    rows = chats.select("conv_id", "turn", "role", "text")
    identifier = lambda shift: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - shift).cast("string"))
    calls = rows.where("role = 'user'").select(
        "conv_id", "turn", identifier(0).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", F.coalesce("text", F.lit("")).alias("prompt"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(identifier(2))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = rows.where("role = 'assistant'").select("conv_id", "turn", identifier(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
