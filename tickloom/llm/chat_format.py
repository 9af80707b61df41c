"""Chat formatting with linked tool calls, in DataFrame functions only.

A message whose text is a JSON object may hold ``tool_calls`` (objects with id, name, arguments and depends_on, a list of ids; name and
arguments may be nested under ``function``), ``content`` beside them, and, as a result, ``tool_call_id`` and ``content``; it may be both. Calls and results are hash-joined by conversation and id. Calls get a
level: 0 without dependencies, else one more than the highest among them; levels grow by joins until nothing changes, and calls on a
cycle, or behind a missing call, have none. Arguments are checked against schemas. Each message, call and result becomes one row of canonical JSON (keys sorted, no
white space; arguments that are no JSON stay as given, with a fault), with the columns that order a conversation: anchor (the turn of the call, for a result), level, part (0 message or call, 1 result), turn, position.
The content of a message with calls is a message row of position -1, before its calls; that of a result is in the result's row.
Rows stay apart, so a conversation of any length is never gathered.

Text that is null: content is null. Text that is no such object: a plain message. Of calls that repeat an id in a conversation, the first by turn and
position is linked, others have the status ``repeated``; of results all are kept. A result without a call: ``orphan``; a call without a result: ``open``.
Null ids of conversations join nothing. Repeated rows give repeated rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: name -> argument -> (JSON type, required)
SCHEMAS: Mapping[str, Mapping[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
    "fetch": {"url": ("string", True), "headers": ("object", False)},
}
_SHAPE = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,function:string,depends_on:array<string>>>,tool_call_id:string,content:string>"


def canonical(text: Column | str) -> Column:
    """JSON with sorted keys and without white space; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def _faults(schemas: Mapping[str, Mapping[str, tuple[str, bool]]], name: Column, arguments: Column) -> Column:
    """What is wrong with arguments: unknown tool, no object, a missing, unknown or mistyped argument; null if nothing."""
    kind = "map<string,array<struct<arg:string,type:string,required:boolean>>>"
    table = F.from_json(F.lit(json.dumps({n: [{"arg": a, "type": t, "required": r} for a, (t, r) in s.items()] for n, s in schemas.items()})), kind)
    wanted, given = F.try_element_at(table, name), F.try_parse_json(arguments)
    keys = F.when(F.schema_of_variant(given).startswith("OBJECT"), F.json_object_keys(arguments))
    value = lambda a: F.try_variant_get(given, F.concat(F.lit("$['"), a, F.lit("']")), "variant")
    shown = lambda a: F.schema_of_variant(value(a))
    fits = lambda s: ((s["type"] == "any") | ((s["type"] == "string") & (shown(s["arg"]) == "STRING")) | ((s["type"] == "integer") & (shown(s["arg"]) == "BIGINT")) | ((s["type"] == "number") & shown(s["arg"]).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")) | ((s["type"] == "boolean") & (shown(s["arg"]) == "BOOLEAN")) | ((s["type"] == "array") & shown(s["arg"]).startswith("ARRAY")) | ((s["type"] == "object") & shown(s["arg"]).startswith("OBJECT")))
    names = lambda x: F.transform(x, lambda s: s["arg"])
    missing = names(F.filter(wanted, lambda s: s["required"] & ~F.array_contains(keys, s["arg"])))
    wrong = names(F.filter(wanted, lambda s: F.array_contains(keys, s["arg"]) & ~F.coalesce(fits(s), F.lit(False))))
    unknown = F.array_except(keys, names(wanted))
    said = lambda what, x: F.transform(x, lambda a: F.concat(F.lit(f"{what} "), a))
    return F.when(wanted.isNull(), F.lit("unknown tool")).when(keys.isNull(), F.lit("no object")).otherwise(F.nullif(F.array_join(F.sort_array(F.concat(said("missing", missing), said("mistyped", wrong), said("unknown", unknown))), ", "), F.lit("")))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls that no cycle or missing call holds back."""
    edges = calls.select("conv_id", "call_id", F.explode("depends_on").alias("on")).where("`on` is not null").distinct()
    done = calls.where("size(depends_on) = 0 or depends_on is null").select("conv_id", "call_id", F.lit(0).alias("level"))
    waiting = edges
    if waiting.isEmpty():
        return done
    needs = cut(edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("needs")))
    level = 0
    while True:  # once round for each level of the longest chain
        level += 1
        met = edges.join(done.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"]).groupBy("conv_id", "call_id").agg(F.count("*").alias("met"))
        fresh = needs.join(met, ["conv_id", "call_id"]).where("needs = met").join(done, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(level).alias("level"))
        fresh = cut(fresh)
        if fresh.isEmpty():
            return done
        done = cut(done.union(fresh))


def format_chats(messages: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """(conv_id, turn, position, role, kind, call_id, status, fault, anchor, level, part, json)."""
    parsed = messages.select("conv_id", "turn", "role", "text", F.when(F.col("text").rlike(r"^\s*\{"), F.from_json("text", _SHAPE)).alias("p"))
    is_call, is_result = F.coalesce(F.size("p.tool_calls") > 0, F.lit(False)), F.col("p.tool_call_id").isNotNull()
    none = lambda kind: F.lit(None).cast(kind)
    plain = parsed.where(~is_call & ~is_result).select("conv_id", "turn", F.lit(0).alias("position"), "role", F.lit("message").alias("kind"), none("string").alias("call_id"), none("string").alias("status"), none("string").alias("fault"), F.col("turn").alias("anchor"), F.lit(0).alias("level"), F.lit(0).alias("part"), F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"}).alias("json"))
    tool = parsed.where(is_call | is_result)
    if tool.isEmpty():
        return plain
    said = tool.where(is_call & ~is_result & F.col("p.content").isNotNull()).select("conv_id", "turn", F.lit(-1).alias("position"), "role", F.lit("message").alias("kind"), none("string").alias("call_id"), none("string").alias("status"), none("string").alias("fault"), F.col("turn").alias("anchor"), F.lit(0).alias("level"), F.lit(0).alias("part"), F.to_json(F.struct(F.col("p.content").alias("content"), "role"), {"ignoreNullFields": "false"}).alias("json"))
    nested = lambda field: F.coalesce(F.col(f"c.{field}"), F.get_json_object("c.function", f"$.{field}"))
    calls = tool.where(is_call).select("conv_id", "turn", "role", F.posexplode("p.tool_calls").alias("position", "c")).select("conv_id", "turn", "role", "position", F.col("c.id").alias("call_id"), nested("name").alias("name"), nested("arguments").alias("arguments"), F.array_distinct("c.depends_on").alias("depends_on"))
    firsts = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "position", "depends_on")).alias("f")).select("conv_id", "call_id", F.col("f.turn").alias("first_turn"), F.col("f.position").alias("first_position"), F.col("f.depends_on").alias("depends_on"))
    firsts = cut(firsts.join(_levels(firsts), ["conv_id", "call_id"], "left"))
    results = tool.where(is_result).select("conv_id", "turn", "role", F.col("p.tool_call_id").alias("call_id"), F.col("p.content").alias("content"))
    answered = results.select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))
    linked = calls.drop("depends_on").join(firsts, ["conv_id", "call_id"], "left").join(answered.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    status = F.when(F.col("call_id").isNull(), "open").when((F.col("turn") != F.col("first_turn")) | (F.col("position") != F.col("first_position")), "repeated").when(F.col("answered"), "linked").otherwise("open")
    call_json = F.to_json(F.struct(F.coalesce(canonical("arguments"), "arguments", F.lit("null")).alias("arguments"), F.col("call_id").alias("id"), "name", "role"), {"ignoreNullFields": "false"})
    call_rows = linked.select("conv_id", "turn", "position", "role", F.lit("call").alias("kind"), "call_id", status.alias("status"), _faults(schemas, F.col("name"), F.col("arguments")).alias("fault"), F.col("turn").alias("anchor"), "level", F.lit(0).alias("part"), call_json.alias("json"))
    found = results.join(firsts.drop("depends_on").hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    result_rows = found.select("conv_id", "turn", F.coalesce("first_position", F.lit(0)).alias("position"), "role", F.lit("result").alias("kind"), "call_id", F.when(F.col("first_turn").isNull(), "orphan").otherwise("linked").alias("status"), none("string").alias("fault"), F.coalesce("first_turn", "turn").alias("anchor"), "level", F.lit(1).alias("part"), F.to_json(F.struct("content", F.col("call_id").alias("id"), "role"), {"ignoreNullFields": "false"}).alias("json"))
    return plain.unionByName(said).unionByName(call_rows).unionByName(result_rows)
