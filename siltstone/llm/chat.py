"""Chat formatting: tool calls linked to their results, ordered, validated, as canonical JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import Scratch, load, partitions

#: An assistant turn with calls is a JSON object of this form; a result is a turn of role tool with the call's id.
MESSAGE = "content string, tool_calls array<struct<id: string, name: string, arguments: string>>, tool_call_id string"
#: Tools known to the registered query: JSON schemas of their arguments.
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}
#: Halves of surrogate pairs.
SURROGATE = re.compile("[\ud800-\udfff]")
TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; halves of surrogate pairs, which UTF-8 can't hold, are escaped."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def parsed(body: str):
    """The JSON value of a text; ValueError if it is none, or nested too deep, or holds a number that JSON can't write."""

    def refuse(word: str):
        raise ValueError(word)

    try:
        value = json.loads(body, parse_constant=refuse)
        canonical(value)
    except RecursionError:
        raise ValueError("nested too deep") from None
    return value


def references(body: str | None) -> list[str]:
    """Ids of the calls that arguments name as {"$ref": id}, in order, each once. The walk needs no recursion."""
    if not body or "$ref" not in body and "\\u" not in body:
        return []
    try:
        todo, found = [parsed(body)], {}
    except ValueError:
        return []
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            if isinstance(value.get("$ref"), str):
                found[SURROGATE.sub("\ufffd", value["$ref"])] = None
            todo += reversed(value.values())
        elif isinstance(value, list):
            todo += reversed(value)
    return list(found)


def fault(value, schema: Mapping, at: str = "$") -> str | None:
    """The first way in which a value breaks a JSON schema (type or list of types, enum, required, properties, additionalProperties, items); or None."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    if kinds and not any(of_type(value, k) for k in kinds):
        return f"{at}: not of type {' or '.join(kinds)}"
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return f"{at}: not in enum"
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            if name in schema.get("properties", {}):
                if found := fault(value[name], schema["properties"][name], f"{at}.{name}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{at}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := fault(x, schema["items"], f"{at}[{i}]"):
                return found
    return None


def of_type(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, TYPES[kind]) or (kind == "integer" and isinstance(value, float) and value.is_integer())


def format_chats(df: DataFrame, schemas: Mapping[str, Mapping], *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn and per call: conv_id, turn, seq, kind, call_id, status, json.

    kind is message, call or result. Calls are taken out of assistant turns, results are turns of role tool; the n-th call of
    an id in a conversation is hash-joined with the n-th result of that id. seq is a topological order within the
    conversation: a call comes after its turn's message, after the calls that its arguments name as {"$ref": id} (also where
    they stand in a later turn), and before its own result; else by turn. status: ok; unanswered or orphan without a partner; invalid: why
    the arguments break the tool's schema; cyclic where references run in a circle (placed by turn). json is canonical.

    Texts that are no JSON of the form are plain messages; null texts are empty. Arguments that are no JSON, or nested beyond what
    Python can read, or hold NaN or an infinite number, are invalid and stay as text. Rows that repeat a turn stay, in order of
    their text. Null conversations, turns or roles are values like any other (nulls last). Extra columns are ignored. Levels of
    references take a round each; a conversation of any length is numbered by ranges, so it needs no task of its own.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "chat")
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("conv", F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string"))))  # joins on it meet nulls too
    may = F.ltrim("text").startswith("{") & F.col("role").isin("assistant", "tool")
    rows = rows.withColumn("m", F.when(may, F.from_json("text", MESSAGE)))
    is_call, is_result = (F.col("role") == "assistant") & F.coalesce(F.size("m.tool_calls") > 0, F.lit(False)), (F.col("role") == "tool") & F.col("m.tool_call_id").isNotNull()
    rows = rows.withColumns({"is_call": F.coalesce(is_call, F.lit(False)), "is_result": F.coalesce(is_result, F.lit(False))})
    content = F.when(F.col("is_call") | F.col("is_result"), F.coalesce("m.content", F.lit(""))).otherwise(F.col("text"))
    whose = ["conv", "conv_id", "turn"]
    turns = rows.select(*whose, F.lit(0).alias("pos"), F.when(F.col("is_result"), "result").otherwise("message").alias("kind"), F.when(F.col("is_result"), F.col("m.tool_call_id")).alias("call_id"), "role", content.alias("body"), F.lit(None).cast("string").alias("name"))
    calls = rows.where("is_call").select(*whose, F.posexplode("m.tool_calls").alias("pos", "c")).where("c is not null").select(*whose, (F.col("pos") + 1).alias("pos"), F.lit("call").alias("kind"), F.col("c.id").alias("call_id"), F.lit("assistant"), F.coalesce("c.arguments", F.lit("")), "c.name")
    items = turns.union(calls)
    nth = F.row_number().over(Window.partitionBy("conv", "kind", "call_id").orderBy(F.col("turn").asc_nulls_last(), "pos", "body"))
    linked = scratch.keep(items.where("call_id is not null").withColumn("nth", nth), "linked")
    plain = items.where("call_id is null")

    # Links: what must come first. A level is one more than that of all an item waits for; a circle never gets one.
    call, key = linked.where("kind = 'call'"), ["conv", "call_id"]
    pair = call.select(*key, "nth", F.col("turn").alias("c_turn"), F.lit(True).alias("c")).join(linked.where("kind = 'result'").select(*key, "nth", F.lit(True).alias("r")), [*key, "nth"], "full")
    pair = scratch.keep(pair.select(*key, "nth", (F.col("c").isNotNull() & F.col("r").isNotNull()).alias("both"), "c_turn"), "pairs")

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[key].assign(needs=[references(x) for x in b["body"]])

    refs = call.select(*key, "body").mapInPandas(named, "conv string, call_id string, needs array<string>").select(*key, F.explode("needs").alias("needs"))
    edges = scratch.keep(refs.join(call.select("conv", F.col("call_id").alias("needs")), ["conv", "needs"], "left_semi").distinct(), "edges")
    nodes = edges.select(*key).union(edges.select("conv", "needs")).distinct()
    nodes = scratch.keep(nodes.join(call.groupBy(*key).agg(F.min("turn").alias("turn")), key), "nodes")
    settled, k = scratch.keep(nodes.withColumn("level", F.lit(0)).join(edges, key, "left_anti"), "level0"), 0
    while not edges.isEmpty():  # a round for each step of the longest chain of references
        k += 1
        done = settled.select("conv", F.col("call_id").alias("needs"), "level", F.col("turn").alias("after"))
        ready = edges.join(done, ["conv", "needs"], "left").groupBy(*key).agg(F.count_if(F.col("level").isNull()).alias("open"), F.max("level").alias("level"), F.max("after").alias("after")).where("open = 0")
        fresh = ready.join(settled.select(*key), key, "left_anti").join(nodes, key)
        fresh = fresh.select(*key, F.greatest("turn", "after").alias("turn"), (F.col("level") + 1).alias("level"))
        fresh = scratch.keep(fresh, f"level{k}")
        if fresh.isEmpty():
            break
        settled = settled.union(fresh)
    levels = settled.join(edges.select(*key).distinct(), key).select(*key, "level", F.col("turn").alias("l_turn"))
    circles = nodes.join(settled.select(*key), key, "left_anti").select(*key, F.lit(True).alias("cyclic"))

    placed = linked.join(pair, [*key, "nth"], "left").join(levels, key, "left").join(circles, key, "left")
    # A turn that holds dependent calls sorts them by level; a result never stands before its call's turn.
    placed = placed.select(*whose, "pos", "kind", "call_id", "role", "body", "name", "both", F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
                           F.when((F.col("kind") == "result") & (F.col("c_turn") > F.col("turn")), F.col("c_turn")).otherwise(F.greatest("turn", F.when(F.col("kind") == "call", F.col("l_turn")))).alias("at"), F.coalesce("level", F.lit(0)).alias("level"))
    rest = plain.select(*whose, "pos", "kind", "call_id", "role", "body", "name", F.lit(True).alias("both"), F.lit(False).alias("cyclic"), F.col("turn").alias("at"), F.lit(-1).alias("level"))
    kind_rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "call", 1).otherwise(2)
    order = ["conv", F.col("at").asc_nulls_last(), kind_rank, "level", "pos", F.col("turn").asc_nulls_last(), "body", F.col("call_id").asc_nulls_last(), F.col("role").asc_nulls_last()]
    ranged = placed.union(rest).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged = scratch.keep(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ranged")
    before = Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("conv", "_part").agg(F.count(F.lit(1)).alias("n")).select("conv", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    numbered = ranged.withColumn("_seq", F.row_number().over(Window.partitionBy("_part", "conv").orderBy("_row")))
    every = numbered.join(base, ["conv", "_part"]).withColumn("seq", (F.col("_base") + F.col("_seq")).cast("int"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            status, out = [], []
            for kind, call, role, body, name, both, cyclic in zip(b["kind"], b["call_id"], b["role"], b["body"], b["name"], b["both"], b["cyclic"], strict=True):
                state = "ok" if both else "unanswered" if kind == "call" else "orphan"
                if kind == "call":
                    try:
                        arguments = parsed(body or "{}")
                        found = fault(arguments, schemas[name]) if name in schemas else f"unknown tool {name}"
                    except ValueError:
                        arguments, found = body, "arguments are no JSON"
                    state = "cyclic" if cyclic else SURROGATE.sub("\ufffd", f"invalid: {found}") if found else state
                    out.append(canonical({"role": role, "tool_call": {"arguments": arguments, "id": call, "name": name}}))
                elif kind == "result":
                    out.append(canonical({"content": body, "role": role, "tool_call_id": call}))
                else:
                    out.append(canonical({"content": body, "role": role}))
                status.append(state)
            yield b[["conv_id", "turn", "seq", "kind", "call_id"]].assign(status=status, json=out)

    kinds = {f.name: f.dataType.simpleString() for f in every.schema}
    return every.select("conv_id", "turn", "seq", "kind", "call_id", "role", "body", "name", "both", "cyclic").mapInPandas(finish, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, seq int, kind string, call_id string, status string, json string")


def op7_tool_call_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(load(spark, sf_dir, "conversations"), SCHEMAS)
