"""Linking tool calls of conversations to their results.

Calls and results are hash-joined by conversation and identifier, calls are put
in topological order of their references, arguments are validated against the
tool's schema, and every call is written as one line of canonical JSON. Turns
that are neither a call nor its result are lines of their own.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm import packed as P
from tidegrid.llm.common import WORD
from tidegrid.session import written

#: Turns that one window of the final order spans.
TURNS = 512
#: Schemas of the tools that ``calls_of`` derives: the JSON Schema words that ``problems`` knows.
TOOLS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 120}}},
    "lookup": {"type": "object", "required": ["query"], "properties": {
        "query": {"type": "string", "maxLength": 60}, "limit": {"type": "integer"}}},
    "measure": {"type": "object", "required": ["limit"], "properties": {"limit": {"type": "integer", "minimum": 20}}},
}
_TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool}
_LINKED = ("conv_id string, call_id string, turn long, name string, position long, level int, "
           "linked boolean, dangling long, copies long, valid boolean, errors string, json string")


def problems(value, schema: dict, path: str = "$") -> list[str]:
    """Where a value breaks a schema: type, enum, bounds, lengths, required, properties, additionalProperties, items."""
    found = []
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind != "boolean")):
        return [f"{path}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{path}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            found.append(f"{path}: below minimum")
        if value > schema.get("maximum", value):
            found.append(f"{path}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{path}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            found.append(f"{path}: too long")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{path}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            found += problems(v, schema["items"], f"{path}[{i}]")
    return found


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and characters as they are; numbers that JSON lacks are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _call_arguments() -> Column:
    text = F.coalesce("text", F.lit(""))
    return F.to_json(F.struct(text.alias("query"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("limit")))


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that plain conversations stand for.

    Every assistant turn is a call, named by its turn, with its whole text as
    arguments and a reference to the assistant turn half way back; the user turn
    that follows answers it. ``other_turns`` has the rest.
    """
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    back = F.col("turn") - 2 * F.ceil(F.col("turn") / 4)
    rows = conversations.select("conv_id", "turn", "role", "text")
    tools = F.array(*map(F.lit, TOOLS))
    calls = rows.filter("role = 'assistant'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn",
        F.get(tools, F.pmod(F.col("turn"), F.lit(len(TOOLS))).cast("int")).alias("name"), _call_arguments().alias("arguments"),
        F.when(back >= 0, F.array(name(back))).otherwise(F.array().cast("array<string>")).alias("refers"))
    results = rows.filter("role = 'user'").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def _told(rows):
    for row in rows:
        cols = {c: row.column(c) for c in row.schema.names}
        texts = [canonical({"role": role, "text": text, "turn": turn}) for role, text, turn in zip(
            *(cols[c].to_pylist() for c in ("role", "text", "turn")), strict=True)]
        none = lambda kind, n=len(texts): pa.nulls(n, kind)
        yield P.record(conv_id=cols["conv_id"], call_id=none(pa.string()), turn=cols["turn"], name=none(pa.string()),
                       position=none(pa.int64()), level=none(pa.int32()), linked=pa.array([False] * len(texts), pa.bool_()),
                       dangling=pa.array([0] * len(texts), pa.int64()), copies=cols["copies"], valid=none(pa.bool_()),
                       errors=none(pa.string()), json=pa.array(texts, pa.string()))


def other_turns(conversations: DataFrame) -> DataFrame:
    """One row for each turn that ``link_calls`` over ``calls_of`` doesn't show, in its columns.

    These are system and opening user turns, other roles, user turns that answer
    no call, turns without a number, and of several texts for one turn those that
    were not taken. They have no identifier, name, position, level or verdict;
    the JSON holds role, text and turn. Equal rows are one, with ``copies``.
    """
    said = written(conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        "role", "text").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")))
    one = said.filter("turn is not null").groupBy("conv_id", "turn").agg(
        F.min(F.when(F.col("role") == "assistant", _call_arguments())).alias("__call"),
        F.min(F.when(F.col("role") == "user", F.struct("text"))).alias("__answer"))
    asked = one.filter("__call is not null").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("__asked"))
    called = (F.col("role") == "assistant") & (_call_arguments() == F.col("__call"))
    answer = (F.col("role") == "user") & F.col("__asked") & F.col("text").eqNullSafe(F.col("__answer.text"))
    rest = said.join(one.join(asked, ["conv_id", "turn"], "left"), ["conv_id", "turn"], "left").filter(
        ~F.coalesce(called, F.lit(False)) & ~F.coalesce(answer, F.lit(False)))
    return rest.select("conv_id", "turn", "role", "text", "copies").mapInArrow(_told, _LINKED)


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and level (longest chain of references below it; -1 on or behind a cycle) of calls that refer.

    ``calls`` has one row for each call. A round drops the references to calls
    that have none left; the number of rounds is the longest chain.
    """
    known = calls.select("conv_id", F.col("call_id").alias("parent"))
    edges = written(calls.select("conv_id", "call_id", F.explode(F.array_distinct("refers")).alias("parent"))
                    .join(known, ["conv_id", "parent"]).select("conv_id", "call_id", "parent"))
    n, level, seen = edges.count(), 1, None
    while n:
        active = edges.select("conv_id", F.col("call_id").alias("parent")).distinct()
        rest = written(edges.join(active, ["conv_id", "parent"], "left_semi").select("conv_id", "call_id", "parent"))
        left = rest.count()
        now = edges.select("conv_id", "call_id", F.lit(level).alias("level"))
        if left == n:  # nothing was free: only cycles and what hangs on them
            now, left = now.withColumn("level", F.lit(-1)), 0
        seen = now if seen is None else seen.union(now)
        edges, n, level = rest, left, level + 1
    if seen is None:
        return calls.select("conv_id", "call_id", F.lit(0).alias("level")).limit(0)
    return seen.groupBy("conv_id", "call_id").agg(
        F.when(F.min("level") < 0, F.lit(-1)).otherwise(F.max("level")).alias("level"))


def _first(rows: DataFrame, payload: list[str]) -> DataFrame:
    """One row for each (conv_id, call_id): the earliest turn, then the smallest payload; ``copies`` counts them."""
    one = F.min(F.struct("turn", *payload)).alias("one")
    return rows.filter("call_id is not null").groupBy("conv_id", "call_id").agg(one, F.count("*").alias("copies")).select(
        "conv_id", "call_id", "copies", "one.*")


def _serialised(schemas: dict):
    def serialise(rows):
        for row in rows:
            cols = {c: row.column(c).to_pylist() for c in row.schema.names}
            texts, errors = [], []
            for call_id, name, raw, refers, linked, content in zip(*(
                    cols[c] for c in ("call_id", "name", "arguments", "refers", "linked", "content")), strict=True):
                try:
                    value = json.loads(raw) if raw is not None else None
                    found = problems(value, schemas[name]) if name in schemas else ["$: unknown tool"]
                    text = canonical({"arguments": value, "id": call_id, "name": name, "refers": sorted(refers or []),
                                      "result": content if linked else None})
                except ValueError:
                    found = ["$: not JSON"]
                    text = canonical({"arguments": raw, "id": call_id, "name": name, "refers": sorted(refers or []),
                                      "result": content if linked else None})
                texts.append(text)
                errors.append("; ".join(found))
            keep = [c for c in ("conv_id", "call_id", "turn", "name", "position", "level", "linked", "dangling", "copies")]
            yield P.record(**{c: row.column(c) for c in keep},
                           valid=pa.array([not e for e in errors], pa.bool_()), errors=pa.array(errors, pa.string()),
                           json=pa.array(texts, pa.string()))

    return serialise


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = TOOLS) -> DataFrame:
    """One row for each call: its position in its conversation, its result if any, verdict and JSON.

    Positions count from 0 by level, then turn, then identifier; calls on
    cycles come last with level -1. Of calls or results with an equal
    identifier the earliest counts (``copies`` of the call are counted); rows
    without an identifier are left out; a null conversation is one like any
    other. References to calls that are not there are ``dangling`` and don't
    order. Null arguments are null JSON; text that isn't JSON is kept as a string
    and invalid. Empty tables give none; other columns are not read.
    """
    rows = written(_first(calls.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))),
                          ["name", "arguments", "refers"]))
    answers = _first(results.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), ["content"]).select(
        "conv_id", "call_id", "content", F.lit(True).alias("linked"))
    known = rows.select("conv_id", F.col("call_id").alias("parent"))
    dangling = (rows.select("conv_id", "call_id", F.explode(F.array_distinct("refers")).alias("parent"))
                .join(known, ["conv_id", "parent"], "left_anti").groupBy("conv_id", "call_id")
                .agg(F.count("*").alias("dangling")))
    placed = (rows.join(levels(rows), ["conv_id", "call_id"], "left").join(dangling, ["conv_id", "call_id"], "left")
              .withColumn("level", F.coalesce("level", F.lit(0))).withColumn("dangling", F.coalesce("dangling", F.lit(0)))
              .withColumn("__last", F.col("level") < 0).withColumn("__part", F.floor(F.col("turn") / TURNS)))
    placed = written(placed)
    cell = ["conv_id", "__last", "level", "__part"]
    before = Window.partitionBy("conv_id").orderBy("__last", "level", "__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy(*cell).agg(F.count("*").alias("__n")).select(
        *cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    placed = placed.withColumn("__rank", F.row_number().over(Window.partitionBy(*cell).orderBy("turn", "call_id")) - 1)
    same = [placed[c].eqNullSafe(firsts[c]) for c in cell]
    ordered = placed.join(firsts, same).select(placed["*"], (F.col("__first") + F.col("__rank")).alias("position"))
    joined = ordered.join(answers, ["conv_id", "call_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    return joined.select("conv_id", "call_id", "turn", "name", "arguments", "refers", "position", "level", "linked",
                         "content", "dangling", "copies").mapInArrow(_serialised(schemas), _LINKED)
