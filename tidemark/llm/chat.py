"""Chat formatting with tool-call linking.

A message is a call message if its text is a JSON object with a list `tool_calls` of {id, name, arguments}; a message of role `tool` is
a result if its text is an object with `tool_call_id`. Calls and results meet in a hash join by conversation and identifier. Order
follows from keys, not from collected conversations: a message stands at its turn, its calls behind it, and a linked result behind the
calls of the message that asked for it, which is a topological order of message, call and result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: Schemas of known tools, as a parameter's default; a call to another tool is invalid.
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}
_LONE = re.compile("[\ud800-\udfff]")
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    """JSON with sorted keys and no white space, in plain UTF-8, or with escapes where a lone surrogate has none."""
    plain = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False) if _LONE.search(plain) else plain


def _is(value: object, kind: object) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or value == math.floor(value))
    return kind in _KINDS and isinstance(value, _KINDS[kind])


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What in a value breaks a schema: type (a name or a list of names; an unknown name fits nothing), enum, required, properties,
    additionalProperties, items."""
    out, kinds = [], schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds if isinstance(kinds, list) else []
    if kinds and not any(_is(value, kind) for kind in kinds):
        return [f"{at}: not of type {' or '.join(map(str, kinds))}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the allowed values")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        out += [p for i, v in enumerate(value) for p in problems(v, schema["items"], f"{at}[{i}]")]
    return out


def _number(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError("beyond a double")
    return value


def _loads(text: str | None) -> object:
    """A JSON object; None for all else, numbers beyond a double and words like NaN among them."""
    try:
        return json.loads(text, parse_constant=_number, parse_float=_number) if text and text.lstrip()[:1] == "{" else None
    except (ValueError, RecursionError):
        return None


def _name(value: object) -> str | None:
    """An identifier: a text that is not empty and has a form in UTF-8."""
    return value if isinstance(value, str) and value and not _LONE.search(value) else None


def parts(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[tuple[int, str, str | None, str, str]]:
    """(part, kind, call id, errors, canonical JSON) of a message: the message itself is part 0, its calls follow."""
    role = role or "unknown"
    try:
        return _parts(role, _loads(text), text, schemas)
    except RecursionError:  # nested deeper than can be written again: a text like any other
        return [(0, "message", None, "", canonical({"role": role, "content": text}))]


def _parts(role: str, value: object, text: str | None, schemas: dict[str, dict]) -> list[tuple[int, str, str | None, str, str]]:
    if role == "tool" and isinstance(value, dict) and _name(value.get("tool_call_id")):
        return [(0, "result", value["tool_call_id"], "", canonical({"role": role, "tool_call_id": value["tool_call_id"], "content": value.get("content")}))]
    calls = value.get("tool_calls") if isinstance(value, dict) else None
    if not isinstance(calls, list):
        return [(0, "message", None, "", canonical({"role": role, "content": text}))]
    out = [(0, "message", None, "", canonical({"role": role, "content": value.get("content")}))]
    for i, call in enumerate(calls, 1):
        call = call if isinstance(call, dict) else {}
        name, given = call.get("name"), call.get("arguments")
        arguments = _loads(given) if isinstance(given, str) else given
        wrong = problems(arguments, schemas[name]) if isinstance(name, str) and name in schemas else ["unknown tool"]
        own = _name(call.get("id"))
        wrong += [] if own else ["no identifier"]
        wrong = "; ".join(wrong).encode("utf-8", "backslashreplace").decode()
        out.append((i, "call", own, wrong, canonical({"type": "tool_call", "id": own, "name": name, "arguments": arguments if arguments is not None else given})))
    return out


def link(messages: DataFrame, schemas: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a part of a message: conv_id, turn, part, kind, call_id, status, at_turn, at_stage, at_part, line (canonical JSON).

    Ordered by (at_turn, at_stage, at_part, turn), the lines of a conversation are its canonical JSON lines. status: ok; invalid: with
    the reasons; unanswered and orphan for calls without a result and results without a call; duplicate for calls whose identifier an
    earlier call of the conversation has. Null texts are null contents, null roles `unknown`; null conversations link nothing; repeated
    rows come back as often as they are given. A text that is no JSON object, or holds NaN, infinities or numbers beyond a double, is a
    plain message; arguments given as such a text are a text. Identifiers that are empty, no texts or without a form in UTF-8 count as
    none: their calls are invalid, their results plain messages. A conversation of any length is never gathered.
    """
    known = SCHEMAS if schemas is None else schemas
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    names = ["part", "kind", "call_id", "errors", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = [parts(r, t, known) for r, t in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True)]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [x for f in found for x in f]
            columns = [pa.array([x[j] for x in flat], pa.int32() if j == 0 else pa.string()) for j in range(5)]
            yield pa.RecordBatch.from_arrays([piece.column(0).take(at), piece.column(1).take(at), *columns], ["conv_id", "turn", *names])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    cut = rows.mapInArrow(run, f"conv_id {kinds[0]}, turn {kinds[1]}, part int, kind string, call_id string, errors string, line string")
    cut = written(cut)
    key = ["conv_id", "call_id"]
    calls = cut.where("kind = 'call' and call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "part")).alias("first"))
    answers = cut.where("kind = 'result'").groupBy(*key).agg(F.count("*").alias("answers"))
    plain = cut.where("kind = 'message' or call_id is null").withColumn("first", F.lit(None).cast(calls.schema["first"].dataType)).withColumn("answers", F.lit(None).cast("long"))
    linked = cut.where("kind <> 'message' and call_id is not null").join(calls, key, "left").join(answers, key, "left")
    every = plain.unionByName(linked.select(plain.columns))
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    status = (
        F.when(call & (F.col("errors") != ""), F.concat(F.lit("invalid: "), F.col("errors")))
        .when(call & ((F.col("first.turn") != F.col("turn")) | (F.col("first.part") != F.col("part"))), "duplicate")
        .when(call & F.col("answers").isNull(), "unanswered")
        .when(result & F.col("first").isNull(), "orphan")
        .otherwise("ok")
    )
    placed = result & F.col("first").isNotNull()
    return every.select(
        "conv_id", "turn", "part", "kind", "call_id", status.alias("status"), F.when(placed, F.col("first.turn")).otherwise(F.col("turn")).alias("at_turn"),
        F.when(placed, 2).when(call, 1).otherwise(0).alias("at_stage"), F.when(placed, F.col("first.part")).otherwise(F.col("part")).alias("at_part"), "line",
    )
