"""Linking tool calls of conversations to their results.

Calls and results are joined by identifier. A call may wait for one other call (``after``), which
makes the calls a forest; its depth there, found by pointer doubling, orders the calls
topologically: sorted by (depth, turn, call_id), every call follows the one it waits for. Rounds
grow with the logarithm of the longest chain, and no conversation is ever gathered, so a
conversation of any length does no harm. Arguments are checked against the tool's schema and each
linked call is written as canonical JSON: sorted keys, no blanks, no escapes but the needed ones,
numbers as Python writes them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import stored

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def problems(arguments: Any, schema: Mapping[str, Any] | None) -> list[str]:
    """What is wrong with the arguments, by name: kind, presence, range, length, enumeration."""
    if schema is None:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    found = [f"{n}: missing" for n in schema.get("required", ()) if n not in arguments]
    rules = schema.get("properties", {})
    for name, value in arguments.items():
        rule = rules.get(name)
        if rule is None:
            found.append(f"{name}: unknown")
        elif not isinstance(value, KINDS[rule["type"]]) or isinstance(value, bool) and rule["type"] != "boolean":
            found.append(f"{name}: not of type {rule['type']}")
        elif "enum" in rule and value not in rule["enum"]:
            found.append(f"{name}: not allowed")
        elif "maximum" in rule and value > rule["maximum"]:
            found.append(f"{name}: too large")
        elif "minimum" in rule and value < rule["minimum"]:
            found.append(f"{name}: too small")
        elif "minLength" in rule and len(value) < rule["minLength"]:
            found.append(f"{name}: too short")
    return sorted(found)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _finite(digits: str) -> float:
    value = float(digits)
    if math.isinf(value):
        raise OverflowError(digits)
    return value


def _parsed(arguments: str | None) -> tuple[Any, list[str]]:
    """The value, and why it cannot be written: numbers beyond a double and half characters are legal JSON."""
    try:
        value = json.loads(arguments or "", parse_constant=_no_constant, parse_float=_finite)
        canonical(value).encode()
        return value, []
    except OverflowError:
        return None, ["a number is out of range"]
    except UnicodeEncodeError:
        return None, ["a string is no Unicode text"]
    except (ValueError, RecursionError):
        return None, ["arguments are no JSON"]


def depths(calls: DataFrame) -> DataFrame:
    """(call_id, depth) from (call_id, after), ids once each; null on and behind a circle.

    ``after`` counts only if it is the id of a call. Every round doubles the stretch a pointer
    spans: a call's pointer moves to where the call it points at points.
    """
    known = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("_known"))
    state = stored(calls.join(known, "after", "left").select(
        "call_id", F.when(F.col("_known"), F.col("after")).alias("up"),
        F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("depth")))
    total, span = state.count(), 1
    while span <= total and not state.where("up IS NOT NULL").isEmpty():
        ahead = state.select(F.col("call_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        moved = state.where("up IS NOT NULL").join(ahead, "up").select(
            "call_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"))
        state = stored(state.where("up IS NULL").unionAll(moved))
        span *= 2
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def linked_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """(conv_id, turn, call_id, depth, status, errors, json) of every call, and of results without one.

    ``calls`` has conv_id, turn, call_id, name, arguments (JSON) and after; ``results`` has
    conv_id, turn, call_id and content; both perhaps more. ``schemas`` holds a JSON-schema-like
    object per tool. Status is the first that fits: ``orphan`` (a result without a call, with
    depth null), ``cycle``, ``invalid`` (errors in the arguments), ``pending`` (no result),
    ``linked``. Of repeated ids the smallest call by (conv_id, turn, name, arguments, after) and
    the smallest result by (conv_id, turn, content) count. Rows with a null id are left out: they
    can be linked to nothing. Null arguments are no JSON, a null content is kept as null.
    Empty tables give what the other one gives.
    """
    call = F.struct("conv_id", "turn", "name", "arguments", "after")
    answer = F.struct("conv_id", "turn", "content")
    first = stored(calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(call).alias("c")).select("call_id", "c.*"))
    answers = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(answer).alias("r"))
    placed = first.join(depths(first.select("call_id", "after")), "call_id").withColumn("has_call", F.lit(True))
    both = placed.join(answers, "call_id", "full_outer").select(
        F.coalesce("conv_id", "r.conv_id").alias("conv_id"), F.coalesce("turn", "r.turn").alias("turn"), "call_id",
        "depth", "name", "arguments", "after", "has_call", F.isnotnull("r").alias("has_result"), F.col("r.content").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, errors, texts = [], [], []
            for row in batch.to_pylist():
                wrong: list[str] = []
                line = {"call": row["call_id"], "conversation": row["conv_id"]}
                if row["has_call"]:
                    arguments, wrong = _parsed(row["arguments"])
                    wrong = wrong or problems(arguments, schemas.get(row["name"]))
                    line |= {"after": row["after"], "arguments": arguments, "depth": row["depth"], "name": row["name"]}
                if row["has_result"]:
                    line["result"] = row["content"]
                status.append("orphan" if not row["has_call"] else "cycle" if row["depth"] is None else "invalid" if wrong
                              else "linked" if row["has_result"] else "pending")
                errors.append(wrong)
                texts.append(canonical(line | {"errors": wrong}))
            kept = [batch.column(c) for c in ("conv_id", "turn", "call_id", "depth")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(status, pa.string()), pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())],
                ["conv_id", "turn", "call_id", "depth", "status", "errors", "json"])

    return both.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")}).mapInArrow(
        run, "conv_id long, turn long, call_id string, depth long, status string, errors array<string>, json string")
