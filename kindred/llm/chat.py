"""Chat formatting: tool calls and results linked by identifier, ordered, validated, and serialised as canonical JSON.

Linking is a hash join on (conversation, identifier), both sides brought to one row for each identifier first. The order is
topological: a call's level is the longest chain of calls that it comes after. Chains of single predecessors are cut
short by doubling, so a conversation of any length takes a logarithmic number of joins; only calls with several predecessors
wait for each other in rounds. No conversation is ever gathered in one task. Arguments are checked against JSON schemas and lines
written row by row in Python.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import ship, table

#: The tool that a conversation without calls of its own is taken to call: every user turn asks it for a reply.
REPLY = {
    "type": "object",
    "required": ["text", "turn"],
    "additionalProperties": False,
    "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
}
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def number(v: float) -> str:
    """A finite double as ECMAScript writes it: the shortest digits that read back as the same, with an exponent from 1e21 and below 1e-6."""
    if not math.isfinite(v):
        raise ValueError("not a JSON number")
    if v == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(v)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exponent  # the value is 0.text times ten to the power of point
    n = len(text)
    if n <= point <= 21:
        out = text + "0" * (point - n)
    elif 0 < point <= 21:
        out = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text[0] + (f".{text[1:]}" if n > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + out


def canonical(x) -> str:
    """JSON in the canonical form of RFC 8785: no spaces, keys in order of UTF-16, characters as they are, numbers as ECMAScript
    writes them; but integers keep all their digits. Raises ValueError for what that form can't hold: numbers that aren't
    finite, and strings that aren't Unicode (lone surrogates)."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(x[k])}" for k in sorted(x, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(canonical, x)) + "]"
    if isinstance(x, float):
        return number(x)
    if isinstance(x, str):
        x.encode()
    return json.dumps(x, ensure_ascii=False)


def _of_type(x, t: str) -> bool:
    if t == "integer":
        return isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer()
    if t == "number":
        return isinstance(x, int | float) and not isinstance(x, bool)
    return isinstance(x, TYPES[t])


def faults(x, schema: dict, at: str = "") -> list[str]:
    """What is wrong with ``x`` by a JSON schema (type, enum, required, properties, additionalProperties, items, bounds of numbers,
    lengths and strings' pattern)."""
    t = schema.get("type")
    if t is not None and not any(_of_type(x, k) for k in ([t] if isinstance(t, str) else t)):
        return [f"{at or '/'}: not of type {t}"]
    out = []
    if "enum" in schema and x not in schema["enum"]:
        out.append(f"{at or '/'}: not in enum")
    if isinstance(x, dict):
        known = schema.get("properties", {})
        out += [f"{at}/{k}: required" for k in schema.get("required", ()) if k not in x]
        for k in sorted(x):
            if k in known:
                out += faults(x[k], known[k], f"{at}/{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}/{k}: not allowed")
    elif isinstance(x, list):
        for i, y in enumerate(x if "items" in schema else ()):
            out += faults(y, schema["items"], f"{at}/{i}")
        size = len(x)
        out += [f"{at or '/'}: {k}" for k, bad in (("minItems", size < schema.get("minItems", 0)), ("maxItems", size > schema.get("maxItems", size))) if bad]
    elif isinstance(x, str):
        size = len(x)
        out += [f"{at or '/'}: {k}" for k, bad in (("minLength", size < schema.get("minLength", 0)), ("maxLength", size > schema.get("maxLength", size))) if bad]
        if "pattern" in schema and not re.search(schema["pattern"], x):
            out.append(f"{at or '/'}: pattern")
    elif isinstance(x, int | float) and not isinstance(x, bool):
        out += [f"{at or '/'}: {k}" for k, bad in (("minimum", x < schema.get("minimum", x)), ("maximum", x > schema.get("maximum", x))) if bad]
    return out


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) from (conv_id, call_id, after array<string>): one row for each call, level null on a cycle or behind one.

    A call comes after the calls of its conversation that ``after`` names; names without a call and a call's own are ignored.
    """
    key = ["conv_id", "call_id"]
    nodes = table(calls.select(*key).distinct(), "nodes")
    named = calls.select(*key, F.explode("after").alias("parent")).where("parent <> call_id").distinct()
    edges = named.join(nodes.select(F.col("conv_id").alias("c"), F.col("call_id").alias("p")), (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("parent") == F.col("p")), "left_semi")
    edges = table(edges.withColumn("node", F.struct("conv_id", "call_id")).withColumn("up", F.struct("conv_id", F.col("parent").alias("call_id"))).select("node", "up"), "edges")
    count = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("up").alias("up"))
    all_ = nodes.select(F.struct(*key).alias("node"))
    # a link of a chain has one predecessor; roots and meeting points of several stop the chains
    state = all_.join(count.where("n = 1").select("node", F.col("up").alias("__up")), "node", "left")
    fin = F.col("__up").isNull()
    state = table(state.select("node", F.coalesce("__up", "node").alias("up"), F.when(fin, 0).otherwise(1).cast("bigint").alias("dist"), fin.alias("fin")), "pointers")
    for _ in range(state.count().bit_length() + 1):
        if not state.where("not fin").limit(1).count():
            break
        ahead = state.select(F.col("node").alias("up"), F.col("up").alias("__next"), F.col("dist").alias("__more"), F.col("fin").alias("__fin"))
        moved = state.where("not fin").drop("fin").join(ahead, "up").select("node", F.col("__next").alias("up"), (F.col("dist") + F.col("__more")).alias("dist"), F.col("__fin").alias("fin"))
        state = table(state.where("fin").unionByName(moved), "pointers")
    reach = state.where("fin").select("node", F.col("up").alias("stop"), "dist")
    meet = count.where("n > 1").select("node", "n")
    known = all_.join(count.select("node"), "node", "left_anti").select("node", F.lit(0).cast("bigint").alias("level"))
    if meet.limit(1).count():
        paths = edges.join(meet, "node").join(reach.select(F.col("node").alias("up"), "stop", "dist"), "up").select("node", "n", "stop", (F.col("dist") + 1).alias("dist"))
        paths = table(paths, "paths")
        known, size = table(known, "known"), -1
        while size != (size := known.count()):
            step = paths.join(known.select(F.col("node").alias("stop"), "level"), "stop").groupBy("node", "n").agg(F.count("*").alias("k"), F.max(F.col("level") + F.col("dist")).alias("level"))
            fresh = step.where("k = n").select("node", "level").join(known.select("node"), "node", "left_anti")
            known = table(known.unionByName(fresh), "known")
    out = state.join(known.select(F.col("node").alias("up"), "level"), "up", "left")
    return out.select("node.*", F.when(F.col("fin"), F.col("level") + F.col("dist")).alias("level"))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each call and each result, with its link.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON), after (array of call ids); ``results``: conv_id, call_id, turn,
    content. Rows: conv_id, turn, kind (call or result), call_id, name, arguments or content, level, linked. A call is linked if
    there is a result of its identifier, a result if there is such a call. Repeated identifiers are linked alike.
    """
    lev = levels(calls)
    known = lev.join(calls.groupBy("conv_id", "call_id").agg(F.min("name").alias("__name")), ["conv_id", "call_id"])
    answered = results.select("conv_id", "call_id").distinct().withColumn("linked", F.lit(True))
    c = calls.join(known, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    c = c.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", "name", "arguments", F.lit(None).cast("string").alias("content"), "level", F.coalesce("linked", F.lit(False)).alias("linked"))
    r = results.join(known.withColumn("linked", F.lit(True)), ["conv_id", "call_id"], "left")
    r = r.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.col("__name").alias("name"), F.lit(None).cast("string").alias("arguments"), "content", "level", F.coalesce("linked", F.lit(False)).alias("linked"))
    return c.unionByName(r)


def line_of(r, schemas: dict[str, dict]) -> tuple[bool | None, str, str]:
    """(valid, error, canonical line) of a linked row; valid is null for results and text."""
    out = {"kind": r.kind, "turn": _int(r.turn), "conv_id": _int(r.conv_id)}
    valid, error = None, ""
    if r.kind != "text":
        out |= {"call_id": r.call_id, "name": r.name, "level": _int(r.level)}
    if r.kind == "call":
        try:
            args = json.loads(r.arguments)
            canonical(args)
            wrong = faults(args, schemas[r.name]) if r.name in schemas else ["unknown tool"]
            out["arguments"] = args
        except (TypeError, ValueError, RecursionError):
            wrong, out["arguments"] = ["not JSON"], r.arguments
        valid, error = not wrong, "; ".join(wrong)
    else:
        out["content"] = r.content
        if r.kind == "text":
            out["role"] = r.name
    return valid, error, canonical(out)


def _int(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _lines(schemas: dict[str, dict]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.astype(object).where(b.notna(), None)
            got = [line_of(r, schemas) for r in b.itertuples(index=False)]
            yield pd.DataFrame(
                {
                    "conv_id": pd.array([_int(x) for x in b["conv_id"]], "Int64"),
                    "turn": pd.array([_int(x) for x in b["turn"]], "Int64"),
                    "kind": b["kind"],
                    "call_id": b["call_id"],
                    "level": pd.array([_int(x) for x in b["level"]], "Int64"),
                    "linked": b["linked"].astype(bool),
                    "valid": pd.array([g[0] for g in got], "boolean"),
                    "error": [g[1] for g in got],
                    "line": [g[2] for g in got],
                }
            )

    return run


def conversations_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, other rows) of conversations (conv_id, turn, role, text).

    An assistant turn whose text is a JSON object with tool_calls makes those calls, each after the calls that its ``after``
    names; its content, if it has any, is a text of the assistant; a tool turn of the form {"tool_call_id", "content"} is a result. Where turns are plain, each user turn t calls ``reply`` as
    conv_id:t, after the call two turns before, and the assistant turn t + 1 is its result. Other turns are text.
    """
    t = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    asked = "content string, tool_calls array<struct<id:string,after:array<string>,function:struct<name:string,arguments:string>>>"
    t = t.withColumn("__j", F.when((F.col("role") == "assistant") & F.coalesce(F.ltrim("text").startswith("{"), F.lit(False)), F.from_json("text", asked)))
    t = t.withColumn("__r", F.when((F.col("role") == "tool") & F.coalesce(F.ltrim("text").startswith("{"), F.lit(False)), F.from_json("text", "tool_call_id string, content string")))
    makes, gives = F.coalesce(F.size("__j.tool_calls") > 0, F.lit(False)), F.col("__r.tool_call_id").isNotNull()
    user, reply = F.coalesce(F.col("role") == "user", F.lit(False)), F.coalesce(F.col("role") == "assistant", F.lit(False)) & ~makes
    name = lambda back: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.coalesce((F.col("turn") - back).cast("string"), F.lit("null")))
    own = t.where(makes).select("conv_id", "turn", F.explode("__j.tool_calls").alias("c"))
    own = own.select("conv_id", F.coalesce("c.id", F.lit("null")).alias("call_id"), "turn", F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    plain = t.where(user).select("conv_id", name(0).alias("call_id"), "turn", F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), F.array(name(2)).alias("after"))
    results = t.where(gives).select("conv_id", F.col("__r.tool_call_id").alias("call_id"), "turn", F.col("__r.content").alias("content"))
    results = results.unionByName(t.where(reply).select("conv_id", name(1).alias("call_id"), "turn", F.col("text").alias("content")))
    # what a calling turn says beside its calls
    said = t.where(makes & (F.coalesce("__j.content", F.lit("")) != "")).select("conv_id", "turn", "role", F.col("__j.content").alias("text"))
    rest = t.where(~(makes | gives | user | reply)).select("conv_id", "turn", "role", "text").unionByName(said)
    other = rest.select("conv_id", "turn", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.col("role").alias("name"), F.lit(None).cast("string").alias("arguments"), F.col("text").alias("content"), F.lit(None).cast("bigint").alias("level"), F.lit(False).alias("linked"))
    return own.unionByName(plain), results, other


def format_turns(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, turn, kind, call_id, level, linked, valid, error, line) of every call, result and other turn of conversations.

    Rows of a null conv_id are in no conversation: not linked, no level. Null turns, roles and texts are values like any other
    (a null text is an argument that is missing). Arguments that aren't JSON, or hold strings that aren't Unicode, are kept as the
    text they are and said to be "not JSON"; a calling turn's own content is a row of kind text. Repeated rows have
    equal identifiers and are linked alike. Other columns are not read. An empty table gives no rows.
    """
    spark = turns.sparkSession
    ship(spark)
    calls, results, other = conversations_as_calls(turns)
    calls = table(calls, "calls")
    rows = link(calls, results).unionByName(other)
    return rows.mapInPandas(_lines({"reply": REPLY} if schemas is None else schemas), "conv_id bigint, turn bigint, kind string, call_id string, level bigint, linked boolean, valid boolean, error string, line string")
