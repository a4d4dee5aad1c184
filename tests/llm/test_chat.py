"""Chat formatting."""

import json

import pytest
from pyspark.sql import functions as F

from kindred.llm import chat


def test_levels_and_cycles(spark):
    x = [(1, "a", []), (1, "b", ["a"]), (1, "c", ["b"]), (1, "d", ["a", "c"]), (1, "e", ["d", "none"]), (2, "p", ["q"]), (2, "q", ["p"]), (2, "r", ["q"]), (3, "a", ["a"])]
    x += [(4, f"n{i}", [f"n{i - 1}"]) for i in range(40)]
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in chat.levels(spark.createDataFrame(x, "conv_id long, call_id string, after array<string>")).collect()}
    assert [got[1, k] for k in "abcde"] == [0, 1, 2, 3, 4] and got[2, "p"] is got[2, "q"] is got[2, "r"] is None and got[3, "a"] == 0
    assert [got[4, f"n{i}"] for i in range(40)] == list(range(40))


def test_chat_lines(spark):
    call = json.dumps({"tool_calls": [{"id": "k", "function": {"name": "add", "arguments": '{"b": 2.0, "a": "é"}'}}]})
    rows = [(1, 0, "assistant", call), (1, 1, "tool", '{"tool_call_id": "k", "content": "3"}'), (None, None, None, None), (3, 0, "user", None), (3, 0, "user", None), (3, 1, "assistant", "x"), (3, 2, "user", "y" * 100_000), (4, 5, "assistant", "nobody asked")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))
    schema = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}}
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_turns(df, {"add": schema, "reply": chat.REPLY}).collect()}
    assert got[1, 0]["line"] == '{"arguments":{"a":"é","b":2},"call_id":"k","conv_id":1,"kind":"call","level":0,"name":"add","turn":0}'
    assert got[1, 0]["error"] == "/a: not of type integer" and got[1, 0]["linked"] and got[1, 1]["linked"]
    assert not got[3, 0]["valid"] and got[3, 2]["valid"] and got[3, 2]["level"] == 1 and not got[4, 5]["linked"] and got[None, None]["kind"] == "text"
    assert chat.format_turns(df.limit(0)).count() == 0


def test_chat_of_surrogates_and_of_turns_that_say_something(spark):
    odd = json.dumps({"content": "Let me see.", "tool_calls": [{"id": "k", "function": {"name": "add", "arguments": '{"a": "\\ud800"}'}}, {"id": "m", "function": {"name": "add", "arguments": "{"}}]})
    df = spark.createDataFrame([(1, 0, "assistant", odd), (1, 1, "tool", '{"tool_call_id": "k", "content": null}'), (1, 2, "assistant", '{"tool_calls": [')], "conv_id long, turn long, role string, text string")
    got = {(r["turn"], r["kind"], r["call_id"]): r for r in chat.format_turns(df, {"add": {}}).collect()}
    assert got[0, "call", "k"]["error"] == "not JSON" == got[0, "call", "m"]["error"] and json.loads(got[0, "call", "k"]["line"])["arguments"] == '{"a": "\\ud800"}'
    assert json.loads(got[0, "text", None]["line"]) == {"content": "Let me see.", "conv_id": 1, "kind": "text", "role": "assistant", "turn": 0}
    assert len(got) == 5 and json.loads(got[2, "result", "1:1"]["line"])["content"] == '{"tool_calls": ['


def test_canonical_json():
    numbers = {1e16: "10000000000000000", 1e21: "1e+21", 1e20: "100000000000000000000", 1e-6: "0.000001", 1e-7: "1e-7", 0.1: "0.1", -0.0: "0", 1.5e300: "1.5e+300", 123.456: "123.456", -2.0: "-2", 5e-324: "5e-324"}
    assert {x: chat.canonical(x) for x in numbers} == numbers
    assert chat.canonical({"\ue000": 1, "\U00010000": 2, "a": [None, True, "\x1f\n\"é"]}) == '{"a":[null,true,"\\u001f\\n\\"é"],"\U00010000":2,"\ue000":1}'
    assert chat.canonical(2**70) == str(2**70)
    for bad in (float("nan"), "\ud800", {"\udfff": 1}):
        with pytest.raises(ValueError):
            chat.canonical(bad)


def test_schema_faults():
    s = {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "array", "items": {"type": "number", "minimum": 0}, "maxItems": 2}, "y": {"enum": ["a"]}, "z": {"type": "string", "pattern": "^a", "maxLength": 2}}}
    assert chat.faults({"x": [1, 2.5]}, s) == []
    assert chat.faults({"x": [-1, 1, 1], "y": "b", "z": "bcd", "w": 0}, s) == ["/w: not allowed", "/x/0: minimum", "/x: maxItems", "/y: not in enum", "/z: maxLength", "/z: pattern"]
    assert chat.faults(True, {"type": "integer"}) and not chat.faults(2.0, {"type": "integer"})
