"""Nothing is lost to cut arguments, doubled keys, NaN, or one bad item."""

import json

import pytest

from sessionlog.operators import parse
from sessionlog.operators.recurring import signal_repeated_path_fixes
from sessionlog.operators.tokens import signal_redundant_reads
from sessionlog.schemas import TOOL_CALLS, conform


def use(name, **given):
    return {"type": "tool_use", "id": "t", "name": name, "input": given}


def event(n, content):
    return json.dumps({"type": "assistant", "timestamp": f"2026-01-01T00:00:0{n}Z", "uuid": f"e{n}",
                       "message": {"role": "assistant", "content": content}})


def parsed(spark, lines):
    rows = [("/logs/-a-b/s.jsonl", "", i, x) for i, x in enumerate(lines)]
    return parse.parse_lines(spark.createDataFrame(rows, "path string, block string, line long, value string"))


@pytest.fixture(scope="module")
def calls(spark):
    long = "x" * 3000
    lines = [event(0, [use("Read", file_path="/f")]),
             event(1, [use("Edit", old_string=long + "a", file_path="/f")]),
             event(2, [use("Read", file_path="/f")]),
             event(3, [use("Edit", old_string=long + "b", file_path="/f")]),
             event(4, [use("Read", file_path="/g"), use("Read", file_path="/g")])]
    return parse.conform_calls(parse.tool_calls(parse.with_positions(parsed(spark, lines), False), False)).cache()


def test_long_edits_stand_between_reads(calls):
    assert [tuple(r) for r in signal_redundant_reads(calls).collect()] == [("s", "/g", 2)]


def test_long_edits_are_compared(calls):
    rows = signal_repeated_path_fixes(calls, 5).collect()
    assert [(len(r["before"]), r["before"][-1], r["after"][-1]) for r in rows] == [(3001, "a", "b")]


def test_tables_without_the_columns(spark):
    rows = [("s", "Read", i, 0, json.dumps({"file_path": "/f"})) for i in range(3)]
    frame = spark.createDataFrame(rows, "session_id string, tool_name string, position_in_session int, block_idx int, args_json string")
    for given in (conform(frame, TOOL_CALLS), frame.withColumn("event_id", frame["session_id"]).withColumn("ts", frame["session_id"])):
        assert [tuple(r) for r in signal_redundant_reads(given).collect()] == [("s", "/f", 3)]


def test_lines_that_variant_refuses(spark):
    lines = ['{"type":"user","type":"assistant","uuid":"u","message":{"role":"x","role":"assistant","content":"hi"}}',
             '{"type":"user","durationMs":NaN,"message":{"content":"no number"}}',
             '{"type":"user","message":{"content":["bare",{"type":"text","text":"kept"},7,{"type":"tool_use","name":"Bash","input":{"a":1}}]}}',
             '{"type":"user",}', "NaN", "[1]"]
    rows = parsed(spark, lines).orderBy("line").collect()
    assert [r["status"] for r in rows] == ["ok", "ok", "ok", "bad", "bad", "bad"]
    assert [(r["type"], r["role"], r["text_head"]) for r in rows[:2]] == [("assistant", "assistant", "hi"), ("user", None, "no number")]
    assert rows[2]["text_head"] == "kept"
    assert [(b["tool_name"], b["args_json"]) for b in rows[2]["blocks"]] == [("Bash", '{"a": 1}')]
