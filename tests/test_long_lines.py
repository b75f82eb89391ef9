"""Lines that VARIANT refuses give what they would give otherwise, in every table."""

import json

import pytest
from pyspark.sql import functions as F

from sessionlog.functions import scratch, text
from sessionlog.operators import parse
from sessionlog.plans import evidence

SCHEMA = "path string, block string, line long, value string"
TALK = "/logs/-a-b/s.jsonl"
BIG = 20 << 20

ODD = [
    {"type": "user", "timestamp": "2026-01-01T00:00:00Z", "uuid": "u1", "message": {"role": "user", "content": "hi é \U0001f600"}},
    {"type": 7, "timestamp": 1.5, "uuid": True, "subtype": {"a": [1, "x"]}, "isMeta": 0, "isSidechain": "no", "durationMs": "12"},
    {"type": "user", "isMeta": [], "message": {"content": []}},
    {"type": "user", "isMeta": {}, "message": {"content": {"a": 1}}, "durationMs": 12.9},
    {"type": None, "ts": "t", "leafUuid": "l", "message": "text"},
    {"type": "assistant", "uuid": "", "leafUuid": "l2", "durationMs": -3, "message": {
        "model": "", "usage": {"input_tokens": 5, "output_tokens": "x", "cache_read_input_tokens": True}, "content": [
            "bare", 3, {"type": "text"}, {"type": "text", "text": "a"}, {"type": "text", "text": 4},
            {"type": "tool_use", "id": "i", "name": "", "input": {"file_path": "/f", "old_string": 3}},
            {"type": "tool_use", "name": "Skill", "input": {"skill": "s", "args": {"k": "é"}}},
            {"type": "tool_use", "name": "Bash", "input": "text"},
            {"type": "tool_result", "tool_use_id": "i", "content": "x\U0001f600", "is_error": "false"},
            {"type": "tool_result", "content": [1, None, "é"], "is_error": True},
            {"type": "tool_result", "content": None}, {"type": "tool_result"}]}},
    {"type": "ai-title", "aiTitle": "t"},
    {"type": "user", "isMeta": True, "message": {"content": "/go now"}},
    {"type": "user", "message": {"content": "/go now"}},
    {},
]


def lines(spark, texts, path=TALK):
    return spark.createDataFrame([(path, "", i, t) for i, t in enumerate(texts)], SCHEMA)


def twice(record):
    """The record as a line with its first key given twice: other readers refuse it."""
    return '{"uuid": "other", "uuid": null, ' + json.dumps(record)[1:].lstrip() if record else '{"x": NaN}'


def test_odd_values(spark):
    plain = parse.parse_lines(lines(spark, [json.dumps(r) for r in ODD])).orderBy("line").collect()
    other = parse.parse_lines(lines(spark, [twice(r) for r in ODD])).orderBy("line").collect()
    for a, b, r in zip(plain, other, ODD):
        assert a == b, r
    assert {r.status for r in plain} == {"ok"}


def test_no_objects(spark):
    got = parse.parse_lines(lines(spark, ["{", "{]", "NaN", "[1]", "", " ", '{"a": ' + "[" * 100_000, '{"type": "user"} x'])).collect()
    assert [r.status for r in got] == ["bad"] * 4 + ["blank"] * 2 + ["bad"] * 2


def big_record(n):
    return {"type": "user", "timestamp": "2026-01-01T00:00:05Z", "uuid": "u", "message": {
        "role": "user", "usage": {"input_tokens": 3}, "content": [
            {"type": "text", "text": "/run " + "wé " * (n // 4)},
            {"type": "tool_use", "id": "c", "name": "Skill", "input": {"skill": "go", "args": "x" * (n // 4)}},
            {"type": "tool_result", "tool_use_id": "c", "content": ["y" * (n // 2)]}]}}


@pytest.fixture(scope="module")
def tables(spark):
    """All tables of a session with a line of 20 MiB, and of one whose line is small."""
    def of(n):
        parsed = parse.parse_lines(lines(spark, [json.dumps(big_record(n), ensure_ascii=False)])).cache()
        at = parse.with_positions(parsed, False)
        calls = parse.tool_calls(at, False)
        return {
            "events": parse.normalize_events(at).collect(), "calls": parse.conform_calls(calls).collect(),
            "skills": parse.skill_invocations(at, calls).collect(), "messages": parse.user_messages(parsed).collect(),
            "sessions": parse.session_rollup(parsed).drop("ingested_at").collect()}
    return of(BIG), of(4000)


def test_line_of_20_mib_is_in_all_tables(tables):
    big, small = tables
    for name in ("sessions", "skills"):
        cut = lambda r: {k: v for k, v in r.asDict().items() if k != "args"}
        assert [cut(r) for r in big[name]] == [cut(r) for r in small[name]] and big[name]
    assert len(big["messages"][0].text) == 5 + 3 * (BIG // 4)
    assert big["events"][0].text_len == 5 + 3 * (BIG // 4) and big["events"][0].text_head == small["events"][0].text_head
    assert big["calls"][0].result_size == BIG // 2 + 4 and big["calls"][0].args_json[:300] == small["calls"][0].args_json[:300]


def test_evidence_has_refused_lines(spark):
    def talk(n, **kw):
        return {"type": "user", "timestamp": f"2026-01-01T00:00:0{n}Z", "message": {"content": f"said {n}"}, **kw}

    use = {"type": "tool_use", "name": "Skill", "input": {"skill": "go", "args": "é"}}
    call = {"type": "assistant", "timestamp": "2026-01-01T00:00:01Z", "message": {"content": [use]}}
    records = [talk(0), call, talk(2), talk(3), talk(4, isMeta=True)]
    for texts in ([json.dumps(r) for r in records], [twice(r) for r in records],
                  ['{"cost": -Infinity, ' + json.dumps(r)[1:] for r in records]):
        raw = lines(spark, texts)
        parsed = parse.parse_lines(raw).cache()
        calls = parse.tool_calls(parse.with_positions(parsed, False), False)
        stored = parse.user_messages(parsed).withColumn("is_subagent", F.lit(False))
        said = evidence.user_messages(raw)
        assert [r.text for r in said.orderBy("line").collect()] == ["said 0", "said 2", "said 3"]
        assert sorted(map(tuple, stored.select(*said.columns).collect())) == sorted(map(tuple, said.collect()))
        for messages in (None, stored):
            rows = evidence.skill_evidence("go", raw, parse.tool_skills(calls), parse.session_rollup(parsed), messages=messages).collect()
            assert [(r.invocation_text, [f.text for f in r.followups]) for r in rows] == [
                ('[Skill tool_use] {"skill": "go", "args": "\\u00e9"}', ["said 2", "said 3"])]


def test_long_lines_go_to_python_a_few_at_a_time(spark):
    """Written tables bound the bytes of a batch; the session's setting is as before afterwards."""
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("value"))
    found = scratch.written(rows.mapInArrow(sizes, "rows long, bytes long")).collect()
    assert sum(r.rows for r in found) == 40
    assert max(r.bytes for r in found) < scratch.BATCH_BYTES + (2 << 20)
    assert spark.conf.get(name) == before


def test_one_pass_through_python(spark):
    """Refused lines and exact texts of blocks go to Python together; rows are not copied for each."""
    plan = parse.parse_lines(lines(spark, ["{}"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_long_texts_are_trimmed_in_turned_order(spark, monkeypatch):
    """Trimming from the right in place takes eight bytes a byte, too much beside a line of 34 MB."""
    cases = ["", " ", "a", " \t aé\U0001f600 b 　\n", " x", "x\u0085 ", "　" * 9, "ab" * 9, None]
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    plain = [r[0] for r in rows.select(text.strip(F.col("t"))).collect()]
    monkeypatch.setattr(text, "TRIM_BYTES", 0)
    assert [r[0] for r in rows.select(text.strip(F.col("t"))).collect()] == plain
    assert plain == [c if c is None else c.strip() for c in cases]
