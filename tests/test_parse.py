"""The parse job on files: every kind of line and block."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sessionlog.functions.ordered import HeavyKeys
from sessionlog.operators import parse
from sessionlog.operators.payloads import build_payloads, get_payload
from sessionlog.sources.jsonl import has_split_files, path_facts, read_session_lines


def use(name, given, uid="t"):
    return {"type": "tool_use", "id": uid, "name": name, "input": given}


def result(content, error=False, uid="t"):
    return {"type": "tool_result", "tool_use_id": uid, "content": content, "is_error": error}


def line(kind, ts, content=None, uuid=None, **more):
    out = {"type": kind, "timestamp": ts}
    if uuid:
        out["uuid"] = uuid
    if content is not None:
        out["message"] = {"role": kind, "content": content, **more.pop("message", {})}
    return json.dumps(out | more, ensure_ascii=False)


LONG = {"z": "é" * 3000, "a": 1}
SESSION = [
    line("user", "2026-05-01T10:00:00Z", "  /code-review:x now", "e0"),  # pos 0, skill
    "   ",
    "{broken",
    line("assistant", "2026-05-01T10:00:01Z",
         [{"type": "text", "text": "one"}, {"type": "text", "text": "zwei 😀"},
          use("Read", {"file_path": "/a", "n": 1.0}, "t1"), use("Edit", {"b": "é", "a": [1, None]}, "t2")],
         "e1", message={"model": "m1", "usage": {"input_tokens": 10, "output_tokens": 5,
                                                 "cache_read_input_tokens": 3}}),  # pos 1, two calls
    line("user", "2026-05-01T10:00:02Z", [result("12345", uid="t1"), result([1, "é"], True, "t2")], "e2"),  # pos 2
    line("ai-title", "2026-05-01T10:00:03Z", aiTitle="Title"),
    line("assistant", "2026-05-01T10:00:04Z",
         [use("Skill", {"skill": "pack:review", "args": "mit é"}, "t3")],
         message={"model": "", "usage": {"output_tokens": 7}}),  # pos 3, no uuid
    line("system", "2026-05-01T10:00:05Z", subtype="compaction", leafUuid="e4", isMeta=True),  # pos 4
    line("user", "", [result(None, uid="t3")], "e5"),  # pos 5, no time
    json.dumps({"type": "assistant", "ts": "2026-05-01T10:00:06Z", "uuid": "e6",
                "message": {"role": "assistant", "content": [use("Bash", LONG), use("", {})]}}, ensure_ascii=False),
    json.dumps({"message": "text only", "isSidechain": 1, "durationMs": 12, "parentUuid": "e6"}),  # pos 7
    '{"type":"user"} trailing',
    '{"type":"user"}{"type":"user"}',
    "[1, 2]",
    '{"type":"user","message":{"content":["bare"]}}',
]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("projects")
    home = folder / "-Users-me-my-app"
    home.mkdir()
    (home / "s 1%+.jsonl").write_text("\n".join(SESSION) + "\n", encoding="utf-8")
    (home / "notes.txt").write_text("{}")
    (home / "blank.jsonl").write_text("\n\n")
    return str(folder)


@pytest.fixture(scope="module")
def parsed(spark, root):
    return parse.parse_lines(read_session_lines(spark, root)).cache()


@pytest.fixture(scope="module")
def positioned(parsed):
    return parse.with_positions(parsed).cache()


def test_lines_keep_order_and_text(spark, root):
    rows = read_session_lines(spark, root).filter(F.col("path").endswith("s 1%+.jsonl"))
    assert [r.value for r in rows.orderBy("block", "line").collect()] == SESSION
    assert not has_split_files(spark, root)


def test_status(parsed):
    counts = {r["status"]: r["count"] for r in parsed.groupBy("status").count().collect()}
    assert counts == {"ok": 10, "blank": 3, "bad": 4}
    assert parse.bad_lines(parsed).count() == 4


def test_events(positioned):
    rows = parse.normalize_events(positioned).collect()
    at = {r.event_id: r for r in rows}
    assert len(rows) == 9
    assert set(at) == {"e0", "e1", "e2", "s 1%+:3", "e4", "e5", "e6", "s 1%+:7", "s 1%+:8"}
    e1 = at["e1"]
    assert (e1.text_head, e1.text_len, e1.role, e1.input_tokens, e1.output_tokens, e1.cache_read,
            e1.cache_creation) == ("one\nzwei 😀", 10, "assistant", 10, 5, 3, None)
    assert at["e2"].text_head is None and at["e2"].text_len is None
    assert at["e4"].subtype == "compaction" and at["e4"].is_meta and not at["e1"].is_meta
    assert at["e5"].ts == "" and at["e6"].ts == "2026-05-01T10:00:06Z"
    other = at["s 1%+:7"]
    assert (other.type, other.is_sidechain, other.duration_ms, other.parent_uuid, other.role) == (
        "other", True, 12, "e6", None)


def test_tool_calls(positioned):
    calls = parse.conform_calls(parse.tool_calls(positioned)).orderBy("position_in_session", "block_idx").collect()
    assert [(c.tool_name, c.position_in_session, c.block_idx) for c in calls] == [
        ("Read", 1, 2), ("Edit", 1, 3), ("Skill", 3, 0), ("Bash", 6, 0), ("unknown", 6, 1)]
    read, edit, skill, bash, last = calls
    assert read.args_json == '{"file_path": "/a", "n": 1.0}'
    assert edit.args_json == '{"b": "é", "a": [1, null]}'
    # Both results go to the latest call; '[1, "\\u00e9"]' has 13 characters.
    assert (read.result_size, read.success) == (0, True)
    assert (edit.result_size, edit.success) == (13, False)
    assert (skill.result_size, skill.success) == (2, True)
    whole = json.dumps(LONG, ensure_ascii=False)
    assert bash.args_json == whole[:2048]
    assert bash.args_blob_hash == hashlib.sha256(whole[:2048].encode()).hexdigest()
    assert (last.args_json, last.args_blob_hash) == ("{}", None)


def test_results_by_id(positioned):
    calls = {c.tool_name: c for c in parse.tool_calls(positioned, pair_by="tool_use_id").collect()}
    assert (calls["Read"].result_size, calls["Read"].success) == (5, True)
    assert (calls["Edit"].result_size, calls["Edit"].success) == (13, False)
    assert len(calls) == 5


def test_skills(positioned):
    calls = parse.tool_calls(positioned)
    rows = parse.skill_invocations(positioned, calls, HeavyKeys(())).orderBy("ts").collect()
    assert [(r.skill_name, r.args, r.triggered_by) for r in rows] == [
        ("code-review:x", None, "user_slash"), ("pack:review", '"mit \\u00e9"', "auto")]
    assert rows[0].followed_by_tools == ["Read", "Edit", "Skill", "Bash", "unknown"]
    assert rows[1].followed_by_tools == ["Skill", "Bash", "unknown"]


def test_sessions(parsed):
    rows = {r.session_id: r for r in parse.session_rollup(parsed).collect()}
    assert set(rows) == {"s 1%+", "blank"}
    s = rows["s 1%+"]
    assert (s.project, s.cwd) == ("app", "/Users/me/my/app")
    assert (s.started_at, s.ended_at) == ("2026-05-01T10:00:00Z", "2026-05-01T10:00:06Z")
    assert (s.message_count, s.total_input_tokens, s.total_output_tokens, s.total_cache_read_tokens) == (7, 10, 12, 3)
    assert (s.compaction_count, s.model, s.ai_title, s.is_subagent) == (1, "m1", "Title", False)
    assert rows["blank"].started_at is None and rows["blank"].message_count == 0


def test_long_files_are_read_in_splits(spark, tmp_path):
    folder = tmp_path / "-a"
    folder.mkdir()
    n = 3000
    text = "\n".join(
        line("assistant", f"2026-01-01T00:{i // 60:02d}:{i % 60:02d}Z",
             [use(f"T{i % 5}", {"i": i})] if i % 3 else [result("x" * (i % 50))]) for i in range(n))
    (folder / "big.jsonl").write_text(text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "20000")
        lines = read_session_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 5
        got = parse.with_positions(parse.parse_lines(lines))
        assert got.filter("block = ''").isEmpty()
        assert [r.pos for r in got.orderBy("ts").select("pos").collect()] == list(range(n))
        calls = parse.tool_calls(got).orderBy("position_in_session").collect()
        whole = parse.tool_calls(got.withColumn("block", F.lit("")), split_files=False)
        assert calls == whole.orderBy("position_in_session").collect()
        assert len(calls) == n - n // 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_path_facts(spark):
    uuid = "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee"
    cases = {
        "/r/-Users-me-app/x.y.jsonl": ("x.y", "app", "~/app", None, False),
        f"/r/-Users-me-app/{uuid}/subagents/agent-1.jsonl": ("agent-1", "app", "~/app", uuid, True),
        f"/r/-Users-me-app/{uuid.upper()}/subagents/a.jsonl": ("a", "subagents", "/subagents", None, False),
        f"/r/-a/{uuid}/deeper/subagents/a.jsonl": ("a", "subagents", "/subagents", None, False),
        "/r/---/z.jsonl": ("z", "root", "/", None, False),
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    facts = path_facts(F.col("path"), "/Users/me")
    got = {r["path"]: tuple(r)[1:] for r in df.select("path", *[c.alias(n) for n, c in facts.items()]).collect()}
    assert got == cases


def test_payloads(spark):
    df = spark.createDataFrame([("a" * 3000,), ("a" * 3000,), ("b" * 2048,), ("short",)], "args_json string")
    made = build_payloads(df)
    assert made.count() == 2
    h = hashlib.sha256(b"a" * 3000).hexdigest()
    assert get_payload(made, h).first()["content"] == "a" * 3000
    assert get_payload(made, "0" * 64).isEmpty()
    assert build_payloads(df, existing=made).isEmpty()


def test_only_files_changed_since(spark, root):
    assert read_session_lines(spark, root, modified_after="2100-01-01T00:00:00").isEmpty()
    assert not read_session_lines(spark, root, modified_after="2001-01-01T00:00:00").isEmpty()


def test_stored_columns(spark, positioned):
    from sessionlog.schemas import EVENTS, TOOL_CALLS

    assert parse.normalize_events(positioned).columns == list(EVENTS)
    calls = parse.conform_calls(parse.tool_calls(positioned))
    assert dict(calls.dtypes) == TOOL_CALLS
