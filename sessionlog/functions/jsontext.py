"""JSON in session lines: strict reading, and the exact text of parts of it."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

# Lengths at which stored argument text is cut.
ARGS_CHARS = 2048
SKILL_ARGS_CHARS = 512

_BLOCK_TEXT = "array<struct<args_json: string, skill: string, skill_args: string, size: bigint>>"


def _block_reader(args_chars: int | None):
    """Function from a content block to its JSON texts.

    Inner functions travel to the executors by value; the package need not be there.
    """
    def encodable(text):
        return text.encode("utf-8", "replace").decode("utf-8")

    def of_block(b):
        item = {"args_json": None, "skill": None, "skill_args": None, "size": None}
        if b.get("type") == "tool_use":
            given = b.get("input") or {}
            item["args_json"] = encodable(json.dumps(given, ensure_ascii=False)[:args_chars])
            if b.get("name") == "Skill":
                given = given if isinstance(given, dict) else {}
                item["skill"] = encodable(str(given.get("skill", "unknown")))
                item["skill_args"] = json.dumps(given.get("args") or "")[:SKILL_ARGS_CHARS]
        elif b.get("type") == "tool_result" and not isinstance(b.get("content"), str):
            item["size"] = len(json.dumps(b.get("content") or ""))
        return item

    return of_block


def block_texts(line: Column, args_chars: int | None = ARGS_CHARS) -> Column:
    """Exact JSON texts of the content blocks of a line, in block order (null line: null)."""
    of_block = _block_reader(args_chars)

    def of_line(text):
        # As in the JVM: items that are no objects are left out.
        return [of_block(b) for b in json.loads(text)["message"]["content"] if isinstance(b, dict)]

    shape = to_arrow_type(DataType.fromDDL(_BLOCK_TEXT))

    # Of the same kind as :func:`line_fields`, so that one pass through Python serves both.
    @F.arrow_udf(_BLOCK_TEXT)
    def texts(lines: pa.Array) -> pa.Array:
        return pa.array([None if x is None else of_line(x) for x in lines.to_pylist()], shape)

    return texts(line)


def invocation_texts(line: Column) -> Column:
    """Text of a message line: its text blocks, and its Skill calls as JSON text."""

    def of_block(b):
        if not isinstance(b, dict):
            return None
        if b.get("type") == "text":
            return b.get("text") or ""
        if b.get("type") == "tool_use" and b.get("name") == "Skill":
            return "[Skill tool_use] " + json.dumps(b.get("input") or {})
        return None

    def of_line(text):
        content = json.loads(text)["message"]["content"]
        if not isinstance(content, str):
            content = "\n".join(t for t in map(of_block, content) if t is not None)
        return content.encode("utf-8", "replace").decode("utf-8")

    @F.pandas_udf("string")
    def texts(lines: pd.Series) -> pd.Series:
        return lines.map(of_line, na_action="ignore")

    return texts(line)


#: Fields of a session line; blocks are the items of a content list that are objects.
LINE_FIELDS = (
    "type string, timestamp string, ts string, uuid string, leaf_uuid string, parent_uuid string, subtype string, "
    "is_sidechain boolean, is_meta boolean, role string, model string, ai_title string, input_tokens bigint, "
    "output_tokens bigint, cache_read bigint, cache_creation bigint, duration_ms bigint, content string, is_list boolean, "
    "blocks array<struct<kind: string, text: string, tool_name: string, link: string, is_error: boolean, shape: string, "
    "file_path: string, old_string: string, content_chars: int>>, texts " + _BLOCK_TEXT
)


def line_fields(line: Column, args_chars: int | None = ARGS_CHARS) -> Column:
    """``LINE_FIELDS`` of a line, read in Python: null if the line is no JSON object.

    For lines of any length, with a key given twice (the last one counts), NaN or infinities (null).
    Values become text and numbers as VARIANT casts do it, so a line gives the same as read
    in the JVM.  Objects nested deeper than Python's recursion limit cannot be read.
    """
    of_block_text = _block_reader(args_chars)

    def text(v):
        if v is None or isinstance(v, str):
            return v if v is None else v.encode("utf-8", "replace").decode("utf-8")
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (dict, list)):
            return text(json.dumps(v, ensure_ascii=False, separators=(",", ":")))
        return str(v)

    def number(v):
        try:
            n = int(v.strip() if isinstance(v, str) else v)
        except (TypeError, ValueError, OverflowError):
            return None
        return n if -(1 << 63) <= n < 1 << 63 else None

    def true(v):
        return text(v) not in (None, "", "false", "0", "0.0", "[]", "{}")

    def obj(v):
        return v if isinstance(v, dict) else {}

    def of_block(b):
        given, content = obj(b.get("input")), b.get("content")
        shape = "STRING" if isinstance(content, str) else None if "content" not in b else "OTHER"
        called = text(b.get("id"))
        return {
            "kind": text(b.get("type")), "text": text(b.get("text")), "tool_name": text(b.get("name")) or "unknown",
            "link": called if called is not None else text(b.get("tool_use_id")), "is_error": true(b.get("is_error")),
            "shape": shape, "file_path": text(given.get("file_path")), "old_string": text(given.get("old_string")),
            "content_chars": len(content) if isinstance(content, str) else None,
        }

    def of_line(raw):
        try:
            d = json.loads(raw, parse_constant=lambda _: None)
        except (ValueError, RecursionError):
            return None
        if not isinstance(d, dict):
            return None
        m = obj(d.get("message"))
        usage, content = obj(m.get("usage")), m.get("content")
        blocks = [b for b in content if isinstance(b, dict)] if isinstance(content, list) else None
        return {
            "type": text(d.get("type")), "timestamp": text(d.get("timestamp")), "ts": text(d.get("ts")),
            "uuid": text(d.get("uuid")), "leaf_uuid": text(d.get("leafUuid")), "parent_uuid": text(d.get("parentUuid")),
            "subtype": text(d.get("subtype")), "is_sidechain": true(d.get("isSidechain")), "is_meta": true(d.get("isMeta")),
            "role": text(m.get("role")), "model": text(m.get("model")), "ai_title": text(d.get("aiTitle")),
            "input_tokens": number(usage.get("input_tokens")), "output_tokens": number(usage.get("output_tokens")),
            "cache_read": number(usage.get("cache_read_input_tokens")),
            "cache_creation": number(usage.get("cache_creation_input_tokens")), "duration_ms": number(d.get("durationMs")),
            "content": text(content) if isinstance(content, str) else None, "is_list": isinstance(content, list),
            "blocks": None if blocks is None else [of_block(b) for b in blocks],
            "texts": None if blocks is None else [of_block_text(b) for b in blocks],
        }

    shape = to_arrow_type(StructType.fromDDL(LINE_FIELDS))

    @F.arrow_udf(StructType.fromDDL(LINE_FIELDS))
    def fields(lines: pa.Array) -> pa.Array:
        return pa.array([None if x is None else of_line(x) for x in lines.to_pylist()], shape)

    return fields(line)


def given(calls: DataFrame, name: str) -> Column:
    """A text argument of tool calls: the column taken from the whole line, else from ``args_json``.

    ``args_json`` is cut, so it may not parse; it serves tables without the column.
    """
    parsed = F.try_variant_get(read_json(F.col("args_json")), f"$.line.{name}", "string")
    return F.coalesce(F.col(name), parsed) if name in calls.columns else parsed


def read_json(value: Column) -> Column:
    """VARIANT with the line under ``$.line``; null unless the whole text is one JSON value.

    The parser stops after the first value, so the text is wrapped and the key
    after it must be seen.
    """
    return F.try_parse_json(F.concat(F.lit('{"line":'), value, F.lit(',"line_end":true}')))
