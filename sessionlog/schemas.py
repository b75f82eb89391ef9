"""Column layout of the stored tables.

Arrays stay arrays inside the library; :func:`json_text` renders them as JSON
text for users who expect the text form.  ``block_idx`` (place of a tool call
inside its line) is kept so that every order is total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .functions.text import array_json


def columns_of(ddl: str) -> dict[str, str]:
    """Column name -> type of a list of simple columns."""
    return dict(c.split(" ", 1) for c in ddl.split(", "))


SESSIONS = columns_of(
    "session_id string, project string, cwd string, git_branch string, started_at string, "
    "ended_at string, duration_ms bigint, message_count int, total_input_tokens bigint, "
    "total_output_tokens bigint, total_cache_read_tokens bigint, "
    "total_cache_creation_tokens bigint, compaction_count int, model string, ai_title string, "
    "ingested_at timestamp, parent_session_id string, is_subagent boolean"
)

EVENTS = columns_of(
    "event_id string, session_id string, parent_uuid string, ts string, type string, "
    "subtype string, is_sidechain boolean, is_meta boolean, role string, input_tokens bigint, "
    "output_tokens bigint, cache_read bigint, cache_creation bigint, duration_ms bigint, "
    "text_len bigint, text_head string, blob_hash string"
)

TOOL_CALLS = columns_of(
    "event_id string, session_id string, ts string, tool_name string, args_json string, "
    "args_blob_hash string, result_size bigint, result_blob_hash string, success boolean, "
    "duration_ms bigint, retry_attempt int, position_in_session int, block_idx int, "
    "file_path string, old_string string"
)

SKILL_INVOCATIONS = columns_of(
    "session_id string, ts string, skill_name string, args string, triggered_by string, "
    "followed_by_tools array<string>"
)

TOOL_SEQUENCES = columns_of(
    "session_id string, n int, sequence array<string>, count int, first_ts string, last_ts string"
)

PAYLOADS = columns_of("prefix string, hash string, content string")
MANIFEST = columns_of("session_id string, last_ts string")
FILES = columns_of("path string, session_id string, size bigint, modified bigint, place bigint, mark string")

# Parsed lines as stored (redacted), so that a grown file is read from its old end on only.
LINES = columns_of(
    "session_id string, path string, line bigint, status string, is_event boolean, type string, ts string, uuid string, "
    "parent_uuid string, subtype string, is_sidechain boolean, is_meta boolean, role string, model string, "
    "ai_title string, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_creation bigint, "
    "duration_ms bigint, text_len bigint, text_head string, slash string"
) | {
    "blocks": "array<struct<block_idx:int,kind:string,tool_name:string,link:string,args_json:string,skill:string,"
              "skill_args:string,file_path:string,old_string:string,size:bigint,ok:boolean>>",
    "message": "struct<ts:string,text:string>",
}

USER_MESSAGES = columns_of(
    "session_id string, path string, cwd string, is_subagent boolean, block string, line bigint, ts string, text string")

SIGNALS = {
    "signal_bloat": "session_id string, event_id string, tool_name string, result_size bigint, "
    "next_output_tokens bigint, ratio double",
    "signal_compaction_proximity": "session_id string, window_turns int, tokens bigint",
    "signal_redundant_reads": "session_id string, file_path string, count int",
    "signal_oversized_agent": "session_id string, event_id string, args_len int, result_size bigint",
    "signal_skill_eligible_missed": "session_id string, skill_name string, position int",
    "signal_skill_abandoned": "session_id string, skill_name string, ts string, correction string",
    "signal_skill_turnaround": "session_id string, skill_name string, ts string, tokens_to_user bigint",
    "signal_recurring_sequences": "sequence array<string>, n int, sessions int, projects int",
    "signal_correction_clusters": "preceding_tools array<string>, occurrences int",
    "signal_repeated_path_fixes": "session_id string, before string, after string",
}

BASE_TABLES = {
    "sessions": SESSIONS,
    "events": EVENTS,
    "tool_calls": TOOL_CALLS,
    "skill_invocations": SKILL_INVOCATIONS,
    "tool_sequences": TOOL_SEQUENCES,
    "user_messages": USER_MESSAGES,
    "lines": LINES,
}

#: Signals of single sessions, kept by piece; the others are totals over all sessions.
SESSION_SIGNALS = [n for n in SIGNALS if n not in ("signal_recurring_sequences", "signal_correction_clusters")]

# What the totals are made of, for each piece, and the totals; which pieces are in them.
PARTS = {
    "recurring_parts": columns_of("sequence array<string>, n int, project string, sessions bigint"),
    "recurring_totals": columns_of("sequence array<string>, n int, project string, sessions bigint"),
    "cluster_parts": columns_of("preceding_tools array<string>, occurrences bigint"),
    "cluster_totals": columns_of("preceding_tools array<string>, occurrences bigint"),
    "derived": columns_of("of_day string, of_bucket int, of_version string, params string"),
}


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Columns of ``schema`` in its order and types; missing ones become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
            for name, kind in schema.items()
        ]
    )


def json_text(df: DataFrame) -> DataFrame:
    """Render every ``array<string>`` column as JSON text."""
    arrays = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, ArrayType) and f.dataType.elementType.simpleString() == "string"
    ]
    return df.withColumns({c: array_json(F.col(c)) for c in arrays})
