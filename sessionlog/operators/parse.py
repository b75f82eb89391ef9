"""Session lines to typed tables.

``typed_lines`` reads each line once: as VARIANT inside the JVM, or, where VARIANT refuses it (over
16 MiB, a key given twice, NaN), in Python, straight into the same typed fields.  ``parse_lines`` leaves
one typed row per line, and the other functions derive the base tables from it.  Apart from refused lines,
only the exact JSON text of tool arguments and structured results needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import ARGS_CHARS, LINE_FIELDS, block_texts, line_fields, read_json
from ..functions.ordered import (
    HeavyKeys, ordered, running_last, running_min, running_sum, running_tail,
)
from ..functions.text import lstrip, normalize_path, scrub, slash_command, strip
from ..schemas import EVENTS, SESSIONS, SKILL_INVOCATIONS, TOOL_CALLS, conform
from ..sources.jsonl import path_facts

# Lengths at which stored text is cut.
HEAD_CHARS = 240
#: Lines from so many bytes on are not given to VARIANT, which refuses values of that size.
LONG_BYTES = 16 << 20
FOLLOWED_BY = 5


def _field(path: str, kind: str = "string") -> str:
    return f"try_variant_get(v, '$.line.{path}', '{kind}')"


def _truthy(text: str) -> str:
    return f"coalesce({text} NOT IN ('', 'false', '0', '0.0', '[]', '{{}}'), false)"


# Content blocks of a line, as far as they can be read inside the JVM.
_RAW_BLOCKS = f"""transform(filter(items, b -> schema_of_variant(b) LIKE 'OBJECT%'), b -> struct(
    try_variant_get(b, '$.type', 'string') AS kind,
    try_variant_get(b, '$.text', 'string') AS text,
    coalesce(nullif(try_variant_get(b, '$.name', 'string'), ''), 'unknown') AS tool_name,
    coalesce(try_variant_get(b, '$.id', 'string'), try_variant_get(b, '$.tool_use_id', 'string')) AS link,
    {_truthy("try_variant_get(b, '$.is_error', 'string')")} AS is_error,
    schema_of_variant(try_variant_get(b, '$.content', 'variant')) AS shape,
    try_variant_get(b, '$.input.file_path', 'string') AS file_path,
    try_variant_get(b, '$.input.old_string', 'string') AS old_string,
    length(try_variant_get(b, '$.content', 'string')) AS content_chars))"""

_IS_LIST = "coalesce(items IS NOT NULL, false)"
_CONTENT = f"""CASE WHEN items IS NULL AND schema_of_variant({_field("message.content", "variant")}) = 'STRING'
    THEN {_field("message.content")} END"""

# The fields of a line, in the order of LINE_FIELDS.
_FIELDS = [
    _field("type"), _field("timestamp"), _field("ts"), _field("uuid"), _field("leafUuid"), _field("parentUuid"),
    _field("subtype"), _truthy(_field("isSidechain")), _truthy(_field("isMeta")), _field("message.role"),
    _field("message.model"), _field("aiTitle"), _field("message.usage.input_tokens", "bigint"),
    _field("message.usage.output_tokens", "bigint"), _field("message.usage.cache_read_input_tokens", "bigint"),
    _field("message.usage.cache_creation_input_tokens", "bigint"), _field("durationMs", "bigint"),
    _CONTENT, _IS_LIST, _RAW_BLOCKS, "NULL",
]
_READ = f"""CASE WHEN coalesce(try_variant_get(v, '$.line_end', 'boolean'), false)
    THEN CAST(struct({", ".join(_FIELDS)}) AS STRUCT<{LINE_FIELDS}>) END"""

_PAYLOAD = """coalesce(r.content, array_join(transform(filter(r.blocks, b -> b.kind = 'text'), b -> coalesce(b.text, '')), '\n'))"""

_STATUS = "CASE WHEN blank THEN 'blank' WHEN r IS NOT NULL AND brace THEN 'ok' ELSE 'bad' END"

# Calls, and results that are no plain text, need their exact JSON text.
_NEEDS_TEXT = """brace AND exists(seen.blocks,
    b -> b.kind = 'tool_use' OR (b.kind = 'tool_result' AND b.shape != 'STRING'))"""

_TOOL_BLOCKS = """filter(transform(r.blocks, (b, i) -> struct(
    i AS block_idx, b.kind AS kind, b.tool_name AS tool_name, b.link AS link,
    get(texts, i).args_json AS args_json, get(texts, i).skill AS skill, get(texts, i).skill_args AS skill_args,
    CASE WHEN b.kind = 'tool_use' THEN b.file_path END AS file_path,
    CASE WHEN b.kind = 'tool_use' AND b.tool_name = 'Edit' THEN b.old_string END AS old_string,
    CASE WHEN b.kind != 'tool_result' THEN NULL
         WHEN b.shape = 'STRING' THEN CAST(b.content_chars AS BIGINT)
         ELSE coalesce(get(texts, i).size, 2L) END AS size,
    NOT b.is_error AS ok)), b -> b.kind IN ('tool_use', 'tool_result')) AS blocks"""

_LINE_COLUMNS = [
    "path", "block", "line", "status",
    "status = 'ok' AND type != 'ai-title' AS is_event",
    "type",
    "coalesce(nullif(r.timestamp, ''), nullif(r.ts, ''), '') AS ts",
    "coalesce(nullif(r.uuid, ''), nullif(r.leaf_uuid, '')) AS uuid",
    "r.parent_uuid AS parent_uuid", "r.subtype AS subtype",
    "r.is_sidechain AS is_sidechain", "r.is_meta AS is_meta",
    "r.role AS role", "nullif(r.model, '') AS model", "r.ai_title AS ai_title",
    "r.input_tokens AS input_tokens", "r.output_tokens AS output_tokens",
    "r.cache_read AS cache_read", "r.cache_creation AS cache_creation", "r.duration_ms AS duration_ms",
    "CAST(length(payload) AS BIGINT) AS text_len",
    "head AS text_head",
    "slash",
    _TOOL_BLOCKS,
    "message",
]


def typed_lines(lines: DataFrame, args_chars: int | None = ARGS_CHARS) -> DataFrame:
    """``lines`` with ``r``: their LINE_FIELDS, null if they are no JSON, and ``texts`` of blocks that need them.

    ``blank`` and ``brace`` say whether a stripped line is empty or begins an object.  Only lines that VARIANT refuses
    go to Python whole, and those of ``LONG_BYTES`` at once; VARIANT also reads JSON that is no object as null.
    A long line is in one column at a time: beside it no other column of a row has its text.
    """
    text = F.col("text")
    df = lines.withColumn("text", strip(F.col("value")))
    df = df.withColumns({"blank": text == "", "brace": text.startswith("{"),
                         "v": read_json(F.when(F.octet_length(text) < LONG_BYTES, text))})
    df = df.withColumn("items", F.expr(_field("message.content", "array<variant>")))
    df = df.withColumn("seen", F.expr(_READ)).drop("items")
    df = df.withColumns({"refused": F.when(F.col("v").isNull() & F.col("brace"), text),
                         "whole": F.when(F.expr(_NEEDS_TEXT), text)}).drop("text", "v")
    df = df.withColumns({"read": line_fields(F.col("refused"), args_chars),
                         "texts": block_texts(F.col("whole"), args_chars)}).drop("refused", "whole")
    return df.withColumn("r", F.coalesce("seen", "read")).drop("seen", "read")


def message_text() -> Column:
    """Text of a typed line: its content, or its text blocks; null if it has neither."""
    return F.expr(_PAYLOAD)


def parse_lines(lines: DataFrame, args_chars: int | None = ARGS_CHARS,
                scrub_first: bool = False) -> DataFrame:
    """One typed row per line: status, event fields, content blocks, and the whole text of user messages.

    ``status`` is ok, blank, or bad (not a JSON object).  Items of a content list that
    are not objects are left out.  ``message`` (ts, text) is there for user messages that are not meta and
    not blank.  ``scrub_first`` redacts message heads before they are cut.  Write the result
    out before filtering or reading it more than once: filters on it would parse again.
    """
    payload = F.col("payload")
    df = typed_lines(lines, args_chars)
    df = df.withColumns(
        {
            "payload": F.nullif(message_text(), F.lit("")),
            "status": F.expr(_STATUS),
            "type": F.coalesce("r.type", F.lit("other")),
        }
    )
    said = (F.col("status") == "ok") & (F.col("r.type") == "user") & ~F.col("r.is_meta") & (lstrip(payload) != "")
    df = df.withColumns(
        {
            "head": F.substring(scrub(payload) if scrub_first else payload, 1, HEAD_CHARS),
            "slash": F.when(F.col("type") == "user", slash_command(payload)),
            "texts": F.coalesce("r.texts", "texts"),
            "message": F.when(said, F.struct(F.coalesce("r.timestamp", F.lit("")).alias("ts"), payload.alias("text"))),
        }
    )
    return df.selectExpr(*_LINE_COLUMNS)


def user_messages(parsed: DataFrame, home_prefix: str = "", home: str = "") -> DataFrame:
    """Messages of parsed lines: path, session_id, cwd, block, line, ts, text."""
    facts = path_facts(F.col("path"), home_prefix)
    return parsed.filter("message is not null").select(
        "path", facts["session_id"].alias("session_id"), normalize_path(facts["cwd"], home).alias("cwd"),
        "block", "line", "message.ts", "message.text")


def bad_lines(parsed: DataFrame) -> DataFrame:
    """Where lines were left out because they are no session lines."""
    return parsed.filter(F.col("status") == "bad").select("path", "block", "line")


def with_positions(parsed: DataFrame, split_files: bool = True, home_prefix: str = "") -> DataFrame:
    """Event lines with ``pos`` (0-based index among the file's event lines) and ``event_id``.

    ``split_files`` false says that no file has more than one block.
    """
    rows = parsed.filter("is_event")
    o = ordered(
        rows, ["path"], ["block", "line"],
        heavy=HeavyKeys(()), block=F.col("block") if split_files else None,
    ).running({"pos": running_sum(F.lit(1))})
    facts = path_facts(F.col("path"), home_prefix)
    return (
        o.result()
        .withColumns({"pos": F.col("pos").cast("int"), "session_id": facts["session_id"]})
        .withColumn(
            "event_id",
            F.coalesce("uuid", F.concat_ws(":", "session_id", F.col("pos").cast("string"))),
        )
    )


def normalize_events(positioned: DataFrame, scrub_text: bool = True) -> DataFrame:
    """The events table.  ``scrub_text`` redacts the cut head, as loading does."""
    if scrub_text:
        positioned = positioned.withColumn("text_head", scrub(F.col("text_head")))
    return conform(positioned, EVENTS)


def explode_blocks(positioned: DataFrame) -> DataFrame:
    """One row per tool block of an event line."""
    return positioned.filter(F.size("blocks") > 0).select(
        "path", "session_id", "block", "line", "pos", "event_id", "ts", F.inline("blocks")
    )


def attach_results(blocks: DataFrame, keys: list[str], order: list[str],
                   heavy: HeavyKeys | None = None, block: Column | None = None,
                   pair_by: str = "order") -> DataFrame:
    """Tool calls with the results that belong to them.

    A result belongs to the latest call before it (``pair_by='order'``), or to the
    call whose id it names (``'tool_use_id'``).  The size is the largest result's,
    the success that of the last result.
    """
    call = F.col("kind") == "tool_use"
    result = F.col("kind") == "tool_result"
    at = F.struct(*order)
    call_cols = [c for c in ("session_id", "event_id", "ts", "tool_name", "args_json", "skill",
                             "skill_args", "file_path", "old_string", "pos", "block_idx") if c in blocks.columns]
    outcome = [
        F.max(F.when(result, F.col("size"))).alias("size"),
        F.max_by("ok", F.when(result, at)).alias("ok"),
    ]
    if pair_by == "tool_use_id":
        outcomes = blocks.filter(result).groupBy(*keys, "link").agg(*outcome)
        calls = blocks.filter(call).drop("size", "ok").join(outcomes, [*keys, "link"], "left")
    else:
        # The running call and its results stay on the key's partitions; a long
        # key's groups are pre-aggregated before they move.
        o = ordered(blocks, keys, order, heavy, block=block).running(
            {"_call": running_last(F.when(call, at), inclusive=True)}
        )
        calls = (
            o.result()
            .filter(F.col("_call").isNotNull())
            .groupBy(*keys, "_call")
            # One call row per group; column by column, so that unused ones are pruned.
            .agg(*[F.max(F.when(call, F.col(c))).alias(c) for c in call_cols if c not in keys], *outcome)
            .drop("_call")
        )
    return calls.withColumns(
        {
            "result_size": F.coalesce("size", F.lit(0).cast("bigint")),
            "success": F.coalesce("ok", F.lit(True)),
            "position_in_session": F.col("pos"),
            "retry_attempt": F.lit(0),
        }
    ).drop("size", "ok", "pos")


def tool_calls(positioned: DataFrame, split_files: bool = True, pair_by: str = "order",
               scrub_args: bool = True) -> DataFrame:
    """The tool_calls table of a parse job (with ``path``, ``skill``, ``skill_args``)."""
    calls = attach_results(
        explode_blocks(positioned), ["path"], ["block", "line", "block_idx"],
        heavy=HeavyKeys(()), block=F.col("block") if split_files else None, pair_by=pair_by,
    )
    return calls.withColumn("args_json", scrub(F.col("args_json"))) if scrub_args else calls


def conform_calls(calls: DataFrame) -> DataFrame:
    """The stored columns of tool_calls; long arguments get the hash of their payload."""
    if "args_blob_hash" not in calls.columns:
        calls = calls.withColumn(
            "args_blob_hash",
            F.when(F.length("args_json") >= ARGS_CHARS, F.sha2(F.col("args_json").cast("binary"), 256)),
        )
    return conform(calls.withColumn("args_json", F.substring("args_json", 1, ARGS_CHARS)), TOOL_CALLS)


def slash_skills(positioned: DataFrame) -> DataFrame:
    """Skills a user called as a slash command."""
    return positioned.filter(F.col("slash").isNotNull()).select(
        "path", "session_id", "ts", F.col("slash").alias("skill_name"),
        F.lit(None).cast("string").alias("args"), F.lit("user_slash").alias("triggered_by"),
        "pos", F.lit(-1).alias("block_idx"),
    )


def tool_skills(calls: DataFrame) -> DataFrame:
    """Skills called through the Skill tool."""
    return calls.filter(F.col("skill").isNotNull()).select(
        "path", "session_id", "ts", F.col("skill").alias("skill_name"),
        F.col("skill_args").alias("args"), F.lit("auto").alias("triggered_by"),
        F.col("position_in_session").alias("pos"), "block_idx",
    )


def followed_by_tools(skills: DataFrame, calls: DataFrame, keys: list[str],
                      heavy: HeavyKeys | None = None, k: int = FOLLOWED_BY) -> DataFrame:
    """Add the names of the ``k`` calls from the first call (in file order) not before the skill."""
    nxt = (
        ordered(calls, keys, ["position_in_session", "block_idx"], heavy, reverse=True)
        .running({"names": running_tail(F.col("tool_name"), k)})
        .result()
        .select(
            *keys, "ts", F.lit(1).alias("rank"),
            F.struct(
                F.col("position_in_session").alias("p"), F.col("block_idx").alias("b"),
                F.reverse("names").alias("names"),
            ).alias("call"),
            F.lit(None).cast(skills.schema.simpleString()).alias("s"),
        )
    )
    ask = skills.select(
        *keys, "ts", F.lit(0).alias("rank"), F.lit(None).cast(nxt.schema["call"].dataType).alias("call"),
        F.struct(*skills.columns).alias("s"),
    )
    found = (
        ordered(nxt.unionByName(ask), keys, ["ts", "rank"], heavy, reverse=True)
        .running({"first": running_min(F.col("call"))})
        .result()
        .filter(F.col("rank") == 0)
    )
    empty = F.array().cast("array<string>")
    return found.select("s.*", F.coalesce(F.col("first.names"), empty).alias("followed_by_tools"))


def skill_invocations(positioned: DataFrame, calls: DataFrame,
                      heavy: HeavyKeys | None = None) -> DataFrame:
    """The skill_invocations table of a parse job (with ``path``)."""
    skills = slash_skills(positioned).unionByName(tool_skills(calls))
    return followed_by_tools(skills, calls, ["path"], heavy)


def session_rollup(parsed: DataFrame, home_prefix: str = "", home: str = "") -> DataFrame:
    """The sessions table: one row per file, also for a file without a valid line."""
    at = F.struct("block", "line")
    valid, event = F.col("status") == "ok", F.col("is_event")
    timed = F.when(valid & (F.col("ts") != ""), at)
    total = lambda c: F.coalesce(F.sum(F.when(event, F.col(c))), F.lit(0)).alias(
        {"input_tokens": "total_input_tokens", "output_tokens": "total_output_tokens",
         "cache_read": "total_cache_read_tokens",
         "cache_creation": "total_cache_creation_tokens"}[c])
    rolled = parsed.groupBy("path").agg(
        F.min_by("ts", timed).alias("started_at"),
        F.max_by("ts", timed).alias("ended_at"),
        F.count_if(event & F.col("type").isin("user", "assistant")).cast("int").alias("message_count"),
        total("input_tokens"), total("output_tokens"), total("cache_read"), total("cache_creation"),
        F.count_if(event & (F.col("type") == "system") & (F.col("subtype") == "compaction"))
        .cast("int").alias("compaction_count"),
        F.max_by("model", F.when(event & F.col("model").isNotNull(), at)).alias("model"),
        F.max_by("ai_title", F.when(valid & (F.col("type") == "ai-title"), at)).alias("ai_title"),
    )
    facts = path_facts(F.col("path"), home_prefix)
    facts["cwd"] = normalize_path(facts["cwd"], home)
    rolled = rolled.withColumns({**facts, "ingested_at": F.current_timestamp()})
    return conform(rolled, {"path": "string", **SESSIONS})
