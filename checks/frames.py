"""Session-log tables derived from the given ``events`` and ``conversations`` tables.

One user is one session.  What each event stands for follows from its type and
the number in its ``props``; ``checks.oracle`` has the same rules in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlog.functions.ordered import (
    BLOCK_ROWS, HeavyKeys, heavy_keys, ordered, running_sum,
)
from sessionlog.functions.scratch import written
from sessionlog.functions.text import slash_command
from sessionlog.operators import parse
from sessionlog.operators.sequences import tool_sequences
from sessionlog.schemas import EVENTS, SESSIONS, SKILL_INVOCATIONS, conform

SIGNATURES = {
    "skill0": {"signature": ["Read", "Edit", "Read"], "reason": "reads around an edit"},
    "skill1": {"signature": ["Agent", "Agent"], "reason": "two dispatches in a row"},
    "review": {"signature": ["Edit", "Edit", "Read", "Agent"], "reason": "edits, then a dispatch"},
    "empty": {"signature": [], "reason": "left out"},
}
UUID_HEAD = "00000000-0000-0000-0000-"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def two_digits(n):
    return F.lpad(n.cast("string"), 2, "0")


def iso(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def refused(line, when, n):
    """Now and then a line that says the same, with a key given twice or NaN: some JSON readers refuse it."""
    rest = F.substring(line, F.lit(2), F.length(line))
    return F.when(when & (n % 4 == 1), F.concat(F.lit('{"type":"other",'), rest)).when(
        when & (n % 4 == 2), F.concat(F.lit('{"cost":NaN,'), rest)).otherwise(line)


#: Documents whose session line is repeated up to more characters than VARIANT takes, and to how many.
LONG_EVERY, LONG_CHARS = 5_000, 17 << 20


@dataclass
class Frames:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def raw(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        et = F.col("event_type")
        is_compaction = (et == "error") & (F.col("k") % 10 == 0)
        kind = (
            F.when(et.isin("view", "click", "purchase"), "assistant")
            .when(is_compaction, "system")
            .otherwise("user")
        )
        return (
            table(self.spark, self.sf_dir, "events")
            .select("user_id", "event_id", "ts", "event_type", "value", k.alias("k"))
            .select(
                F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
                "user_id",
                F.col("event_id").alias("event_no"),
                F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
                iso(F.col("ts")).alias("ts"),
                "event_type", "k", "value",
                kind.alias("type"),
                F.when(is_compaction, "compaction").alias("subtype"),
                F.nullif(kind, F.lit("system")).alias("role"),
                ((et == "signup") & (F.col("k") % 8 == 7)).alias("is_meta"),
                F.when(kind == "assistant", F.floor(F.col("value") * 10).cast("bigint")).alias("output_tokens"),
                F.when(
                    et == "signup",
                    F.when(F.col("k") % 4 == 0, F.concat(F.lit("/skill"), (F.col("k") % 3).cast("string"), F.lit(" go")))
                    .when(F.col("k") % 4 == 1, F.concat(F.lit("no, use /f"), (F.col("k") % 20).cast("string")))
                    .when(F.col("k") % 4 == 2, "Wait - look again")
                    .otherwise("please continue"),
                ).alias("text_head"),
                F.when(et == "view", "Read").when(et == "click", "Edit").when(et == "purchase", "Agent").alias("tool_name"),
                ((et == "error") & ~is_compaction).alias("is_result"),
            )
        )

    @cached_property
    def heavy(self) -> HeavyKeys:
        """Users above the block size; one count over the user column serves every query."""
        users = table(self.spark, self.sf_dir, "events").select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id")
        )
        return heavy_keys(users, block_rows=BLOCK_ROWS)

    @cached_property
    def positioned(self) -> DataFrame:
        return (
            ordered(self.raw, ["session_id"], ["ts", "event_no"], self.heavy)
            .running({"pos": running_sum(F.lit(1))})
            .result()
            .withColumn("pos", F.col("pos").cast("int"))
        )

    @cached_property
    def events(self) -> DataFrame:
        return conform(
            self.raw.withColumns(
                {"is_sidechain": F.lit(False), "text_len": F.length("text_head").cast("bigint")}
            ),
            EVENTS,
        )

    @cached_property
    def blocks(self) -> DataFrame:
        k = F.col("k")
        return self.positioned.filter(F.col("tool_name").isNotNull() | F.col("is_result")).select(
            "session_id", "event_id", "ts", "pos",
            F.lit(0).alias("block_idx"),
            F.when(F.col("is_result"), "tool_result").otherwise("tool_use").alias("kind"),
            "tool_name",
            F.concat(F.lit('{"file_path": "/f'), (k % 20).cast("string"), F.lit('"}')).alias("args_json"),
            F.floor(F.col("value") * 100).cast("bigint").alias("size"),
            (k % 2 == 0).alias("ok"),
        )

    @cached_property
    def tool_calls(self) -> DataFrame:
        return parse.conform_calls(
            parse.attach_results(self.blocks, ["session_id"], ["pos", "block_idx"], self.heavy)
        )

    @cached_property
    def bare_skills(self) -> DataFrame:
        """Skill invocations without the tools after them."""
        return (
            self.raw.filter(F.col("type") == "user")
            .withColumn("skill_name", slash_command(F.col("text_head")))
            .filter(F.col("skill_name").isNotNull())
            .select("session_id", "ts", "skill_name", F.lit(None).cast("string").alias("args"),
                    F.lit("user_slash").alias("triggered_by"))
        )

    @cached_property
    def skills(self) -> DataFrame:
        return conform(
            parse.followed_by_tools(self.bare_skills, self.tool_calls, ["session_id"], self.heavy),
            SKILL_INVOCATIONS,
        )

    @cached_property
    def sessions(self) -> DataFrame:
        user = F.col("user_id")
        child = user % 10 == 3
        rolled = self.raw.groupBy("session_id", "user_id").agg(
            F.min("ts").alias("started_at"),
            F.max("ts").alias("ended_at"),
            F.count_if(F.col("type").isin("user", "assistant")).alias("message_count"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"),
            F.count_if(F.col("subtype") == "compaction").alias("compaction_count"),
        )
        return conform(
            rolled.withColumns(
                {
                    "project": F.concat(F.lit("p"), (user % 7).cast("string")),
                    "cwd": F.concat(F.lit("/Users/test/p"), (user % 7).cast("string")),
                    "is_subagent": child,
                    "parent_session_id": F.when(child, F.concat(F.lit("u"), (user - 3).cast("string"))),
                }
            ),
            SESSIONS,
        )

    @cached_property
    def sequences(self) -> DataFrame:
        return tool_sequences(self.tool_calls, heavy=self.heavy)

    # -- text lines ---------------------------------------------------------

    def _lines(self, rows: DataFrame, line: str, path, value, heavy: HeavyKeys) -> DataFrame:
        """Lines of session files; a heavy session has one block per ``block_rows`` lines."""
        block = F.lit("")
        if heavy.keys:
            at = F.floor(F.col(line) / heavy.block_rows).cast("string")
            block = F.when(F.col("session_id").isin(*heavy.keys), F.lpad(at, 20, "0")).otherwise("")
        return rows.select(
            path.alias("path"), block.alias("block"), F.col(line).cast("bigint").alias("line"),
            value.alias("value"),
        )

    @property
    def path(self):
        """File of a session: children lie below a folder named by the parent's UUID."""
        user = F.col("user_id")
        folder = F.concat(F.lit("/logs/-Users-test-p"), (user % 7).cast("string"), F.lit("/"))
        parent = F.concat(F.lit(UUID_HEAD), F.lpad((user - 3).cast("string"), 12, "0"), F.lit("/subagents/"))
        return F.concat(
            folder, F.when(user % 10 == 3, parent).otherwise(""), F.col("session_id"), F.lit(".jsonl")
        )

    @cached_property
    def lines(self) -> DataFrame:
        """The events as JSON lines, with a title line, a blank line and a broken line now and then."""
        k, et = F.col("k"), F.col("event_type")
        is_skill = (et == "click") & (k % 9 == 4)
        use = F.struct(
            F.lit("tool_use").alias("type"),
            F.col("event_id").alias("id"),
            F.when(is_skill, "Skill").otherwise(F.col("tool_name")).alias("name"),
            F.when(
                is_skill,
                F.struct(
                    F.lit(None).cast("string").alias("file_path"),
                    F.concat(F.lit("skill"), (k % 3).cast("string")).alias("skill"),
                    F.concat(F.lit("run é"), k.cast("string")).alias("args"),
                ),
            ).otherwise(
                F.struct(
                    F.concat(F.lit("/f"), (k % 20).cast("string")).alias("file_path"),
                    F.lit(None).cast("string").alias("skill"),
                    F.lit(None).cast("string").alias("args"),
                )
            ).alias("input"),
        )
        size = F.floor(F.col("value") * 100).cast("int")
        # A result is a text of the given size, or (k % 3 = 0) a list of numbers and a text.
        listed = F.concat(F.lit("["), k.cast("string"), F.lit(',"é",null]'))
        result = F.concat(
            F.lit('[{"type":"tool_result","is_error":'), (k % 2 == 1).cast("string"), F.lit(',"content":'),
            F.when(k % 3 == 0, listed).otherwise(F.concat(F.lit('"'), F.repeat(F.lit("x"), size), F.lit('"'))),
            F.lit("}]"),
        )
        texts = F.to_json(F.array(
            F.struct(F.lit("text").alias("type"), F.col("text_head").alias("text")),
            F.struct(F.lit("text").alias("type"), F.lit("zwei 😀").alias("text")),
        ))
        content = (
            F.when(F.col("tool_name").isNotNull(), F.to_json(F.array(use)))
            .when(F.col("is_result"), result)
            .when(F.col("text_head").isNotNull() & (k % 5 == 0), texts)
            .otherwise(F.concat(F.lit('"'), F.coalesce("text_head", F.lit("")), F.lit('"')))
        )
        head = F.to_json(
            F.struct(
                "type", "subtype", F.col("ts").alias("timestamp"), F.col("is_meta").alias("isMeta"),
                F.when(k % 7 > 0, F.col("event_id")).alias("uuid"),
            )
        )
        usage = F.to_json(F.struct(
            (k + 1).alias("input_tokens"), "output_tokens", k.alias("cache_read_input_tokens")))
        value = F.concat(
            F.substring(head, F.lit(1), F.length(head) - 1),
            F.lit(',"message":{"role":'), F.coalesce(F.concat(F.lit('"'), "role", F.lit('"')), F.lit("null")),
            F.lit(',"model":"m'), (k % 3).cast("string"), F.lit('","usage":'), usage,
            F.lit(',"content":'), content, F.lit("}}"),
        )
        value = refused(value, et.isin("view", "signup", "error"), k)
        texts_of_event = F.array(
            value,
            F.when((et == "error") & (k % 10 == 0),
                   F.concat(F.lit('{"type":"ai-title","aiTitle":"t'), k.cast("string"), F.lit('"}'))),
            F.when((et == "error") & (k % 10 == 1), F.lit("  \t ")),
            F.when((et == "error") & (k % 10 == 2), F.concat(value, F.lit("}"))),
            F.when((et == "error") & (k % 10 == 3), F.lit("[1]")),
            # Titles with a key given twice, with NaN, and beside an item that is no object.
            F.when((et == "error") & (k % 10 == 0),
                   F.concat(F.lit('{"type":"x","type":"ai-title","aiTitle":"u'), k.cast("string"), F.lit('"}'))),
            F.when((et == "error") & (k % 10 == 4), F.lit('{"type":"ai-title","aiTitle":"n","durationMs":NaN}')),
            F.when((et == "error") & (k % 10 == 5),
                   F.lit('{"type":"ai-title","aiTitle":"i","message":{"content":["bare",{"type":"text","text":"t"}]}}')),
        )
        rows = self.positioned.select(
            "session_id", "user_id", "pos", F.posexplode(texts_of_event).alias("i", "line_text")
        ).filter(F.col("line_text").isNotNull())
        rows = rows.withColumn("at", F.col("pos").cast("bigint") * 8 + F.col("i"))
        return self._lines(rows, "at", self.path, F.col("line_text"), self.heavy)

    @cached_property
    def parsed(self) -> DataFrame:
        """The parsed lines, written out as the ingest job does."""
        return written(parse.parse_lines(self.lines))

    @cached_property
    def talk_parsed(self) -> DataFrame:
        return written(parse.parse_lines(self.talk_lines))

    @property
    def split_files(self) -> bool:
        return bool(self.heavy.keys)

    @cached_property
    def parsed_events(self) -> DataFrame:
        return parse.with_positions(self.parsed, self.split_files)

    @cached_property
    def parsed_calls(self) -> DataFrame:
        return parse.tool_calls(self.parsed_events, self.split_files)

    @cached_property
    def parsed_skills(self) -> DataFrame:
        return parse.skill_invocations(
            self.parsed_events, self.parsed_calls, None if self.split_files else HeavyKeys(())
        )

    @cached_property
    def talk_heavy(self) -> HeavyKeys:
        talks = table(self.spark, self.sf_dir, "conversations").select(
            F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id")
        )
        return heavy_keys(talks, block_rows=BLOCK_ROWS)

    @cached_property
    def talk_lines(self) -> DataFrame:
        """The conversations as JSON lines with whole texts; odd turns split the text in two blocks."""
        conv = table(self.spark, self.sf_dir, "conversations").withColumn(
            "session_id", F.concat(F.lit("c"), F.col("conv_id").cast("string"))
        )
        text, cut = F.col("text"), F.floor(F.length("text") / 2).cast("int")
        block = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
        skill = F.struct(
            F.lit("tool_use").alias("type"), F.lit("Skill").alias("name"),
            F.struct(F.concat(F.lit("pack:talk"), (F.col("conv_id") % 2).cast("string")).alias("skill"),
                     F.lit("é").alias("args")).alias("input"),
        )
        one = F.to_json(F.struct(text.alias("content")))
        two = F.to_json(F.struct(F.array(
            block(F.substring(text, F.lit(1), cut)), block(F.substring(text, cut + 1, F.length(text)))
        ).alias("content")))
        call = F.to_json(F.struct(F.array(skill).alias("content")))
        message = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), call).when(
            F.col("turn") % 2 == 1, two).otherwise(one)
        head = F.to_json(F.struct(
            F.col("role").alias("type"),
            F.concat(F.lit("2026-01-01T"), two_digits(F.floor(F.col("turn") / 3600)), F.lit(":"),
                     two_digits(F.floor(F.col("turn") / 60) % 60), F.lit(":"), two_digits(F.col("turn") % 60), F.lit("Z"))
            .alias("timestamp"),
        ))
        value = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"message":'), message, F.lit("}"))
        value = refused(value, F.col("conv_id") % 3 == 1, F.col("turn") + F.col("conv_id"))
        path = F.concat(F.lit("/logs/-Users-test-talk/"), F.col("session_id"), F.lit(".jsonl"))
        return self._lines(conv, "turn", path, value, self.talk_heavy)

    @cached_property
    def long_lines(self) -> DataFrame:
        """Each document as a session of one line with a text, a call and a result; some lines are very long."""
        docs = table(self.spark, self.sf_dir, "documents").filter("text <> ''")
        times = F.when(F.col("doc_id") % LONG_EVERY == 0, F.ceil(F.lit(LONG_CHARS) / F.length("text"))).otherwise(1)
        quoted = F.to_json(F.array(F.repeat("text", times.cast("int"))))
        quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
        value = F.concat(
            F.lit('{"type":"user","timestamp":"2026-01-01T00:00:00Z","uuid":"d'), F.col("doc_id").cast("string"),
            F.lit('","message":{"role":"user","usage":{"input_tokens":7},"content":[{"type":"text","text":'), quoted,
            F.lit('},{"type":"tool_use","name":"Read","id":"t","input":{"file_path":"/f'), F.col("lang"),
            F.lit('"}},{"type":"tool_result","tool_use_id":"t","content":'), quoted, F.lit("}]}}"))
        return docs.select(
            F.concat(F.lit("/logs/-Users-test-docs/d"), F.col("doc_id").cast("string"), F.lit(".jsonl")).alias("path"),
            F.lit("").alias("block"), F.lit(0).cast("bigint").alias("line"), value.alias("value"))
