"""Evidence on one skill: what was asked, and the full messages that came after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import keep_matching
from ..functions.jsontext import invocation_texts
from ..functions.once import computed_once
from ..functions.ordered import HeavyKeys, ordered
from ..functions.scratch import written
from ..functions.text import EXIT_TAG, normalize_path, scrub, strip
from ..operators.parse import message_text, typed_lines
from ..sources.jsonl import path_facts

FILE = ["session_id", "cwd"]


def matches_skill(name: Column, skill: str) -> Column:
    """The skill's name, its part after the first ':', or any prefix before that part."""
    suffix = skill.split(":", 1)[-1]
    return (name == skill) | (name == suffix) | name.like("%:" + suffix.replace("\\", "\\\\"))


def _with_file(lines: DataFrame, home_prefix: str = "", home: str = "") -> DataFrame:
    facts = path_facts(F.col("path"), home_prefix)
    facts["cwd"] = normalize_path(facts["cwd"], home)
    return lines.withColumns({k: facts[k] for k in ("session_id", "cwd", "is_subagent")})


def _typed(lines: DataFrame, home_prefix: str, *more: str) -> DataFrame:
    df = lines if "session_id" in lines.columns else _with_file(lines, home_prefix)
    return typed_lines(df).select("path", "session_id", "cwd", "block", "line", *more, "r")


def user_messages(lines: DataFrame, home_prefix: str = "") -> DataFrame:
    """Non-meta user messages with their full text, not blank.  The parse job keeps the same as a table."""
    df = computed_once(
        _typed(lines, home_prefix),
        {
            "is_message": F.col("r").isNotNull() & (F.col("r.type") == "user") & ~F.col("r.is_meta"),
            "ts": F.coalesce("r.timestamp", F.lit("")),
            "text": message_text(),
        },
    )
    return df.filter(F.col("is_message") & (strip(F.col("text")) != "")).drop("r", "is_message")


def invocation_text(lines: DataFrame, invocations: DataFrame, home_prefix: str = "") -> DataFrame:
    """Text of the first line at an invocation's time that has content, redacted.

    ``invocations`` has (session_id, cwd, ts).  Python sees the chosen lines only, and refused ones.
    """
    df = computed_once(
        _typed(lines, home_prefix, "value"),
        {"has_content": F.col("r.content").isNotNull() | F.coalesce("r.is_list", F.lit(False)), "ts": F.col("r.timestamp")},
    ).filter(F.col("has_content") & F.col("ts").isNotNull()).drop("r")
    keys = [*FILE, "ts"]
    chosen = (
        df.join(invocations.select(*keys).distinct(), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.min_by(F.struct("path", "value"), F.struct("block", "line")).alias("c"))
    )
    return chosen.select(
        *keys, F.col("c.path").alias("path"), scrub(invocation_texts(F.col("c.value"))).alias("invocation_text")
    )


def followups(messages: DataFrame, invocations: DataFrame, window: int = 5,
              heavy: HeavyKeys | None = None) -> DataFrame:
    """The first ``window`` messages in file order that are later than an invocation.

    Result: (session_id, cwd, ts, path, followups array<struct<ts, text>>).
    """
    keys = [*FILE, "ts"]
    at = F.struct("block", "line")
    marks = messages.select(*keys, F.lit(0).alias("rank"), at.alias("at"))
    asks = invocations.select(*keys).distinct().select(
        *keys, F.lit(1).alias("rank"), F.lit(None).cast(marks.schema["at"].dataType).alias("at")
    )
    # Backwards in time, keep the places of the earliest lines seen; texts join afterwards.
    picked = (
        ordered(marks.unionByName(asks), FILE, ["ts", "rank"], heavy, reverse=True)
        .top_k("places", F.col("at"), window, largest=False)
        .result()
        .filter(F.col("rank") == 1)
        .select(*keys, F.posexplode("places").alias("i", "at"))
    )
    texts = messages.select(*FILE, at.alias("at"), "path", F.col("ts").alias("m_ts"), "text")
    return (
        picked.join(texts, [*FILE, "at"])
        .groupBy(*keys)
        .agg(
            F.max("path").alias("path"),
            F.array_sort(F.collect_list(F.struct(  # at most `window` entries
                "i", F.col("m_ts").alias("ts"), scrub(F.col("text")).alias("text")))).alias("f"),
        )
        .select(*keys, "path", F.transform("f", lambda x: F.struct(x.ts.alias("ts"), x.text.alias("text")))
                .alias("followups"))
    )


def skill_evidence(skill: str, lines: DataFrame, skills: DataFrame, sessions: DataFrame,
                   window: int = 5, home_prefix: str = "", home: str = "", with_children: bool = True,
                   heavy: HeavyKeys | None = None, messages: DataFrame | None = None) -> DataFrame:
    """One record per invocation of a skill, by time; left out if the user then left the session.

    ``with_children`` false leaves the texts of child sessions empty.  ``messages`` is the stored table of
    user messages; with it the raw lines are read for the invocations only.
    """
    # Read several times below, and small against the tables it comes from.
    found = written(
        skills.filter(matches_skill(F.col("skill_name"), skill))
        .select("session_id", "ts")
        .groupBy("session_id", "ts")
        .agg(F.count(F.lit(1)).alias("times"))
        .join(sessions.select("session_id", "project", "cwd"), "session_id")
    )
    located = _with_file(lines, home_prefix, home)
    if not with_children:
        located = located.filter(~F.col("is_subagent"))
    # The raw lines are scanned once; what follows reads the lines of these sessions.
    mine = written(keep_matching(located, found, FILE))
    keys = [*FILE, "ts"]
    asked = invocation_text(mine, found)
    if messages is None:
        said = user_messages(mine)
    else:
        said = written(keep_matching(messages if with_children else messages.filter("not is_subagent"), found, FILE))
    after = followups(said, found, window, heavy)
    none = F.array().cast("array<struct<ts:string,text:string>>")
    rows = (
        found.join(asked.withColumnRenamed("path", "a_path"), keys, "left")
        .join(after, keys, "left")
        .withColumns(
            {
                "path": F.coalesce("path", "a_path"),
                "invocation_text": F.coalesce("invocation_text", F.lit("")),
                "followups": F.coalesce("followups", none),
            }
        )
    )
    left = F.coalesce(F.try_element_at("followups", F.lit(1)).text.contains(EXIT_TAG), F.lit(False))
    return (
        rows.filter(~left)
        .withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        .orderBy("ts", "session_id")
        .select("session_id", F.col("ts").alias("invocation_ts"), "project", "path",
                "invocation_text", "followups")
    )
