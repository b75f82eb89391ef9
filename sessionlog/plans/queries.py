"""Named queries over the stored tables and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import keep_matching
from ..functions.text import snippet
from ..schemas import json_text

# Event types hidden from a timeline unless asked for.
NOISE_TYPES = ("permission-mode", "file-history-snapshot", "last-prompt", "attachment")


def top_bloat(bloat: DataFrame, limit: int = 20) -> DataFrame:
    """Calls with the largest result for the fewest tokens after it."""
    return (
        bloat.orderBy(F.desc("ratio"), "session_id", "event_id")
        .limit(limit)
        .select("session_id", "tool_name", "result_size", "next_output_tokens", "ratio")
    )


def recurring(rec: DataFrame, min_sessions: int = 5, min_projects: int = 3, limit: int = 20) -> DataFrame:
    """Most widespread n-grams."""
    return (
        rec.filter((F.col("sessions") >= min_sessions) & (F.col("projects") >= min_projects))
        .orderBy(F.desc("sessions"), F.desc("projects"), "sequence", "n")
        .limit(limit)
        .select("sequence", "n", "sessions", "projects")
    )


def _health_rows(skills: DataFrame, abandoned: DataFrame, turnaround: DataFrame) -> DataFrame:
    none = F.lit(None).cast("bigint")
    return (
        skills.select("skill_name", F.lit(1).alias("i"), F.lit(0).alias("a"), none.alias("t"))
        .unionByName(abandoned.select("skill_name", F.lit(0).alias("i"), F.lit(1).alias("a"), none.alias("t")))
        .unionByName(turnaround.select("skill_name", F.lit(0).alias("i"), F.lit(0).alias("a"),
                                       F.col("tokens_to_user").alias("t")))
    )


def _health_aggs():
    return (
        F.coalesce(F.sum("i"), F.lit(0)).alias("invocations"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("abandoned"),
        F.avg("t").alias("avg_turnaround"),
    )


def skill_health(skills: DataFrame, abandoned: DataFrame, turnaround: DataFrame, name: str) -> DataFrame:
    """Invocations, abandoned ones and mean turnaround of one skill: one row."""
    pick = lambda df: df.filter(F.col("skill_name") == name)
    return _health_rows(pick(skills), pick(abandoned), pick(turnaround)).agg(*_health_aggs())


def skill_health_all(skills: DataFrame, abandoned: DataFrame, turnaround: DataFrame) -> DataFrame:
    """The same for every skill."""
    return _health_rows(skills, abandoned, turnaround).groupBy("skill_name").agg(*_health_aggs())


def session_timeline(events: DataFrame, calls: DataFrame, session_id: str,
                     sessions: DataFrame | None = None, with_subagents: bool = False) -> DataFrame:
    """Events of a session (and of its children) with their tool calls, in time order."""
    if with_subagents:
        wanted = sessions.filter(
            (F.col("parent_session_id") == session_id) | (F.col("session_id") == session_id)
        ).select("session_id")
        wanted = wanted.unionByName(
            events.filter(F.col("session_id") == session_id).select("session_id")
        ).distinct()
        e, t = (keep_matching(df, wanted, ["session_id"]) for df in (events, calls))
    else:
        e, t = (df.filter(F.col("session_id") == session_id) for df in (events, calls))
    t = t.select("event_id", "session_id", "tool_name", "block_idx", "result_blob_hash", "args_blob_hash")
    rows = e.join(t, ["event_id", "session_id"], "left").orderBy("ts", "event_id", "session_id", "block_idx")
    return rows.select(
        "ts", "type", "role", "tool_name", "output_tokens", "duration_ms", "text_len", "text_head",
        F.coalesce("blob_hash", "result_blob_hash", "args_blob_hash").alias("blob_hash"),
        *(["session_id"] if with_subagents else []),
    )


def timeline_view(timeline: DataFrame, verbose: bool = False, tools_only: bool = False) -> DataFrame:
    """A timeline for reading: noise hidden, short fields, ``-`` for what is missing."""
    tool = F.nullif(F.col("tool_name"), F.lit(""))
    df = timeline
    if tools_only:
        df = df.filter(tool.isNotNull())
    if not verbose:
        df = df.filter(tool.isNotNull() | ~F.coalesce(F.col("type").isin(*NOISE_TYPES), F.lit(False)))
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    number = lambda c: dash(F.nullif(F.col(c), F.lit(0)).cast("string"))
    cols = [
        dash(F.substring("ts", 12, 8)).alias("time"),
        F.coalesce(tool, "type").alias("event"),
        dash(F.col("role")).alias("role"),
        number("output_tokens").alias("out_tok"),
        number("duration_ms").alias("dur_ms"),
        F.coalesce("text_len", F.lit(0)).alias("len"),
        F.substring(dash(F.col("blob_hash")), 1, 12).alias("blob"),
    ]
    if "session_id" in timeline.columns:
        cols.append(dash(F.substring("session_id", 1, 8)).alias("from"))
    return df.select(*cols, dash(snippet(F.col("text_head"))).alias("head"))


def subagents(sessions: DataFrame, calls: DataFrame, parent_session_id: str) -> DataFrame:
    """Child sessions of a session with their number of tool calls."""
    children = sessions.filter(F.col("parent_session_id") == parent_session_id)
    counts = (
        calls.join(children.select("session_id"), "session_id", "left_semi")
        .groupBy("session_id").agg(F.count(F.lit(1)).alias("tool_calls"))
    )
    return (
        children.select("session_id", "started_at", "ended_at", "ai_title")
        .join(counts, "session_id", "left")
        .withColumn("tool_calls", F.coalesce("tool_calls", F.lit(0).cast("bigint")))
        .orderBy(F.asc_nulls_last("started_at"), "session_id")
    )


def rollup_tools(calls: DataFrame, sessions: DataFrame, session_id: str | None = None) -> DataFrame:
    """Tool calls per tool over a session and its children; without a session, for every root."""
    # Counted per session before the join, so a long session moves as a few rows.
    counts = calls.groupBy("session_id", "tool_name").agg(F.count(F.lit(1)).alias("n"))
    tree = sessions.select("session_id", "parent_session_id")
    if session_id is not None:
        tree = tree.filter((F.col("session_id") == session_id) | (F.col("parent_session_id") == session_id))
        root = F.lit(session_id)
    else:
        root = F.coalesce("parent_session_id", "session_id")
    return (
        counts.join(tree, "session_id")
        .groupBy(root.alias("root_session_id"), "tool_name")
        .agg(F.sum("n").alias("calls"))
    )


def sessions_by_project(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("project").agg(F.count(F.lit(1)).alias("sessions"))


def register_views(tables: dict[str, DataFrame]) -> None:
    """Make tables known to ``spark.sql`` under their names (arrays as JSON text)."""
    for name, df in tables.items():
        json_text(df).createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """Run a SQL query over the registered views; all rows, or the first ``limit``."""
    df = spark.sql(sql.strip().rstrip(";"))
    return df if limit is None else df.limit(limit)
