"""Tool n-grams of a session and their recurrence over sessions and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import HeavyKeys, ordered, running_tail

CALL_ORDER = ["position_in_session", "block_idx"]


def tool_sequences(calls: DataFrame, ns: tuple[int, ...] = (2, 3, 4, 5),
                   heavy: HeavyKeys | None = None) -> DataFrame:
    """Overlapping n-grams of tool names per session, with count, first_ts and last_ts.

    ``first_ts`` is the time of the first tool of the first occurrence, ``last_ts``
    that of the last tool of the last occurrence.
    """
    rows = calls.select(
        "session_id", *CALL_ORDER,
        F.struct(F.col("tool_name").alias("name"), F.col("ts").alias("ts")).alias("t"),
    )
    ahead = (
        ordered(rows, ["session_id"], CALL_ORDER, heavy, reverse=True)
        .running({"window": running_tail(F.col("t"), max(ns))})
        .result()
        .withColumn("window", F.reverse("window"))
    )
    grams = ahead.select(
        "session_id",
        F.struct(*CALL_ORDER).alias("at"),
        F.inline(
            F.transform(
                F.filter(F.array(*[F.lit(n) for n in ns]), lambda n: n <= F.size("window")),
                lambda n: F.struct(
                    n.alias("n"),
                    F.slice("window.name", 1, n).alias("sequence"),
                    F.col("window")[0].ts.alias("start_ts"),
                    F.element_at("window", n).ts.alias("end_ts"),
                ),
            )
        ),
    )
    return grams.groupBy("session_id", "n", "sequence").agg(
        F.count(F.lit(1)).cast("int").alias("count"),
        F.min_by("start_ts", "at").alias("first_ts"),
        F.max_by("end_ts", "at").alias("last_ts"),
    )


def sequences_by_project(sequences: DataFrame, sessions: DataFrame, *keys: str) -> DataFrame:
    """Sessions with an n-gram, by project: sequence, n, project (and ``keys`` of the sessions), sessions."""
    return (
        sequences.select("session_id", "n", "sequence")
        .join(sessions.select("session_id", "project", *keys), "session_id")
        .groupBy(*keys, "sequence", "n", "project")
        .agg(F.count(F.lit(1)).alias("sessions"))
    )


def recurring_of(per_project: DataFrame, min_sessions: int = 5, min_projects: int = 3) -> DataFrame:
    """n-grams found in enough sessions and enough projects, from their counts by project."""
    return (
        per_project.groupBy("sequence", "n")
        .agg(
            F.sum("sessions").cast("int").alias("sessions"),
            F.count("project").cast("int").alias("projects"),
        )
        .filter((F.col("sessions") >= min_sessions) & (F.col("projects") >= min_projects))
    )


def signal_recurring_sequences(sequences: DataFrame, sessions: DataFrame,
                               min_sessions: int = 5, min_projects: int = 3) -> DataFrame:
    """n-grams found in enough sessions and enough projects."""
    # Each n-gram occurs once per session, so only projects need a distinct: counting
    # per (n-gram, project) first keeps a frequent n-gram from filling one task.
    return recurring_of(sequences_by_project(sequences, sessions), min_sessions, min_projects)
