"""Signals on corrections: the tools before them, and edits made again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import keep_matching
from ..functions.jsontext import given
from ..functions.ordered import HeavyKeys, ordered, running_last
from ..functions.text import CORRECTION_PATTERN, is_correction
from .sequences import CALL_ORDER

# Fixed value: tool calls looked at before a correction.
PRECEDING_TOOLS = 3


def tools_before_corrections(events: DataFrame, calls: DataFrame, heavy: HeavyKeys | None = None,
                             pattern: str = CORRECTION_PATTERN) -> DataFrame:
    """(session_id, preceding_tools) of each correction: the names of up to three tool calls before it.

    Taken are the calls with the highest positions among those strictly earlier.
    """
    marked = events.filter(
        (F.col("role") == "user") & ~F.col("is_meta") & F.col("text_head").isNotNull()
        & is_correction(F.col("text_head"), pattern)
    )
    # Only calls of sessions with a correction are sorted.
    tool = keep_matching(calls, marked, ["session_id"]).select(
        "session_id", "ts", F.lit(1).alias("rank"), "event_id",
        F.struct(
            F.col("position_in_session").alias("p"), F.col("event_id").alias("e"),
            F.col("block_idx").alias("b"), F.col("tool_name").alias("name"),
        ).alias("t"),
    )
    corrections = marked.select(
        "session_id", "ts", F.lit(0).alias("rank"), "event_id",
        F.lit(None).cast(tool.schema["t"].dataType).alias("t"),
    )
    seen = (
        ordered(tool.unionByName(corrections), ["session_id"], ["ts", "rank", "event_id"], heavy)
        .top_k("top", F.col("t"), PRECEDING_TOOLS)
        .result()
        .filter(F.col("rank") == 0)
    )
    return seen.select("session_id", F.reverse(F.col("top.name")).alias("preceding_tools"))


def signal_correction_clusters(events: DataFrame, calls: DataFrame, heavy: HeavyKeys | None = None,
                               pattern: str = CORRECTION_PATTERN) -> DataFrame:
    """How often each list of the (up to three) tool calls before a correction occurs."""
    return tools_before_corrections(events, calls, heavy, pattern).groupBy("preceding_tools").agg(
        F.count(F.lit(1)).cast("int").alias("occurrences")
    )


def signal_repeated_path_fixes(calls: DataFrame, max_distance: int | None = None,
                               heavy: HeavyKeys | None = None) -> DataFrame:
    """Consecutive Edits of a session that replace nearly the same text.

    Without ``max_distance`` the table is empty: the signal is declared, and off.
    """
    if max_distance is None:
        return calls.select(
            "session_id", F.lit("").alias("before"), F.lit("").alias("after")
        ).filter(F.lit(False))
    edits = (
        calls.filter(F.col("tool_name") == "Edit")
        .withColumn("old", given(calls, "old_string"))
        .select("session_id", "old", *CALL_ORDER)
    )
    pairs = (
        ordered(edits, ["session_id"], CALL_ORDER, heavy)
        .running({"prev": running_last(F.struct("old"))})
        .result()
    )
    near = F.levenshtein("prev.old", "old", max_distance)
    return pairs.filter(near >= 0).select(
        "session_id", F.col("prev.old").alias("before"), F.col("old").alias("after")
    )
