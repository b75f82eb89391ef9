"""Signals on result sizes and token use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import keep_matching
from ..functions.jsontext import given
from ..functions.once import computed_once
from ..functions.ordered import HeavyKeys, ordered, running_last, running_max
from .sequences import CALL_ORDER

# Fixed values of the signals.
COMPACTION_SUBTYPES = ("compact_boundary", "compaction")
COMPACTION_WINDOW = 5
AGENT_ARGS_FACTOR = 5
AGENT_MIN_RESULT = 5000


def signal_bloat(calls: DataFrame, events: DataFrame, heavy: HeavyKeys | None = None) -> DataFrame:
    """Result size of a call against the tokens of the next assistant event.

    "Next" is the earliest assistant event with a strictly later time.  One row
    per ``event_id``: the one whose next event comes first.
    """
    asks = calls.select(
        "session_id", "ts", F.lit(1).alias("rank"), "event_id",
        F.struct("tool_name", "result_size", *CALL_ORDER).alias("call"),
        F.lit(None).cast("struct<ts:string,event_id:string,tokens:bigint>").alias("reply"),
    )
    replies = events.filter(F.col("type") == "assistant").select(
        "session_id", "ts", F.lit(0).alias("rank"), "event_id",
        F.lit(None).cast(asks.schema["call"].dataType).alias("call"),
        F.struct("ts", "event_id", F.col("output_tokens").alias("tokens")).alias("reply"),
    )
    # Read backwards in time, the last reply seen is the next one.  Calls come
    # first among equal times, so they see later replies only.
    seen = (
        ordered(asks.unionByName(replies), ["session_id"], ["ts", "rank", "event_id"], heavy, reverse=True)
        .running({"next": running_last(F.col("reply"))})
        .result()
        .filter(F.col("call").isNotNull())
    )
    choice = F.struct(
        F.col("next").isNull().alias("none"), F.col("next.ts").alias("next_ts"),
        "session_id", "call.position_in_session", "call.block_idx",
    )
    best = seen.groupBy("event_id").agg(
        F.min_by(F.struct("session_id", "call", "next"), choice).alias("b")
    )
    tokens = F.col("b.next.tokens")
    size = F.col("b.call.result_size")
    return best.select(
        F.col("b.session_id").alias("session_id"),
        "event_id",
        F.col("b.call.tool_name").alias("tool_name"),
        size.alias("result_size"),
        F.coalesce(tokens, F.lit(0).cast("bigint")).alias("next_output_tokens"),
        (size.cast("double") / F.greatest(F.coalesce(tokens, F.lit(1).cast("bigint")), F.lit(1).cast("bigint")))
        .alias("ratio"),
    )


def signal_compaction_proximity(events: DataFrame, k: int = COMPACTION_WINDOW,
                                heavy: HeavyKeys | None = None) -> DataFrame:
    """Output tokens of the ``k`` latest events before each compaction.

    Compactions of one session at the same time are one group; each earlier event
    then counts once per compaction before the cut to ``k``.
    """
    marks = (
        events.filter(F.col("subtype").isin(*COMPACTION_SUBTYPES))
        .groupBy("session_id", "ts")
        .agg(F.count(F.lit(1)).alias("times"))
        .select(
            "session_id", "ts", F.lit(0).alias("rank"), F.lit("").alias("event_id"), "times",
            F.lit(None).cast("struct<tokens:bigint>").alias("e"),
        )
    )
    # Only sessions that have a mark are sorted.
    rows = keep_matching(events, marks, ["session_id"]).select(
        "session_id", "ts", F.lit(1).alias("rank"), "event_id", F.lit(None).cast("bigint").alias("times"),
        F.struct(F.col("output_tokens").alias("tokens")).alias("e"),
    )
    # A mark comes first among equal times, so it sees strictly earlier events.
    seen = (
        ordered(rows.unionByName(marks), ["session_id"], ["ts", "rank", "event_id"], heavy)
        .last_k("before", F.col("e"), k)
        .result()
        .filter(F.col("times").isNotNull() & (F.size("before") > 0))
    )
    latest_first = F.transform(
        F.reverse("before"),
        lambda e, i: F.coalesce(e.tokens, F.lit(0))
        * F.greatest(F.least(F.col("times"), F.lit(k) - i * F.col("times")), F.lit(0)),
    )
    return seen.select(
        "session_id",
        F.lit(k).alias("window_turns"),
        F.aggregate(latest_first, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("tokens"),
    )


def signal_redundant_reads(calls: DataFrame, heavy: HeavyKeys | None = None) -> DataFrame:
    """Files read again in a session with no edit since the last read.

    The count is that of the redundant reads plus the first one.
    """
    path = given(calls, "file_path")
    rows = (
        computed_once(calls.filter(F.col("tool_name").isin("Read", "Edit")).select(
            "session_id", "tool_name", path.alias("given_path"), *CALL_ORDER), {"file_path": F.col("given_path")})
        .filter(F.col("file_path") != "")
        .select("session_id", "file_path", "tool_name", *CALL_ORDER)
    )
    pos = F.col("position_in_session")
    is_read = F.col("tool_name") == "Read"
    again = (
        ordered(rows, ["session_id", "file_path"], CALL_ORDER, heavy)
        .running(
            {
                "last_read": running_max(F.when(is_read, pos)),
                "last_edit": running_max(F.when(~is_read, pos)),
            }
        )
        .result()
        .filter(is_read & (F.coalesce("last_edit", F.lit(-1)) < F.col("last_read")))
    )
    return again.groupBy("session_id", "file_path").agg(
        (F.count(F.lit(1)) + 1).cast("int").alias("count")
    )


def signal_oversized_agent(calls: DataFrame) -> DataFrame:
    """Agent dispatches whose result is far larger than what was asked."""
    args_len = F.length("args_json")
    return calls.filter(
        (F.col("tool_name") == "Agent")
        & (F.col("result_size") > F.greatest(args_len * AGENT_ARGS_FACTOR, F.lit(AGENT_MIN_RESULT)))
    ).select("session_id", "event_id", args_len.alias("args_len"), "result_size")
