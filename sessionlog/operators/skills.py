"""Signals on skills: missed, abandoned, costly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import BROADCAST_ROWS, keep_matching
from ..functions.ordered import (
    HeavyKeys, ordered, running_last, running_sum, running_tail,
)
from ..functions.text import CORRECTION_PATTERN, is_correction
from .sequences import CALL_ORDER

# Fixed values of the signals.
FOLLOWUP_MESSAGES = 3
CORRECTION_CHARS = 120


def signal_skill_eligible_missed(calls: DataFrame, skills: DataFrame, signatures: DataFrame,
                                 longest: int, heavy: HeavyKeys | None = None) -> DataFrame:
    """First place in a session where the tools of a skill's signature occur in a row,
    for skills the session did not invoke.

    ``signatures`` has (skill_name, signature, reason); ``longest`` is the length
    of its longest signature (see :func:`sessionlog.sources.signatures.longest`).
    """
    rows = calls.select("session_id", "tool_name", *CALL_ORDER)
    forward = ordered(rows, ["session_id"], CALL_ORDER, heavy).running(
        {"position": running_sum(F.lit(1))}
    )
    # Read from the end: the names from this call on.
    ahead = (
        forward.turned()
        .running({"window": running_tail(F.col("tool_name"), longest)})
        .result()
        .withColumn("window", F.reverse("window"))
    )
    # An equi-join on whole signatures: a call asks once for each length that signatures have, however many
    # there are.  Spark knows no size of the signatures, so they are counted; the calls then stay where they are.
    sigs = signatures.filter(F.size("signature") > 0).select("skill_name", "signature")
    few = sigs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    lengths = sorted(r[0] for r in sigs.select(F.size("signature")).distinct().collect())  # at most `longest`
    if not lengths:
        return ahead.select("session_id", F.lit("").alias("skill_name"), F.col("position").cast("int")).limit(0)
    starts = F.array_compact(F.array(*[F.when(F.size("window") >= n, F.slice("window", 1, n)) for n in lengths]))
    hits = (
        ahead.select("session_id", "position", F.explode(starts).alias("signature"))
        .join(F.broadcast(sigs) if few else sigs, "signature")
        .groupBy("session_id", "skill_name")
        .agg(F.min("position").cast("int").alias("position"))
    )
    invoked = skills.select("session_id", "skill_name").distinct()
    return hits.join(invoked, ["session_id", "skill_name"], "left_anti")


def signal_skill_abandoned(skills: DataFrame, events: DataFrame, heavy: HeavyKeys | None = None,
                           pattern: str = CORRECTION_PATTERN) -> DataFrame:
    """Invocations with a correction among the next three user messages."""
    # Only messages of sessions with an invocation are sorted.
    messages = keep_matching(events, skills, ["session_id"]).filter(
        (F.col("role") == "user") & ~F.col("is_meta") & F.col("text_head").isNotNull()
    ).select(
        "session_id", "ts", F.lit(0).alias("rank"), "event_id",
        F.lit(None).cast("string").alias("skill_name"),
        F.struct(
            "ts",
            F.when(is_correction(F.col("text_head"), pattern),
                   F.substring("text_head", 1, CORRECTION_CHARS)).alias("correction"),
        ).alias("m"),
    )
    asks = skills.select(
        "session_id", "ts", F.lit(1).alias("rank"), F.lit("").alias("event_id"), "skill_name",
        F.lit(None).cast(messages.schema["m"].dataType).alias("m"),
    )
    # Backwards in time; an invocation comes first among equal times, so it sees
    # strictly later messages.
    seen = (
        ordered(asks.unionByName(messages), ["session_id"], ["ts", "rank", "event_id"], heavy, reverse=True)
        .last_k("after", F.col("m"), FOLLOWUP_MESSAGES)
        .result()
        .filter(F.col("rank") == 1)
    )
    hit = F.try_element_at(
        F.filter(F.reverse("after"), lambda m: m.correction.isNotNull()), F.lit(1)
    )
    return (
        seen.withColumn("hit", hit)
        .filter(F.col("hit").isNotNull())
        .select("session_id", "skill_name", F.col("hit.ts").alias("ts"),
                F.col("hit.correction").alias("correction"))
    )


def signal_skill_turnaround(skills: DataFrame, events: DataFrame,
                            heavy: HeavyKeys | None = None) -> DataFrame:
    """Output tokens between an invocation and the next event with role user."""
    is_user = F.coalesce(F.col("role") == "user", F.lit(False))
    # Backwards in time, at equal times: invocation, events, then end marks of user events.
    rows = keep_matching(events, skills, ["session_id"]).select(
        "session_id", "ts", "event_id",
        F.lit(None).cast("string").alias("skill_name"),
        F.coalesce("output_tokens", F.lit(0).cast("bigint")).alias("tokens"),
        F.explode(F.when(is_user, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(2)))).alias("rank"),
    ).withColumn("tokens", F.when(F.col("rank") == 2, F.col("tokens")).otherwise(F.lit(0)))
    asks = skills.select(
        "session_id", "ts", F.lit("").alias("event_id"), "skill_name",
        F.lit(0).cast("bigint").alias("tokens"), F.lit(3).alias("rank"),
    )
    o = ordered(asks.unionByName(rows), ["session_id"], ["ts", "rank", "event_id"], heavy, reverse=True)
    o = o.running({"later": running_sum(F.col("tokens"))})
    o = o.running({"after_user": running_last(F.when(F.col("rank") == 1, F.col("later")))})
    return (
        o.result()
        .filter(F.col("rank") == 3)
        .select(
            "session_id", "skill_name", "ts",
            (F.col("later") - F.coalesce("after_user", F.lit(0))).cast("bigint").alias("tokens_to_user"),
        )
    )
