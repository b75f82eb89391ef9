"""Which sessions to load, and replacing the rows of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import HeavyKeys, ordered, running_max


def _last_ts(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("file_ts", F.coalesce("ended_at", F.lit("")))


def select_new(sessions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sessions to load: the manifest knows nothing of them, or an earlier last time.

    Of several files of one session that with the latest end counts, the first
    path among equals.
    """
    first = Window.partitionBy("session_id").orderBy(F.desc("file_ts"), F.asc("path"))
    best = (
        _last_ts(sessions)
        .withColumn("rn", F.row_number().over(first))
        .filter(F.col("rn") == 1)  # cut before the shuffle, too
        .drop("rn")
    )
    return (
        best.join(manifest, "session_id", "left")
        .filter(F.col("last_ts").isNull() | (F.col("last_ts") < F.col("file_ts")))
        .drop("last_ts", "file_ts")
    )


def new_manifest(manifest: DataFrame, loaded: DataFrame) -> DataFrame:
    """The manifest after a load; a session keeps its latest time."""
    marks = _last_ts(loaded).select("session_id", F.col("file_ts").alias("last_ts"))
    return manifest.unionByName(marks).groupBy("session_id").agg(F.max("last_ts").alias("last_ts"))


def ingest_stats(sessions: DataFrame, manifest: DataFrame, heavy: HeavyKeys | None = None) -> DataFrame:
    """Files loaded, skipped and seen.

    Files of one session are taken in path order; one that ends later than all
    before it counts as loaded, although only the last of them stays.
    """
    seen = (
        ordered(_last_ts(sessions).select("session_id", "path", "file_ts"),
                ["session_id"], ["path"], heavy)
        .running({"before": running_max(F.col("file_ts"))})
        .result()
        .join(manifest, "session_id", "left")
    )
    mark = F.greatest("before", "last_ts")
    loaded = mark.isNull() | (mark < F.col("file_ts"))
    return seen.agg(
        F.count_if(loaded).alias("sessions_ingested"),
        F.count_if(~loaded).alias("skipped"),
        F.count(F.lit(1)).alias("total"),
    )


def replace_sessions(existing: DataFrame, new: DataFrame, replaced: DataFrame) -> DataFrame:
    """``existing`` without the rows of the ``replaced`` sessions, plus ``new``."""
    kept = existing.join(replaced.select("session_id").distinct(), "session_id", "left_anti")
    return kept.select(*new.columns).unionByName(new)
