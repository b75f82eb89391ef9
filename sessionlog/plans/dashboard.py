"""The first look at all signals, and JSON output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import json_text

DASHBOARD_ROWS = 20

# Panel: (signal table, order).  The order is total, so the rows shown are fixed.
PANELS = {
    "top_bloat": ("signal_bloat", ["-ratio", "session_id", "event_id"]),
    "top_recurring": ("signal_recurring_sequences", ["-sessions", "sequence", "n"]),
    "skill_eligible_missed": ("signal_skill_eligible_missed", ["session_id", "skill_name", "position"]),
    "skill_abandoned": ("signal_skill_abandoned", ["session_id", "skill_name", "ts", "correction"]),
    "redundant_reads": ("signal_redundant_reads", ["-count", "session_id", "file_path"]),
}


def dashboard(signals: dict[str, DataFrame], rows: int = DASHBOARD_ROWS) -> DataFrame:
    """(panel, rank, row as JSON text); a panel whose signal is missing has no rows."""
    parts = []
    for panel, (name, order) in PANELS.items():
        if name not in signals:
            continue
        df = json_text(signals[name])
        by = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
        top = df.orderBy(*by).limit(rows)  # a top-k: each task keeps `rows` rows
        rank = F.row_number().over(Window.partitionBy(F.lit(panel)).orderBy(*by))
        parts.append(
            top.select(F.lit(panel).alias("panel"), rank.alias("rank"),
                       F.to_json(F.struct(*df.columns)).alias("row"))
        )
    if not parts:
        return SparkSession.active().createDataFrame([], "panel string, rank int, row string")
    return reduce(DataFrame.unionByName, parts)


def write_json(df: DataFrame, path: str) -> None:
    """Write a result as JSON lines."""
    df.write.mode("overwrite").json(path)
