"""Session files: one JSON object per line, one file per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Layout of child session files.
SUBAGENT_DIR = "subagents"
UUID_PATTERN = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_CHILD = rf"/([^/]*)/({UUID_PATTERN})/{SUBAGENT_DIR}/[^/]*$"
_PARENT = r"(?:^|/)([^/]*)/[^/]*$"


def _reader(spark: SparkSession, glob: str, modified_after: str | None):
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.option("modifiedAfter", modified_after) if modified_after else reader


def read_session_lines(spark: SparkSession, root: str, glob: str = "*.jsonl",
                       modified_after: str | None = None) -> DataFrame:
    """Lines of all session files below ``root``: path, block, line, value.

    Files are read in splits, so one very long session does not go through one
    task.  ``line`` grows along a split.  ``block`` is '' for a file that fits
    one split, else the zero-padded start of the split; ``(block, line)`` is the
    line order of a file.  ``modified_after`` (a timestamp) leaves older files unread.
    """
    raw = (
        _reader(spark, glob, modified_after)
        .text(root)
        .select(
            "value",
            F.col("_metadata.file_path").alias("uri"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_block_start").alias("start"),
            F.col("_metadata.file_block_length").alias("length"),
            F.monotonically_increasing_id().alias("line"),
        )
    )
    # File URIs are percent-encoded; '+' is itself in them.
    path = F.url_decode(F.replace(F.col("uri"), F.lit("+"), F.lit("%2B")))
    return raw.select(
        F.regexp_replace(path, r"^[a-z0-9]+:(//[^/]*)?(?=/)", "").alias("path"),
        F.when(F.col("length") < F.col("size"), F.lpad(F.col("start").cast("string"), 20, "0"))
        .otherwise("")
        .alias("block"),
        "line",
        "value",
    )


def has_split_files(spark: SparkSession, root: str, glob: str = "*.jsonl",
                    modified_after: str | None = None) -> bool:
    """Whether any session file may be read in several splits (looks at the listing only)."""
    smallest_split = 1 << 20
    files = (
        _reader(spark, glob, modified_after)
        .format("binaryFile")
        .load(root)
        .filter(F.col("length") > smallest_split)
    )
    return not files.select("path").limit(1).isEmpty()


def path_facts(path: Column, home_prefix: str = "") -> dict[str, Column]:
    """What a session file's path says: session_id, project, cwd, parent_session_id, is_subagent.

    ``home_prefix`` is a home folder that becomes ``~`` at its first occurrence.
    """
    parent = F.nullif(F.regexp_extract(path, _CHILD, 2), F.lit(""))
    folder = F.when(parent.isNotNull(), F.regexp_extract(path, _CHILD, 1)).otherwise(
        F.regexp_extract(path, _PARENT, 1)
    )
    cwd = F.concat(F.lit("/"), F.translate(F.ltrim(folder, F.lit("-")), "-", "/"))
    if home_prefix:
        at = F.locate(home_prefix, cwd)
        cwd = F.when(at > 0, F.overlay(cwd, F.lit("~"), at, F.lit(len(home_prefix)))).otherwise(cwd)
    project = F.element_at(F.split(F.rtrim(cwd, F.lit("/")), "/"), -1)
    return {
        "session_id": F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", ""),
        "project": F.coalesce(F.nullif(project, F.lit("")), F.lit("root")),
        "cwd": cwd,
        "parent_session_id": parent,
        "is_subagent": parent.isNotNull(),
    }
