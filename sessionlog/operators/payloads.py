"""Long arguments, stored once per content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import ARGS_CHARS
from ..functions.scratch import written


def payload_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def build_payloads(rows: DataFrame, content: str = "args_json", min_chars: int = ARGS_CHARS,
                   existing: DataFrame | None = None) -> DataFrame:
    """(prefix, hash, content) of texts of at least ``min_chars``, one row per distinct text.

    Texts that are in ``existing`` are left out; of it only the prefixes at hand are read.
    """
    found = (
        rows.filter(F.length(content) >= min_chars)
        .select(payload_hash(F.col(content)).alias("hash"), F.col(content).alias("content"))
        # Copies collapse before the shuffle, so a frequent text does not pile up.
        .dropDuplicates(["hash"])
        .select(F.substring("hash", 1, 2).alias("prefix"), "hash", "content")
    )
    return found if existing is None else _not_in(written(found), existing)


def _not_in(found: DataFrame, existing: DataFrame) -> DataFrame:
    prefixes = [r[0] for r in found.select("prefix").distinct().collect()]  # at most 256
    known = existing.filter(F.col("prefix").isin(*prefixes)).select("prefix", "hash")
    return found.join(known, ["prefix", "hash"], "left_anti")


def get_payload(payloads: DataFrame, hash: str) -> DataFrame:
    """Content of one hash; the prefix filter prunes partitions.  No row: unknown hash."""
    return payloads.filter((F.col("prefix") == hash[:2]) & (F.col("hash") == hash)).select("content")
