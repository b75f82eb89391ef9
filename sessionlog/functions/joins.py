"""Joins that broadcast only after a look at the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most key rows that are sent to every executor.
BROADCAST_ROWS = 100_000


def keep_matching(df: DataFrame, wanted: DataFrame, on: list[str],
                  max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose key is in ``wanted`` (left-semi).

    A small key set is broadcast, so ``df`` is filtered where it is read.  A larger
    one is joined by shuffle.
    """
    keys = wanted.select(*on).distinct()
    small = keys.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(keys) if small else keys, on, "left_semi")
