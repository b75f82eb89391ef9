"""Keep an expensive expression from being evaluated again by filters on its value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns that filters cannot be pushed below.

    Spark moves a filter on a column below the projection that computes it, and
    then computes it twice.  It does not move filters below a generator, so the
    columns come out of a one-element ``inline``.
    """
    packed = F.struct(*[c.alias(name) for name, c in cols.items()])
    return df.select("*", F.inline(F.array(packed)))
