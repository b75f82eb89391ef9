"""Skill signatures: the tool sequences that should have called for a skill."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# The signatures shipped by default.
DEFAULT_SIGNATURES = {
    "debugging": {
        "signature": ["Bash", "Read", "Edit", "Bash"],
        "reason": "a run, a look, a change and a run again, without the debugging skill",
    },
    "test_driven_development": {
        "signature": ["Edit", "Bash"],
        "reason": "a change followed by a run, with no test written before it",
    },
}


def load_signatures(spark: SparkSession, mapping: Mapping[str, Mapping]) -> DataFrame:
    """Rows (skill_name, signature, reason) of a name -> spec mapping; empty ones are left out."""
    rows = [
        (name, list(spec["signature"]), spec.get("reason"))
        for name, spec in mapping.items()
        if spec and spec.get("signature")
    ]
    return spark.createDataFrame(rows, "skill_name string, signature array<string>, reason string")


def longest(mapping: Mapping[str, Mapping]) -> int:
    return max((len(s.get("signature") or []) for s in mapping.values() if s), default=1) or 1
