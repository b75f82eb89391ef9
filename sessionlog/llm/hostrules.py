"""Quality rules of documents, judged for their host as well."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlog.functions.joins import BROADCAST_ROWS

from .common import cut_lineage, map_chunks

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SPACES = " \t\n\x0b\x0c\r"


def repeated_words(words: list[list], width: int = 5) -> np.ndarray:
    """For each list: how many of its words lie in a window of ``width`` words found twice or more in it.

    Windows are ranked step by step (a window of k words is a window of k - 1 and a word), so
    equal ranks are equal words; nothing is compared by hash alone.
    """
    sizes = np.array([len(w) for w in words])
    total = int(sizes.sum())
    covered = np.zeros(total + 1, np.int64)
    doc = np.repeat(np.arange(len(words)), sizes)
    inner = np.flatnonzero(np.arange(total) + width <= np.repeat(np.cumsum(sizes), sizes))
    if len(inner):
        code = pd.factorize(np.array([w for ws in words for w in ws], object))[0].astype(np.int64)
        rank = doc[inner]
        for k in range(width):
            rank = pd.factorize(rank * (total + 1) + code[inner + k])[0].astype(np.int64)
        again = inner[np.bincount(rank)[rank] > 1]
        np.add.at(covered, again, 1)
        np.subtract.at(covered, again + width, 1)
    return np.bincount(doc[np.cumsum(covered)[:total] > 0], minlength=len(words))


def rule_facts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts.

    Null and empty texts count 0 everywhere; null ids and hosts stay null.
    """
    def make():
        def run(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            words = [t.encode().split() for t in texts]
            dup = []
            for t in texts:
                lines = [x for x in t.split("\n") if x.strip(_SPACES)]
                dup.append(len(lines) - len(set(lines)))
            whole = lambda x: pa.array(x, pa.int64())
            return {
                "doc_id": batch.column("doc_id"), "host": batch.column(host),
                "n_words": whole([len(w) for w in words]),
                "word_chars": whole([len(t) - sum(map(t.count, _SPACES)) for t in texts]),
                "n_symbols": whole([sum(map(t.count, SYMBOLS)) for t in texts]),
                "n_dup_lines": whole(dup), "n_repeat_words": whole(repeated_words(words)),
            }

        return run

    return map_chunks(docs, ["doc_id", "text", host], "doc_id long, host string, n_words long, word_chars long, "
                      "n_symbols long, n_dup_lines long, n_repeat_words long", make)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def host_rates(facts: DataFrame, failed: Column) -> DataFrame:
    """One row per host: n_docs, n_failed, host_rate (shrunk by an empirical beta prior).

    The prior's mean is the share of failures of all documents; its strength comes from how
    far the hosts' rates spread beyond what chance alone would give (method of moments,
    hosts weighted by documents), between 1 and a million documents.  Counts are aggregated
    before the shuffle, so a host with most of the rows is one row per task.
    """
    hosts = facts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"),
                                      F.sum(failed.cast("long")).alias("n_failed"))
    hosts = cut_lineage(hosts)
    p = F.col("failed") / F.col("docs")
    chance = p * (1 - p)
    spread = F.col("squares") / F.col("docs") - p * p - chance * F.col("hosts") / F.col("docs")
    strength = F.when(spread > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), chance / spread - 1))).otherwise(1e6)
    prior = hosts.agg(
        F.sum("n_docs").alias("docs"), F.sum("n_failed").alias("failed"), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("squares"),
    ).select(p.alias("mean"), strength.alias("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select(  # the prior is one row
        "host", "n_docs", "n_failed",
        ((F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength")))
        .alias("host_rate"))


def host_verdicts(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Rule facts of every document, the base rules' verdict and that of its host.

    A document is kept if it passes the base rules and its host's shrunk failure rate is not
    above ``max_rate``.  Null hosts are one host.  Host rates are broadcast if there are few
    (counted first); otherwise the join shuffles rows without texts, and Spark splits the
    part of a host with very many rows.  Repeated rows stay and count each; an empty table
    gives an empty result.
    """
    facts = cut_lineage(rule_facts(docs, host).withColumn("base_failed", base_failed()))
    rates = cut_lineage(host_rates(facts, F.col("base_failed")))
    few = rates.count() <= BROADCAST_ROWS
    rates = rates.select(F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")).alias("k"), "host_rate")
    keyed = facts.withColumn("k", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")))
    return keyed.join(F.broadcast(rates) if few else rates, "k").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("host_rate") <= max_rate)).alias("kept"),
        F.round("host_rate", 6).alias("host_rate"))
