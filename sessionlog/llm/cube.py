"""Mixing sources to target weights by balanced sampling (cube method)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlog.functions.joins import BROADCAST_ROWS

from .common import WORD, cut_lineage

#: Documents that one flight works on.
BLOCK = 2000

#: Smallest units of a last block that take part on words alone.
HELD = 40

#: Samples of a last block at most, and how near (as a share of its words) is near enough.
DRAWS, NEAR = 64, 0.002

_EPS = 1e-9


def fly(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator, by_count: bool = True) -> np.ndarray:
    """Flight phase: probabilities moved to 0 or 1 while their sums hold.

    Kept are the sum of ``pi`` (unless ``by_count`` is false) and the sum of ``size * pi``.
    Three (two) open units at a time take a step along the one direction that changes
    neither sum, up to the first bound, in one of the two senses at random so that every
    expectation stays.  At most two (one) open units are left.
    """
    pi, size = pi.astype(float).copy(), size.astype(float)
    need = 3 if by_count else 2
    queue = [i for i in range(len(pi)) if _EPS < pi[i] < 1 - _EPS]
    queue.reverse()
    draws = iter(rng.random(len(queue) + 1))
    active: list[int] = []
    p, x = pi.tolist(), size.tolist()
    while True:
        while queue and len(active) < need:
            active.append(queue.pop())
        if len(active) < 2:
            break
        if by_count:
            pair = next(((a, b) for a in range(len(active)) for b in range(a) if x[active[a]] == x[active[b]]), None)
            if pair:
                moves = [(active[pair[0]], 1.0), (active[pair[1]], -1.0)]
            elif len(active) == 3:
                a, b, c = active
                big = max(x[a], x[b], x[c])
                moves = [(a, (x[b] - x[c]) / big), (b, (x[c] - x[a]) / big), (c, (x[a] - x[b]) / big)]
            else:
                break
        else:
            a, b = active
            big = max(x[a], x[b])
            moves = [(a, x[b] / big), (b, -x[a] / big)] if big > 0 else [(a, 1.0), (b, -1.0)]
        up = min(((1 - p[i]) if u > 0 else p[i]) / abs(u) for i, u in moves if u)
        down = min((p[i] if u > 0 else (1 - p[i])) / abs(u) for i, u in moves if u)
        step = up if next(draws) * (up + down) < down else -down
        for i, u in moves:
            p[i] += step * u
            if p[i] < _EPS:
                p[i] = 0.0
            elif p[i] > 1 - _EPS:
                p[i] = 1.0
        active = [i for i in active if 0.0 < p[i] < 1.0]
    return np.array(p)


def land(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight and landing of a last block: all units settle.

    The smallest units are held back from the flight on both sums, then all that are open fly on
    the words alone, the largest first: so the document total is given up before the words,
    and the last unit, drawn by its probability, is a small one.  Units come in falling size.
    Of up to ``DRAWS`` such samples the one nearest to the expected words is taken.
    """
    best, least, aim = None, np.inf, float(size @ pi)
    first = max(0, len(pi) - HELD)
    for _ in range(DRAWS):
        p = fly(size, np.concatenate([fly(size[:first], pi[:first], rng), pi[first:]]), rng, by_count=False)
        open_ = (p > _EPS) & (p < 1 - _EPS)
        p[open_] = rng.random(int(open_.sum())) < p[open_]
        off = abs(float(size @ p) - aim)
        if off < least:
            best, least = np.round(p), off
        if least <= NEAR * aim:
            break
    return best


def targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """``sources`` (key, source, source_size) with a column target.

    Sources in order of code points (null last) take ``weights`` in turn and share the sum of
    all sizes; no target is above ``most`` times its source's size, and the excess goes to the
    others by weight until none is above.  In order of size per weight, a source is free if
    the level reached by all before it at their bound does not lift it over its own; the first
    free source gives the level of all later ones.  The windows run over one row per source.
    """
    n = len(weights)
    rank = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % n
    weighed = sources.withColumns({
        "w": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")),
        "bound": most * F.col("source_size")})
    everything = W.partitionBy(F.lit(0))
    before = everything.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(
        W.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    levels = weighed.withColumn("level", level)
    free = F.when(F.col("level") * F.col("w") <= F.col("bound"), F.struct(F.col("bound") / F.col("w"), "level"))
    reached = F.min(free).over(everything)["level"]
    return levels.withColumn("reached", reached).select(
        "key", "source", "source_size",
        F.coalesce(F.least("bound", F.col("w") * F.col("reached")), F.col("bound")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 17,
        block: int = BLOCK, carry: list[str] = ()) -> DataFrame:
    """Copies of each document such that sources reach their target words.

    Returns doc_id, source, size, source_size, target, copies, taken (size times copies), and the columns ``carry`` of ``docs``.  A
    document is taken ``target / source_size`` times on average: the whole part for certain,
    the fraction by the cube method, balanced on the words and the documents of its source.
    Sources are cut into blocks of about ``block`` documents by a hash of the id; each block
    flies alone and leaves at most two open documents, which meet in new blocks until a source
    has one block left, where they land.  So no task holds more than a block of a source.

    Deterministic for a given seed.  Size is the number of words of the whole text; null and
    empty texts have size 0 and no copies.  A null source is a source of its own, the last.
    Repeated rows are drawn one by one.  An empty table gives an empty result.
    """
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    sized = cut_lineage(docs.select("doc_id", "source", *carry, key.alias("key"),
                                    F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    totals = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"),
                                                F.sum((F.col("size") > 0).cast("long")).alias("n"))
    totals = cut_lineage(totals)
    plan = cut_lineage(targets(totals, weights, most).join(totals.select("key", "n"), "key"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.abs(rate - F.round(rate)) < _EPS
    whole = F.when(near, F.round(rate)).otherwise(F.floor(rate))
    plan = plan.drop("source").withColumns({
        "whole": whole.cast("long"), "pi": F.when(near, 0.0).otherwise(rate - whole)})
    few = plan.count() <= BROADCAST_ROWS
    rows = sized.join(F.broadcast(plan) if few else plan, "key").withColumns({
        "pi": F.when(F.col("size") > 0, F.col("pi")).otherwise(0.0),
        "whole": F.when(F.col("size") > 0, F.col("whole")).otherwise(0),
        "blocks": F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("long")}).drop("n")

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "size"], kind="stable", ignore_index=True)
        first = frame.iloc[0]
        rng = np.random.default_rng([seed, int(first["level"]), int(first["block"]), *first["key"].encode()])
        order = rng.permutation(len(frame))
        order = order[np.argsort(-frame["size"].to_numpy()[order], kind="stable")]
        size, pi = frame["size"].to_numpy()[order], frame["pi"].to_numpy()[order]
        pi = (land if first["blocks"] == 1 else fly)(size, pi, rng)
        frame.loc[order, "pi"] = pi
        return frame

    settled = rows.filter("pi = 0")
    # Ids as text: pandas has no long with nulls.
    open_, level = rows.filter("pi > 0").withColumn("doc_id", F.col("doc_id").cast("string")), 0
    while True:
        placed = open_.withColumns({
            "level": F.lit(level), "block": F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + level)), F.col("blocks"))})
        flown = cut_lineage(placed.groupBy("key", "block").applyInPandas(settle, placed.schema))
        done = flown.filter("pi = 0 or pi = 1").drop("level", "block")
        settled = settled.unionByName(done.withColumn("doc_id", F.col("doc_id").cast("long")))
        rest = flown.filter("pi > 0 and pi < 1").drop("level", "block", "blocks")
        counts = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        if counts.isEmpty():
            break
        counts = counts.select("key", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
        open_ = rest.join(F.broadcast(counts) if few else counts, "key")
        level += 1
    copies = F.col("whole") + F.col("pi").cast("long")
    return settled.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                          (F.col("size") * copies).alias("taken"), *carry)
