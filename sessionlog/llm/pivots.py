"""Near-duplicate embeddings through a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut_lineage

#: Reference points at most, vectors they are chosen from, and how many of the nearest ones describe a vector.
MOST_PIVOTS, CANDIDATES, NEAREST = 256, 4096, 8

#: Vectors of one list that are compared as one block.
BLOCK = 512


def classes_of(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, key) and the classes of equal direction-giving vectors (key, label, v, copies).

    ``key`` stands for a label and exact components; it is null for rows that link with
    nothing: null label, null or zero vector, null or non-finite components.
    """
    v = F.col("embedding").cast("array<double>")
    usable = (F.col("label").isNotNull() & F.col("embedding").isNotNull()
              & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
              & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    # -0.0 and 0.0 are one value.
    plain = F.transform(v, lambda x: x + F.lit(0.0))
    key = F.when(usable, F.unhex(F.md5(F.to_json(F.struct(F.col("label").alias("l"), plain.alias("v"))).cast("binary"))))
    rows = cut_lineage(embeddings.select("vec_id", key.alias("key"), F.col("label").cast("string").alias("label"),
                                         plain.alias("v")))
    known = rows.filter("key is not null").groupBy("key", "label").agg(
        F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"))
    return rows.select("vec_id", "key"), cut_lineage(known)


def choose_pivots(classes: DataFrame, cosine: float, pivots: int | None) -> np.ndarray:
    """Reference points: of ``CANDIDATES`` vectors (smallest hashes of their keys) each time the one farthest from
    those chosen.

    No two are nearer than two links in a row can bridge, so a group of near copies has one at most, whatever its
    share of the rows, and its members agree on the others.  The number doesn't follow that of the rows.
    """
    place = F.xxhash64("key")
    rows = classes.select("v", place.alias("place"), F.size("v").alias("d")).orderBy("place").limit(CANDIDATES).collect()
    widths = [r["d"] for r in rows]
    most = max(set(widths), key=widths.count) if widths else 0
    if not most:
        return np.zeros((0, 0))
    given = _unit(np.array([r["v"] for r in rows if r["d"] == most], float).reshape(-1, most))
    near, chosen = given @ given[0], [0]
    while len(chosen) < (pivots or MOST_PIVOTS):
        farthest = int(near.argmin())
        if near[farthest] > 2 * max(cosine, 0) ** 2 - 1:  # the cosine of twice the angle
            break
        chosen.append(farthest)
        near = np.maximum(near, given @ given[farthest])
    return given[chosen]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by their largest component so that squares stay finite."""
    if not x.size:
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_pivots(classes: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """classes with ``near``: places of the nearest reference points, in order of nearness.

    Vectors of another dimension than the reference points get their dimension as the one
    place, negative; they meet only each other.
    """
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # bounded by MOST_PIVOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                v = part.column("v").to_pylist()
                near = [[-len(x)] for x in v]
                fit = [j for j, x in enumerate(v) if len(x) == points.shape[1]]
                if fit:
                    dots = _unit(np.array([v[j] for j in fit], float)) @ points.T
                    k = min(nearest, dots.shape[1])
                    top = np.argpartition(-dots, k - 1, axis=1)[:, :k]
                    order = np.argsort(-np.take_along_axis(dots, top, 1), axis=1, kind="stable")
                    for j, t in zip(fit, np.take_along_axis(top, order, 1).tolist(), strict=True):
                        near[j] = t
                yield pa.RecordBatch.from_pydict({
                    **{c: part.column(c) for c in ("key", "label", "v", "copies")},
                    "near": pa.array(near, pa.list_(pa.int32()))})

    return classes.select("key", "label", "v", "copies").mapInArrow(
        run, "key binary, label string, v array<double>, copies long, near array<int>")


def linked(described: DataFrame, cosine: float, shared: int, block: int = BLOCK) -> DataFrame:
    """Links found through the lists, added up in each task: key, root (another key or null), n.

    ``n`` is the number of vectors that link with ``key`` in the task, copies included; the rows
    with a ``root`` connect what its links connect.  A dense group has far more links than that.

    A list holds the vectors of one label near one reference point.  Long lists are cut into
    pieces of about ``block`` vectors, and each pair of pieces is one small task, so a list
    is compared in parallel.  A pair is verified in the list of its first shared reference
    point only, and only if at least ``shared`` are shared.
    """
    lists = described.withColumn("pivot", F.explode("near"))
    sizes = lists.groupBy("label", "pivot").agg(F.count(F.lit(1)).alias("m"))
    pieces = sizes.select("label", "pivot", F.ceil(F.col("m") / block).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int")
    dealt = lists.join(pieces, ["label", "pivot"]).withColumn("piece", piece)
    # Piece i meets each piece j: tasks (low, high).
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")).select(
        "key", "v", "copies", "near", "pivot", "label", "piece",
        F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"))

    def compare(table: pa.Table) -> pa.Table:
        pivot, low, high = (table.column(c)[0].as_py() for c in ("pivot", "low", "high"))
        keys, pieces_ = np.array(table.column("key").to_pylist(), object), table.column("piece").to_numpy()
        near, copies = table.column("near").to_pylist(), table.column("copies").to_numpy()
        x = _unit(np.array(table.column("v").to_pylist(), float))
        codes, inverse = np.unique(np.concatenate(near), return_inverse=True)
        member = np.zeros((len(x), len(codes)), np.float32)
        member[np.repeat(np.arange(len(x)), [len(t) for t in near]), inverse] = 1
        # The first shared reference point is this one if none with a smaller number is shared.
        below = member[:, codes < pivot]
        sides = [np.flatnonzero(pieces_ == low), np.flatnonzero(pieces_ == high)]
        a, b = [], []
        for i in range(0, len(sides[0]), block):
            left = sides[0][i:i + block]
            for j in range(0, len(sides[1]), block):
                right = sides[1][j:j + block]
                close = x[left] @ x[right].T >= cosine - 1e-9
                p, q = np.nonzero(close)
                if low == high:
                    p, q = p[left[p] < right[q]], q[left[p] < right[q]]
                p, q = left[p], right[q]
                if len(p):
                    # The dot products again, in double precision and one order for every pair.
                    ok = (member[p] * member[q]).sum(1) >= min(shared, member.shape[1])
                    ok &= ~(below[p] * below[q]).any(1) if below.shape[1] else True
                    ok &= np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                    a.append(p[ok])
                    b.append(q[ok])
        a, b = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (a, b))
        n = np.zeros(len(x), np.int64)
        np.add.at(n, a, copies[b])
        np.add.at(n, b, copies[a])
        root, before = np.arange(len(x)), None
        while before is None or (root != before).any():
            before, low_ = root.copy(), np.minimum(root[a], root[b])
            np.minimum.at(root, a, low_)
            np.minimum.at(root, b, low_)
            root = root[root]
        some = np.flatnonzero(n)
        return pa.table({"key": pa.array(keys[some].tolist(), pa.binary()), "n": n[some], "root": pa.array(
            [keys[r] if r != i else None for i, r in zip(some, root[some], strict=True)], pa.binary())}).select(["key", "root", "n"])

    return dealt.groupBy("label", "pivot", "low", "high").applyInArrow(compare, "key binary, root binary, n long")


def near_duplicates(embeddings: DataFrame, cosine: float = 0.93, shared: int = 2, nearest: int = NEAREST,
                    pivots: int | None = None) -> DataFrame:
    """Vectors that nearly point the same way: vec_id, n_links, component_id, kept.

    Vectors of equal labels link when their cosine is at least ``cosine`` (double precision).
    Each vector is described by its ``nearest`` reference points (vectors that lie apart, at most
    ``MOST_PIVOTS`` or ``pivots``) and stands in an inverted list of each; pairs that share ``shared`` of them are
    verified.  Every row is indexed; links that share fewer are missed (recall is tested
    against brute force).  ``n_links`` counts other vectors linked directly, copies included;
    ``component_id`` is the smallest vec_id reachable; a vector with that id is kept.

    Exact copies are one class, so a group of copies costs one vector.  Null labels and null,
    empty or zero vectors, and those with null, NaN or infinite components, link with
    nothing.  A null vec_id takes part and is never the smallest; it is kept only if no row of
    its component has an id.  Equal rows count as links of each other.  An empty table gives
    an empty result.
    """
    rows, known = classes_of(embeddings)
    described = cut_lineage(nearest_pivots(known, choose_pivots(known, cosine, pivots), nearest))
    links = cut_lineage(linked(described, cosine, shared))
    copies = known.select(F.col("key"), "copies")
    degree = links.groupBy("key").agg(F.sum("n").alias("outer"))
    nodes = components(links.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "key")
    facts = copies.join(degree, "key", "left").join(nodes, "key", "left").select(
        "key", (F.col("copies") - 1 + F.coalesce("outer", F.lit(0))).alias("n_links"),
        F.coalesce("component", "key").alias("component"))
    placed = cut_lineage(rows.join(facts, "key", "left"))
    least = placed.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    result = placed.join(least, "component", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
