"""Prefix tree of conversations: a z-fast trie kept as a table of handles.

A prefix of ``d`` turns is known by a 128-bit hash of them, so whether two conversations
share it is one comparison.  The trie keeps compacted nodes only: an edge runs from the
depth ``top`` of its parent to the ``depth`` of its node, and is filed under the prefix
at its handle, the 2-fattest depth in (top, depth].  A conversation finds the deepest
node on its path by fat binary search: each step asks for one handle, so the number of
joins is the logarithm of the length.  Conversations are inserted in batches: all that
wait are located, edges are split where they leave, and of those that want the same new
child one is taken, by hash; the others wait for the next batch, below it.  Batches
grow with the logarithm of the number of conversations.  Totals of subtrees are added up
along the compacted nodes by pointer doubling, and edges are expanded at the end.

No task holds a node's members: hot nodes are sums that are aggregated before they move,
and joins on a hot handle are ordinary joins whose large partitions Spark splits.  A
conversation of over ``PIECE`` turns is cut into pieces, each with a trie of its own
below the node at which the piece starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlog.functions.ordered import HeavyKeys, heavy_keys, ordered, running_sum

from .common import cut_lineage

#: Turns of a conversation that one row holds.
PIECE = 1024
#: One piece in so many is inserted first; the others are searched for in what they make.
BATCHES = 16
#: Characters of joined ids that one row holds.
ID_TEXT = 1 << 20

# Fixed values of the rebuilding rule: conversations share the start of the first of five.
FAMILY = 5
SHARED = 9

_LANE = 0xFFFFFFFF
_EDGE = ["pa", "pb", "top", "a", "b", "depth", "ha", "hb", "ca", "cb", "rc", "rbase", "bytes0", "bytes1"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Turns by place: conv_id, i (from 1), ta, tb (hash of role and text), nbytes (of the text).

    Turns are ordered by turn (null first), then role and text (in UTF-8 order), so repeated rows
    count as turns of their own; a null role or text is empty.  Rows without conv_id belong
    to no conversation and are left out.  Other columns are not looked at.
    """
    t = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        # Signed numbers as text of one length that sorts like them.
        F.coalesce(F.lpad(F.hex(F.col("turn").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"),
                   F.lit("")).alias("nth"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    heavy = heavy_keys(t, "conv_id")
    placed = ordered(t, ["conv_id"], ["nth", "role", "text"], heavy).running(
        {"i": running_sum(F.lit(1).cast("long"), inclusive=True)}).result()
    told = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    half = lambda at: F.conv(F.substring(told, at, 16), 16, -10).cast("long")
    return cut_lineage(placed.select(
        "conv_id", "i", half(1).alias("ta"), half(17).alias("tb"),
        F.octet_length("text").cast("long").alias("nbytes")))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation after the first turns of the first of its family: conv_id, pos, ta, tb, nbytes.

    ``turns`` comes from :func:`numbered_turns`.  Conversation c takes the first h turns of
    c - c % 5 and its own turns after its first h; h is crc32 of the decimal c, modulo 9.
    A conversation left without turns has one row with a null ``pos``.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    sizes = turns.groupBy("conv_id").agg(F.max("i").alias("n"))
    convs = cut_lineage(sizes.select(
        "conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
        .join(sizes.withColumnsRenamed({"conv_id": "base", "n": "bn"}), "base", "left")
        .select("conv_id", "h", "base", F.least("h", F.coalesce("bn", F.lit(0))).alias("taken")))
    own = turns.join(convs, "conv_id").filter("i > h").select(
        "conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("pos"), "ta", "tb", "nbytes")
    heads = turns.filter(F.col("i") < SHARED).withColumnRenamed("conv_id", "base").join(convs, "base").filter("i <= h")
    rows = own.unionByName(heads.select("conv_id", F.col("i").alias("pos"), "ta", "tb", "nbytes"))
    bare = convs.join(sizes, "conv_id").filter("taken = 0 and n <= h").select("conv_id")
    return rows.unionByName(bare, allowMissingColumns=True)


def _prefixes(turns: DataFrame, heavy: HeavyKeys) -> DataFrame:
    """Hash of every prefix: conv_id, pos, a, b, bytes (of the texts so far).

    Each turn gives four 32-bit numbers that depend on its place; their running sums, mixed,
    are the hash.  Sums can be carried over the blocks of a very long conversation.
    """
    lanes = {f"s{j}": running_sum(F.xxhash64("pos", "ta", "tb", F.lit(j)).bitwiseAND(F.lit(_LANE)), inclusive=True)
             for j in range(4)}
    rows = ordered(turns, ["conv_id"], ["pos"], heavy).running(
        {**lanes, "bytes": running_sum(F.col("nbytes"), inclusive=True)}).result()
    return rows.select("conv_id", "pos", F.xxhash64("pos", "s0", "s1").alias("a"),
                       F.xxhash64("s2", "s3", "pos").alias("b"), F.col("bytes").cast("long").alias("bytes"))


def _pieces(prefixes: DataFrame, longest: DataFrame, piece: int) -> DataFrame:
    """Rows of at most ``piece`` turns of the conversations ``longest``: rc, rbase, arr, depths rbase to last."""
    rows = prefixes.join(longest.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi")
    band = F.expr(f"(pos - 1) div {piece}")
    rows = rows.select("*", F.explode(F.when(F.col("pos") % piece == 0, F.array(band, band + 1))
                                      .otherwise(F.array(band))).alias("band"))
    entry = F.struct("pos", "a", "b", "bytes")
    found = rows.groupBy(F.col("conv_id").alias("rc"), (F.col("band") * piece).alias("rbase")).agg(
        F.array_sort(F.collect_list(entry)).alias("arr"))  # at most piece + 1 entries
    root = F.array(F.struct(*[F.lit(0).cast("long").alias(c) for c in ("pos", "a", "b", "bytes")]))
    found = found.withColumn("arr", F.when(F.col("rbase") == 0, F.concat(root, F.col("arr"))).otherwise(F.col("arr")))
    return found.filter(F.size("arr") > 1).withColumn("last", F.col("rbase") + F.size("arr") - 1)


def _at(depth: Column, arr: str = "arr", base: str = "rbase") -> Column:
    """Entry of a piece at a depth, null outside it."""
    return F.get(F.col(arr), (depth - F.col(base)).cast("int"))


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that most twos divide."""
    shift = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, shift), shift)


def _edge(top: Column, depth: Column) -> list[Column]:
    """Columns ``_EDGE`` of the edge (top, depth] on the path of a row's piece."""
    up, end, handle, child = _at(top), _at(depth), _at(two_fattest(top, depth)), _at(top + 1)
    return [up.a.alias("pa"), up.b.alias("pb"), top.alias("top"), end.a.alias("a"), end.b.alias("b"),
            depth.alias("depth"), handle.a.alias("ha"), handle.b.alias("hb"), child.a.alias("ca"),
            child.b.alias("cb"), F.col("rc"), F.col("rbase"), up.bytes.alias("bytes0"), end.bytes.alias("bytes1")]


def _key(entry: Column, wanted: Column) -> tuple[Column, Column]:
    """Key to ask for; rows that ask for nothing get keys of their own, so that they stay spread."""
    return (F.when(wanted, entry.a).otherwise(F.xxhash64("rc", "rbase", F.lit("none"))),
            F.when(wanted, entry.b).otherwise(F.col("rc")))


def _located(waiting: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """``lo`` becomes the depth of the deepest node on the path (fat binary search over handles)."""
    handles = edges.select(F.col("ha").alias("ka"), F.col("hb").alias("kb"), F.col("depth").alias("e"),
                           F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("top").alias("et"))
    for _ in range(steps):
        going = F.col("lo") < F.col("hi")
        rows = waiting.withColumn("f", F.when(going, two_fattest(F.col("lo"), F.col("hi"))))
        ka, kb = _key(_at(F.col("f")), F.col("f").isNotNull())
        rows = rows.withColumns({"ka": ka, "kb": kb}).join(handles, ["ka", "kb"], "left")
        end, seen = _at(F.col("e")), F.col("e").isNotNull() & F.col("f").isNotNull()
        on_path = seen & (F.col("e") <= F.col("last")) & F.coalesce(
            (end.a == F.col("ea")) & (end.b == F.col("eb")), F.lit(False))
        lo = F.when(on_path, F.col("e")).when(seen, F.col("et")).otherwise(F.col("lo"))
        hi = F.when(on_path, F.col("hi")).when(seen, F.col("et")).when(going, F.col("f") - 1).otherwise(F.col("hi"))
        waiting = rows.select("rc", "rbase", "arr", "last", lo.alias("lo"), F.greatest(hi, lo).alias("hi"))
    return waiting


def _agreement(rows: DataFrame) -> DataFrame:
    """``m``: the depth to which a piece agrees with the one (other, obase) whose edge down to ``xd`` it is on."""
    def agree(d):
        mine, its = _at(d), _at(d, "other", "obase")
        return (mine.a == its.a) & (mine.b == its.b)

    shared = F.size(F.filter(F.sequence(F.col("lo") + 1, F.least("last", "xd")), agree))
    return rows.withColumn("m", F.col("lo") + shared)


_EXIT = ["rc", "rbase", "arr", "last", "m", "xa", "xb", "xd"]


def _exits(waiting: DataFrame, edges: DataFrame, pieces: DataFrame) -> DataFrame:
    """Where each located piece leaves the trie: depth ``m`` on the edge to (xa, xb), null if at a node."""
    child = _at(F.col("lo") + 1)
    ka, kb = _key(child, child.isNotNull())
    below = edges.select(F.col("ca").alias("ka"), F.col("cb").alias("kb"), F.col("a").alias("xa"),
                         F.col("b").alias("xb"), F.col("depth").alias("xd"),
                         F.col("rc").alias("oc"), F.col("rbase").alias("obase"))
    rows = waiting.withColumns({"ka": ka, "kb": kb}).join(below, ["ka", "kb"], "left").drop("ka", "kb")
    off, on = rows.filter("xd is null"), rows.filter("xd is not null")
    others = pieces.select(F.col("rc").alias("oc"), F.col("rbase").alias("obase"), F.col("arr").alias("other"))
    on = _agreement(on.join(others, ["oc", "obase"]))
    return on.select(*_EXIT).unionByName(off.withColumn("m", F.col("lo")).select(*_EXIT))


def _insert(exits: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """New edges and cuts (a, b, m) of old and new ones, for a batch that leaves the trie at ``exits``.

    Of the pieces that leave at one place for one child, one becomes that child's edge.  The others are on its path, so
    they leave its edge next.  Which one it is goes by hash, so a group falls apart in a
    logarithmic number of rounds.
    """
    new, cuts = [], []
    while True:
        exits = cut_lineage(exits)
        cuts.append(exits.filter("xd is not null and m < xd").select(F.col("xa").alias("a"), F.col("xb").alias("b"), "m"))
        first = _at(F.col("m") + 1)
        rest = exits.filter("m < last").select(
            "rc", "rbase", "arr", "last", F.col("m").alias("lo"), first.a.alias("ca"), first.b.alias("cb"))
        edge = F.struct(*_edge(F.col("lo"), F.col("last")), F.col("arr").alias("other"))
        taken = cut_lineage(rest.groupBy("ca", "cb").agg(
            F.max_by(edge, F.xxhash64("rc", "rbase")).alias("edge")).select("edge.*"))
        if taken.isEmpty():
            return new, cuts
        new.append(taken.select(*_EDGE))
        leader = taken.select("ca", "cb", F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("depth").alias("xd"),
                              F.col("rc").alias("oc"), F.col("rbase").alias("obase"), "other")
        others = rest.join(leader, ["ca", "cb"]).filter("rc <> oc or rbase <> obase")
        exits = _agreement(others).select(*_EXIT)


def _cut(edges: DataFrame, cuts: DataFrame, pieces: DataFrame) -> DataFrame:
    """Edges split at the depths ``m`` of ``cuts``."""
    places = cuts.groupBy("a", "b").agg(F.sort_array(F.collect_set("m")).alias("cuts"))  # at most a piece's length
    marked = edges.join(places, ["a", "b"], "left")
    parts = (
        marked.filter("cuts is not null").select("rc", "rbase", "top", "depth", "cuts")
        .join(pieces.select("rc", "rbase", "arr"), ["rc", "rbase"])
        .withColumn("ends", F.concat(F.array("top"), "cuts", F.array("depth")))
        .select("rc", "rbase", "arr", F.explode(F.arrays_zip(
            F.expr("slice(ends, 1, size(ends) - 1)").alias("s"),
            F.expr("slice(ends, 2, size(ends) - 1)").alias("e"))).alias("p"))
    )
    whole = marked.filter("cuts is null").select(*_EDGE)
    return whole.unionByName(parts.select(*_edge(F.col("p.s"), F.col("p.e"))))


def compacted_trie(pieces: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Edges of the compacted trie over all pieces, columns ``_EDGE``.

    The first batch has one piece in ``batches``, by hash, the second the others.
    """
    rows = pieces.withColumns({"lo": F.col("rbase"), "hi": F.col("last")})
    first = F.pmod(F.xxhash64("rc", "rbase", F.lit("batch")), F.lit(batches)) == 0
    none = F.lit(None).cast("long")
    steps = int(pieces.agg(F.max(F.col("last") - F.col("rbase"))).first()[0] or 0).bit_length()
    edges = None
    for batch in (rows.filter(first), rows.filter(~first)):
        if edges is None:
            exits = batch.select("rc", "rbase", "arr", "last", F.col("lo").alias("m"),
                                 none.alias("xa"), none.alias("xb"), none.alias("xd"))
        else:
            exits = _exits(_located(batch, edges, steps), edges, pieces)
        new, cuts = _insert(exits)
        for df in new:
            edges = df if edges is None else edges.unionByName(df)
        if edges is None:
            edges = pieces.limit(0).select(*_edge(F.col("rbase"), F.col("last")))
        edges = cut_lineage(_cut(edges, reduce(DataFrame.unionByName, cuts), pieces))
    return edges


def _subtree_totals(nodes: DataFrame) -> DataFrame:
    """``nodes`` (a, b, up, w, wb, e, leaves, low) with totals over their subtrees, by pointer doubling.

    After k rounds a node has the totals of its descendants less than 2^k edges away, and
    ``up`` is its 2^k-th ancestor.
    """
    sums = ["w", "wb", "e", "leaves"]
    cur = cut_lineage(nodes)
    while not cur.filter("up is not null").isEmpty():
        going = cur.filter("up is not null")
        below = going.groupBy("up").agg(*[F.sum(c).alias(f"{c}2") for c in sums], F.min("low").alias("low2"))
        add = below.select(F.col("up.a").alias("a"), F.col("up.b").alias("b"), *[f"{c}2" for c in sums], "low2")
        told = cur.join(add, ["a", "b"], "left").select(
            "a", "b", "up", *[(F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c) for c in sums],
            F.least("low", "low2").alias("low"))
        higher = cur.filter("up is not null").select(F.struct("a", "b").alias("up"), F.col("up").alias("up2"))
        jumped = told.filter("up is not null").join(higher, "up", "left").withColumn("up", F.col("up2")).drop("up2")
        cur = cut_lineage(jumped.unionByName(told.filter("up is null")))
    return cur.drop("up")


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids that end at a node, ascending: a, b, sha.

    Ids are dealt by range of (node, id), so a hot node is spread; each task joins its run of
    ids to texts, and a node's texts are hashed one after the other, not held together.
    """
    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size = None, [], 0

        def row():
            return pa.RecordBatch.from_pydict({
                "a": [key[0]], "b": [key[1]], "first": [int(ids[0])], "part": [",".join(ids)]})

        for batch in batches:
            for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key is not None and ((a, b) != key or size > ID_TEXT):
                    yield row()
                    ids, size = [], 0
                key = (a, b)
                ids.append(str(c))
                size += len(ids[-1])
        if ids:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for a, b, part in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (a, b) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(part.encode())
            yield pa.RecordBatch.from_pylist([dict(zip("abs", r)) for r in out], schema=shape)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip("abs", (*key, state.hexdigest())))], schema=shape)

    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("s", pa.string())])
    runs = ends.select("a", "b", "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions(
        "a", "b", "conv_id").mapInArrow(join_ids, "a long, b long, first long, part string")
    return runs.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(
        digest, "a long, b long, s string").withColumnRenamed("s", "sha")


def prefix_tree(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per node of the prefix tree of ``turns`` (conv_id, pos from 1, ta, tb, nbytes).

    A row with a null ``pos`` stands for a conversation without turns.  Result, all long but
    the last: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs
    (members), n_children, n_leaves (childless nodes of its subtree), saved_tokens (over the
    subtree, members less one times the bytes of the node's text), ends_sha256 (of the
    comma-joined ids of members that end there; that of nothing if none).  Without
    conversations there is no node.  Prefixes are compared by 128-bit hashes.
    """
    turns = cut_lineage(turns)
    heavy = heavy_keys(turns, "conv_id")
    prefixes = cut_lineage(_prefixes(turns.filter("pos is not null"), heavy))
    zero = F.lit(0).cast("long")
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "a", "b", "bytes")).alias("p")).select("conv_id", "p.*")
    ends = cut_lineage(ends.unionByName(turns.filter("pos is null").select(
        "conv_id", zero.alias("pos"), zero.alias("a"), zero.alias("b"), zero.alias("bytes"))))
    whole = cut_lineage(ends.groupBy("a", "b").agg(
        F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")))
    pieces = cut_lineage(_pieces(prefixes, whole, piece))
    edges = cut_lineage(compacted_trie(pieces))

    children = edges.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("children"))
    some = F.lit(not ends.isEmpty())
    root = turns.sparkSession.range(1).filter(some).select(
        zero.alias("a"), zero.alias("b"), zero.alias("bytes0"), zero.alias("bytes1"),
        F.lit(None).cast("struct<a:bigint,b:bigint>").alias("up"))
    points = edges.select("a", "b", "bytes0", "bytes1", F.struct(F.col("pa").alias("a"), F.col("pb").alias("b")).alias("up"))
    points = points.unionByName(root).join(children, ["a", "b"], "left").join(whole, ["a", "b"], "left")
    n = F.coalesce("n", zero)
    totals = _subtree_totals(points.select(
        "a", "b", "up", n.alias("w"), (n * F.coalesce("bytes", zero)).alias("wb"),
        (F.col("bytes1") - F.col("bytes0")).alias("e"),
        F.col("children").isNull().cast("long").alias("leaves"), F.col("rep").alias("low")))
    empty = F.lit(hashlib.sha256().hexdigest())
    nodes = cut_lineage(
        totals.join(children, ["a", "b"], "left").join(_end_digests(ends), ["a", "b"], "left")
        .withColumns({"children": F.coalesce("children", zero), "sha": F.coalesce("sha", empty)}))

    # Along an edge only the bytes above differ.
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("low").alias("up_low"))
    spread = (
        edges.join(nodes, ["a", "b"]).join(above, ["pa", "pb"]).join(pieces.select("rc", "rbase", "arr"), ["rc", "rbase"])
        .withColumn("d", F.explode(F.sequence(F.col("top") + 1, F.col("depth"))))
        .withColumn("before", _at(F.col("d") - 1).bytes)
    )
    last, first = F.col("d") == F.col("depth"), F.col("d") == F.col("top") + 1
    saved = F.col("wb") - F.col("w") * F.col("before") - (F.col("e") - F.col("before") + F.col("bytes0"))
    inner = spread.select(
        F.col("low").alias("conv_id"), F.col("d").alias("depth"),
        F.when(first, F.col("up_low")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.when(last, F.col("sha")).otherwise(empty).alias("ends_sha256"))
    top = nodes.filter("a = 0 and b = 0").select(
        F.col("low").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.col("w").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("wb") - F.col("e")).alias("saved_tokens"), F.col("sha").alias("ends_sha256"))
    return inner.unionByName(top)
