"""Documents with nearly the same word shingles: T-occurrence search with DivideSkip."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlog.functions.joins import BROADCAST_ROWS

from .common import chunks, components, cut_lineage, give_back, lower_ascii, map_chunks, mix64, with_row_key

#: One of so many texts is looked at to find frequent shingles and words; how often a shingle must be seen there.
SAMPLE, SEEN = 16, 4

#: Frequent shingles and words kept at most (the most frequent ones).  They only settle an order; results don't depend on it.
FREQUENT = 200_000

#: Parts that the list of a frequent shingle is dealt to.
PARTS = 16

#: Bits of a set's parity signature, at least.
BITS = 1024

#: Components of so many sets have a centre, which is found by the signatures of about ``VOTES`` of them.
LARGE, VOTES = 8, 64

#: Sets of a list that are held to see which of them can meet; longer lists pass as they are.
HELD = 8

#: Candidates of one query that are indexed together.
INDEXED = 512

#: Characters of text whose shingles are hashed together; larger arrays leave a core's cache.
HASHED = 1 << 18

def shingle_sets(texts: list[str | None], width: int, rarity=None) -> tuple[np.ndarray, ...]:
    """Distinct shingle hashes of all texts one after the other, ascending in each, and their numbers.

    With ``rarity`` (word hashes to counts) also the count of each shingle's rarest word.
    """
    words = [lower_ascii(t).split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    if not flat:
        none = np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        return none if rarity is None else (*none, np.zeros(0, np.int64))
    code, unique = pd.factorize(np.array(flat, object))
    del flat
    of_word = np.array([xxhash.xxh64_intdigest(w) for w in unique], np.uint64)
    one = of_word[code]
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start = np.flatnonzero(np.arange(len(one)) + width <= ends[doc])
    h = np.full(len(start), width, np.uint64)
    for k in range(width):
        h = mix64(h, one[start + k])
    of = doc[start]
    rare = None
    if rarity is not None:
        count = rarity(of_word)[code]
        rare = count[start]
        for k in range(1, width):
            rare = np.minimum(rare, count[start + k])
    # Texts of fewer words: the whole sequence is their one shingle.
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        whole = [np.uint64(xxhash.xxh64_intdigest(b" ".join(words[i]), seed=len(words[i]))) for i in short]
        h, of = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([of, short])
        rare = None if rare is None else np.concatenate([rare, np.zeros(len(short), np.int64)])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    sets = h[new], np.bincount(of[new], minlength=len(sizes))
    return sets if rare is None else (*sets, rare[order][new])


def needed(a, b, percent: int):
    """Shared shingles that make 100 * shared >= percent * union, for sets of ``a`` and ``b``."""
    return -(-percent * (a + b) // (100 + percent))


def divide_skip(query: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which ``sets`` reach the overlap with ``query``; all are sorted.

    Every shingle of the query has an inverted list of the sets that hold it.  The T - 1
    longest lists (T: the least overlap that any set needs) are set aside: a set that is
    only there can't reach T.  The short lists are merged with a heap, which counts each
    set; a set that can still reach its own overlap is then looked up in the long lists by
    binary search.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    need = needed(len(query), sizes, percent)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), sizes)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[at] == flat
    at, who = at[hit], who[hit]
    order = np.lexsort((who, at))
    at, who = at[order], who[order]
    lengths = np.bincount(at, minlength=len(query))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    by_length = np.argsort(lengths, kind="stable")
    n_long = min(len(query), max(int(need.min()) - 1, 0))
    short, long = by_length[:len(query) - n_long], by_length[len(query) - n_long:]
    counts = np.zeros(len(sets), np.int64)
    for i in heapq.merge(*(who[bounds[j]:bounds[j + 1]].tolist() for j in short if lengths[j])):
        counts[i] += 1
    alive = np.flatnonzero((counts > 0) & (counts + n_long >= need))
    if len(alive) and n_long:
        keys = at * len(sets) + who
        probe = (long[:, None] * len(sets) + alive).ravel()
        place = np.minimum(np.searchsorted(keys, probe), max(len(keys) - 1, 0))
        counts[alive] += (keys[place] == probe).reshape(len(long), -1).sum(0)
    reached = np.zeros(len(sets), bool)
    reached[alive] = counts[alive] >= need[alive]
    return reached


def _frequent(docs: DataFrame, width: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Frequent shingles and words of a sample of the texts: sorted hashes and counts, ``FREQUENT`` each at most.

    All that are seen at least so often that there are no more.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[np.ndarray]] = {True: [], False: []}

        def rows(word: bool):
            h, n = np.unique(np.concatenate(held[word]), return_counts=True)
            held[word] = []
            return pa.RecordBatch.from_pydict({
                "word": [word] * len(h), "h": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int32())})

        for batch in batches:
            for part in chunks(batch, most=HASHED):
                texts = part.column("text").to_pylist()
                held[False].append(shingle_sets(texts, width)[0])
                held[True].append(shingle_sets(texts, 1)[0])
                for word in held:
                    if sum(map(len, held[word])) > 1_000_000:
                        yield rows(word)
        for word in held:
            if held[word]:
                yield rows(word)
        batch = part = texts = None
        give_back()

    # Equal texts count once: one of each hash, found by ids alone.
    keyed = with_row_key(docs.select("doc_id", "text")).filter(F.pmod("tk", F.lit(SAMPLE)) == 0)
    sample = keyed.dropDuplicates(["tk"]).select("text")
    counts = cut_lineage(sample.mapInArrow(count, "word boolean, h long, n int").groupBy("word", "h").agg(F.sum("n").alias("n")))
    out = []
    for word, least in ((False, SEEN), (True, 1)):
        own = counts.filter((F.col("word") == word) & (F.col("n") >= least))
        # The smallest count that not too many have; so nothing is sorted.
        many = own.groupBy(F.floor(8 * F.log2("n")).alias("b")).agg(F.min("n"), F.count(F.lit(1))).collect()
        total, bar = 0, 1 << 62
        for _, smallest, c in sorted(many, reverse=True):
            total += c
            if total > FREQUENT:
                break
            bar = smallest
        rows = own.filter(F.col("n") >= bar).select("h", "n").toPandas()
        h, n = rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
        order = np.argsort(h)
        out.append((h[order], n[order]))
    return out[0], out[1]


def _look_up(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Counts of hashes, 0 for unknown ones."""
    known, n = table
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, n[at], 0)


def set_rows(docs: DataFrame, width: int, percent: int, carry: list[str]) -> DataFrame:
    """Every row's set, and the first shingles of the sets.

    Rows with null ``h`` are documents: ``carry``, n, sig (see :func:`fitting_signatures`) and key (a 128-bit hash of the set; null for
    the empty set).  The others say that shingle ``h`` is number ``place`` (from 0) of the set ``key``;
    equal sets are told once per task and slice of it.  Linked sets share a shingle among their
    first ``n - least overlap + 1``, in one order of all shingles: those with a rare word first,
    shingles found frequent (``often``) last, so lists rarely hold sets that share a passage or
    common words only.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))  # bounded by FREQUENT
    schema = docs.select(*carry).schema.add("n", T.IntegerType()).add("key", "binary").add("h", "long").add("often", "boolean").add("place", T.IntegerType()).add("sig", T.ArrayType(T.LongType()))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])

    def make():
        shingles, known_words = shared.value
        sent: set[bytes] = set()

        def run(batch: pa.RecordBatch) -> dict:
            h, sizes, place = shingle_sets(batch.column("text").to_pylist(), width, lambda x: _look_up(known_words, x))
            seen = _look_up(shingles, h)
            place = np.where(seen > 0, (1 << 40) + seen, place)
            ends = np.cumsum(sizes)
            keys = [xxhash.xxh128_digest(h[e - n:e].tobytes()) if n else None
                    for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            new = np.zeros(len(sizes), bool)
            for i, k in enumerate(keys):
                if k is not None and k not in sent:
                    new[i] = True
                    sent.add(k)
            if len(sent) > 200_000:
                sent.clear()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            by = np.lexsort((h, place, doc))
            nth = np.arange(len(h)) - np.repeat(ends - sizes, sizes)
            first = (nth < np.repeat(sizes - -(-percent * sizes // 100) + 1, sizes)) & new[doc]
            take = by[first]
            of = doc[take]
            m = len(take)
            both = lambda x, y, kind: pa.concat_arrays([x, y]).cast(kind)
            out = {c: pa.concat_arrays([a, pa.nulls(m, a.type)]) for c, a in ((c, batch.column(c)) for c in carry)}
            key = pa.array(keys, pa.binary())
            sig = fitting_signatures(h, sizes)
            return out | {
                "n": both(pa.array(sizes), pa.array(sizes[of]), pa.int32()),
                "key": pa.concat_arrays([key, key.take(pa.array(of))]),
                "h": pa.concat_arrays([pa.nulls(len(sizes), pa.int64()), pa.array(h[take].view(np.int64))]),
                "often": pa.concat_arrays([pa.nulls(len(sizes), pa.bool_()), pa.array(seen[take] > 0)]),
                "place": pa.concat_arrays([pa.nulls(len(sizes), pa.int32()), pa.array(nth[first], pa.int32())]),
                "sig": pa.concat_arrays([sig, pa.nulls(m, pa.list_(pa.int64()))])}

        return run

    return map_chunks(docs, [*dict.fromkeys([*carry, "text"])], schema, make, HASHED)


def signatures(h: np.ndarray, doc: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    """For each of ``n`` sets ``bits`` bits: the parity of its shingles per hash bucket, as 64-bit integers.

    Two signatures differ in no more bits than the two sets differ in shingles.
    """
    odd = np.bincount(doc * bits + (h % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.reshape(n, bits).astype(np.uint8), axis=1).view(np.int64)


def fitting_signatures(h: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Signatures with as many bits as a set has shingles at least, ``BITS`` or twice that so many times; else all large sets look alike."""
    bits = BITS << np.ceil(np.log2(np.maximum(sizes, BITS) / BITS)).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.concatenate([[0], np.cumsum(bits // 64)])
    out = np.empty(starts[-1], np.int64)
    for length in np.unique(bits).tolist():
        mine = bits == length
        of = mine[doc]
        rows = signatures(h[of], (np.cumsum(mine) - 1)[doc[of]], int(mine.sum()), length)
        out[starts[:-1][mine][:, None] + np.arange(length // 64)] = rows
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out))


def _differ(x: Column, y: Column) -> Column:
    """Bits in which two signatures of one length differ."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, n: t + n)


def _folded(x: Column, y: Column) -> Column:
    """The signature ``x`` in the length of ``y``: that of half as many buckets is one half's parity with the other's.

    Null if the lengths are further apart.
    """
    half = F.size(y)
    fold = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))
    return F.when(F.size(x) <= half, x).when(F.size(x) == 2 * half, fold)


def may_link(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) less those whose signatures differ in more bits than linked sets can; and that number, differ.

    ``sets`` has key, n and sig.  Linked sets share at least ``needed`` shingles, so they differ
    in at most the sum of their sizes less twice that; no link is lost.
    """
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("an"), F.col("sig").alias("asig"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("bn"), F.col("sig").alias("bsig"))
    both = F.col("an") + F.col("bn")
    least = F.ceil(percent * both / (100 + percent))
    x, y = F.col("asig"), F.col("bsig")
    differ = F.coalesce(_differ(_folded(x, y), _folded(y, x)), F.lit(0))
    # One more is allowed for, as the quotient is no exact number.
    return pairs.join(right, "b").join(left, "a").withColumn("differ", differ).filter(
        F.col("differ") <= both - 2 * least + 2).select("a", "b", "differ")


def can_meet(rows: list[tuple], percent: int) -> list[tuple]:
    """Rows (h, key, n, place, ...) of a list less those that can be told with no other one, see :func:`rest_pairs`."""
    found = set()
    for i, (_, _, n, place, *_) in enumerate(rows):
        for j in range(i):
            m, other = rows[j][2:4]
            if 100 * min(n, m) >= percent * max(n, m) and (100 + percent) * min(n - place, m - other) >= percent * (n + m):
                found |= {i, j}
    return [rows[i] for i in sorted(found)]


def shared_lists(first: DataFrame, percent: int) -> DataFrame:
    """Rows (h, key, n, place) of lists with several sets, once each.

    Lists are dealt by shingle and read in order of sets, so a task holds one row of a list, and of one of ``HELD`` sets
    at most those that can meet another one (:func:`can_meet`).
    The list of a frequent shingle is dealt to ``PARTS`` parts, whose sets then meet.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []  # held: the list's rows so far; None when it is too long or frequent
        for batch in batches:
            rows = []
            for h, part, often, key, n, place in zip(*(batch.column(c).to_pylist() for c in (
                    "h", "part", "often", "key", "n", "place")), strict=True):
                if (h, part) != (last and last[:2]):
                    if held and len(held) > 1:
                        rows += can_meet(held, percent)
                    held = None if often else []  # a frequent one may meet others from other parts
                elif key == last[2]:
                    continue
                row = (h, key, n, place, often)
                if held is None:
                    rows.append(row)
                else:
                    held.append(row)
                    if len(held) > HELD:
                        rows += held
                        held = None
                last = (h, part, key)
            if rows:
                yield listed(rows)
        if held and len(held) > 1 and (rows := can_meet(held, percent)):
            yield listed(rows)

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(_LISTED.names, map(list, zip(*rows, strict=True)), strict=True)), schema=_LISTED)

    part = F.when(F.col("often"), F.pmod(F.xxhash64("key"), F.lit(PARTS))).otherwise(0).cast("int")
    dealt = first.select("h", part.alias("part"), "often", "key", "n", "place").repartition("h", "part").sortWithinPartitions(
        "h", "part", "key")
    rows = cut_lineage(dealt.mapInArrow(run, "h long, key binary, n int, place int, often boolean"))
    often = rows.filter("often")
    several = often.groupBy("h").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most").select("h")
    often = often.join(several, "h").select("h", "key", "n", "place")
    return rows.filter("not often").drop("often").unionByName(often)


_LISTED = pa.schema([("h", pa.int64()), ("key", pa.binary()), ("n", pa.int32()), ("place", pa.int32()), ("often", pa.bool_())])


def _alike(x: str, y: str, percent: int):
    """Whether sets of these sizes can link."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each set ``b`` and one other set of each of its lists (rows h, key, n).

    Each list has a set of its own, by a hash: a set of many lists meets many others, and a row makes a pair at most.
    """
    lead = lists.groupBy("h").agg(F.max(F.struct(F.xxhash64("h", "key"), "key", "n")).alias("lead")).select(
        "h", F.col("lead.key").alias("a"), F.col("lead.n").alias("an"))
    return lists.select("h", "key", "n").join(lead, "h").filter((F.col("a") != F.col("key")) & _alike("an", "n", percent)).select(
        "a", F.col("key").alias("b")).distinct()


def centres(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Of each large component (``nodes``: key, component) the set nearest, by signature, to what most of its sets have: main, a, an."""
    members = nodes.join(sets.select("key", "n", "sig"), "key").withColumn("words", F.size("sig"))
    usual = members.groupBy("component", "words").count().filter(F.col("count") >= LARGE).groupBy("component").agg(
        F.max(F.struct("count", "words")).alias("usual")).select("component", "usual.*")
    members = cut_lineage(members.join(F.broadcast(usual) if usual.count() <= BROADCAST_ROWS else usual, ["component", "words"]))
    some = members.filter(F.pmod(F.xxhash64("key"), F.ceil(F.col("count") / VOTES)) == 0)
    one = lambda i: F.shiftrightunsigned("bits", i).bitwiseAND(F.lit(1))
    most = [F.when(2 * F.sum(one(i)) > F.count(F.lit(1)), F.lit(1 << i if i < 63 else -1 << 63)).otherwise(F.lit(0)) for i in range(64)]
    votes = some.select("component", F.posexplode("sig").alias("place", "bits")).groupBy("component", "place").agg(
        reduce(lambda x, y: x.bitwiseOR(y), most).alias("bits"))
    middle = cut_lineage(votes.groupBy("component").agg(
        F.array_sort(F.collect_list(F.struct("place", "bits")))["bits"].alias("middle")))
    few = middle.count() <= BROADCAST_ROWS
    return cut_lineage(members.join(F.broadcast(middle) if few else middle, "component").groupBy(F.col("component").alias("main")).agg(
        F.min(F.struct(_differ(F.col("sig"), F.col("middle")).alias("differ"), "key", "n")).alias("centre")).select(
        "main", F.col("centre.key").alias("a"), F.col("centre.n").alias("an")))


def _outside(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the lists that hold several components, with each list's largest (main); and those of other components."""
    sizes = placed.groupBy("h", "component").count()
    mains = sizes.groupBy("h").agg(F.max(F.struct("count", "component"))["component"].alias("main"),
                                   F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("h", "main")
    placed = cut_lineage(placed.join(mains, "h"))
    return placed, placed.filter(F.col("component") != F.col("main"))


def centre_pairs(placed: DataFrame, centre: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each set ``b`` and the centres of the largest components of its lists, where it is of another one."""
    _, outside = _outside(placed)
    few = centre.count() <= BROADCAST_ROWS
    return outside.join(F.broadcast(centre) if few else centre, "main").filter(_alike("an", "n", percent)).select(
        "a", F.col("key").alias("b")).distinct()


def rest_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in different components that share a list and have one end outside its largest component.

    A pair is told in the list of the first shingle that both have: what they share lies from their places
    on, and must be enough for their sizes.  So the smaller set is there early, as for a set of its own size; rows are
    divided by that before they meet.
    """
    placed, outside = _outside(placed)
    outside = outside.select("h", F.col("key").alias("x"), F.col("n").alias("xn"), F.col("place").alias("xplace"),
                             F.col("component").alias("xc"))
    inside = placed.select("h", "key", "n", "place", "component")
    enough = lambda shared, sizes: shared.cast("long") * (100 + percent) >= percent * sizes.cast("long")
    early = lambda n, place: enough(F.col(n) - F.col(place), 2 * F.col(n).cast("long"))
    met = outside.filter(early("xn", "xplace")).join(inside, "h").filter("xn <= n").unionByName(
        outside.join(inside.filter(early("n", "place")), "h").filter("n < xn"))
    return met.filter((F.col("xc") != F.col("component")) & enough(
        F.least(F.col("xn") - F.col("xplace"), F.col("n") - F.col("place")), F.col("xn").cast("long") + F.col("n"))).select(
        F.least("x", "key").alias("a"), F.greatest("x", "key").alias("b")).distinct()


def linked_pairs(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the candidate pairs (a, b) that link; ``texts`` has key and text.

    A pair brings its own texts, so a query with very many candidates needs no one task; runs
    of one query in a partition are searched together, ``INDEXED`` candidates at a time.
    """
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("b_text"))
    rows = pairs.join(right, "b").join(left, "a").sortWithinPartitions("a")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "b_text", HASHED):
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                h, sizes = shingle_sets(part.column("b_text").to_pylist(), width)
                sets = np.split(h, np.cumsum(sizes)[:-1])
                at = 0
                while at < len(a):
                    to = at
                    while to < len(a) and a[to] == a[at] and to - at < INDEXED:
                        to += 1
                    query, _ = shingle_sets([part.column("a_text")[at].as_py()], width)
                    reached = divide_skip(query, sets[at:to], percent)
                    yes = [b[at + i] for i in np.flatnonzero(reached)]
                    if yes:
                        yield pa.RecordBatch.from_pydict({
                            "a": pa.array([a[at]] * len(yes), pa.binary()), "b": pa.array(yes, pa.binary())})
                    at = to
        batch = part = a = b = h = sizes = sets = None
        give_back()

    return cut_lineage(rows.mapInArrow(search, "a binary, b binary"))


def _texts(keyed: DataFrame, named: DataFrame) -> DataFrame:
    """key and text of the sets ``named`` (key, id, tk); a few are broadcast, after a count."""
    named = cut_lineage(named.select("key", "id", "tk"))
    few = named.count() <= BROADCAST_ROWS
    rows = keyed.select("id", "tk", "text").join(F.broadcast(named) if few else named, ["id", "tk"])
    return cut_lineage(rows.select("key", "text"))


def classes(docs: DataFrame, width: int = 4, percent: int = 85, carry: list[str] = ()) -> DataFrame:
    """Documents and their classes: doc_id, n_shingles, component_id, and the columns ``carry`` of ``docs``.

    A document's set is its distinct shingles of ``width`` words in lower case (A-Z only);
    two documents link when 100 * shared >= percent * union.  ``component_id`` is the smallest
    doc_id reachable by links, its own included.

    Equal sets are one node.  Each node lists the first shingles of its set (prefix); nodes
    that link meet in a list.  First each node is compared with the nearest, by signature, of
    one other node of each of its lists, which joins large groups of copies by about one pair
    per node.  Nodes that are left out of a list's largest component are then compared with its centre, one
    pair per node again (:func:`centres`).  Last, in lists that still hold several components, every node outside the list's largest component is compared
    with the others that it can share enough with, by their places in the list
    (:func:`rest_pairs`): each link between different components has such an end, so none is lost.  Candidates whose
    signatures differ too much are left out (:func:`may_link`), the others are verified by
    :func:`divide_skip` on whole sets.

    Null, empty and wordless texts have 0 shingles and no links.  Rows with null ids take part and
    may connect others; a component without any id has the component id null.  Equal rows are
    kept one by one.  An empty table gives an empty result.
    """
    keyed = with_row_key(docs.select("doc_id", "text", *[c for c in carry if c not in ("id", "tk")]))
    carried = [*dict.fromkeys(["doc_id", "id", "tk", *carry])]
    found = cut_lineage(set_rows(keyed, width, percent, carried))
    rows = found.filter("h is null").drop("h", "often", "place")
    bare = rows.drop("sig")
    lists = cut_lineage(shared_lists(found.filter("h is not null").select("h", "key", "n", "place", "often"), percent))
    own = cut_lineage(rows.filter("key is not null").join(lists.select("key").distinct(), "key", "left_semi").groupBy("key").agg(
        F.min(F.struct("id", "tk")).alias("row"), F.first("n").alias("n"), F.first("sig").alias("sig")).select(
        "key", "row.id", "row.tk", "n", "sig"))

    def linked(pairs: DataFrame) -> DataFrame:
        named = own.join(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi")
        return linked_pairs(pairs, _texts(keyed, named), width, percent)

    def nearest(pairs: DataFrame) -> DataFrame:
        return linked(cut_lineage(may_link(pairs, own, percent).groupBy("b").agg(
            F.min(F.struct("differ", "a")).alias("near")).select("near.a", "b")))

    def place() -> DataFrame:
        return cut_lineage(lists.join(nodes, "key", "left").withColumn(
            "component", F.coalesce("component", "key")))

    def joined() -> DataFrame:
        return components(edges).withColumnRenamed("id", "key")

    edges = nearest(star_pairs(lists, percent))
    nodes = joined()
    placed = place()
    centre = centres(nodes, own)
    if not centre.isEmpty():
        edges = edges.unionByName(nearest(centre_pairs(placed, centre, percent)))
        nodes = joined()
        placed = place()
    more = linked(cut_lineage(may_link(rest_pairs(placed, percent), own, percent).select("a", "b")))
    if not more.isEmpty():
        edges = edges.unionByName(more)
        nodes = joined()

    in_class = bare.join(nodes, "key", "left").withColumn("component", F.coalesce("component", "key"))
    in_class = cut_lineage(in_class)
    least = in_class.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return in_class.join(least, "component", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), *carry)
