"""Phrase collocations by dynamic itemset counting.

Texts are dealt to shards, and the shards are scanned in a cycle.  Words are counted from
the first scan on.  A longer phrase is counted from the scan after both its subphrases
(without its last and without its first word) have been seen ``least`` times, and for one
full cycle: every shard once, wherever the cycle stands then.  So lengths are counted side
by side, and the scans end when no phrase is left to count.

No list of active phrases is sent around.  What every task knows is a table of bytes, of
at most ``MOST_SLOTS``, with the scan from which on a phrase's hash slot counts as reached.
Two phrases in one slot only mean that one of them is counted although it need not be, or
from another scan on; all tasks see the same table, so every count is of one full cycle.
Words and phrases are compared by 64-bit hashes, with the language mixed in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlog.functions.joins import keep_matching
from sessionlog.functions.scratch import scratch_path

from .common import cut_lineage, mix64

#: Shards of the cycle.
SHARDS = 4
#: Slots of the table of reached phrases: at most so many, and one for so many bytes of text.
MOST_SLOTS = 1 << 26
SLOT_BYTES = 128
#: Text bytes that a task hashes at a time, and rows that it adds up before it sends them.
SLICE_BYTES = 1 << 20
TALLY_ROWS = 1 << 21

_NEVER = 255
_DEALT = "lang string, text string, doc int"
# Characters between words of a piece, between pieces, and the case mapping.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_SPACES = b" \t"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_KIND = np.zeros(256, np.uint8)
_KIND[list(_SPACES)] = 1
_KIND[list(_BREAKS)] = 2
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte, A-Z as a-z; none for bytes between words."""
    values = mix64(np.arange(1, 257, dtype=np.uint64), np.full(256, 7, np.uint64))
    values[list(_UPPER)] = values[list(_UPPER.lower())]
    values[_KIND > 0] = 0
    return values


_VALUES = _byte_values()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
    grown = []
    for f in (_FACTOR, inverse):
        p = np.full(n, f, np.uint64)
        p[:1] = 1
        grown.append(np.multiply.accumulate(p))
    return grown[0], grown[1]


def lang_hash(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((lang if lang is not None else "und").encode(), digest_size=8).digest(), "little")


class Hasher:
    """Words of text bytes as arrays; keeps powers for the longest slice so far."""

    def __init__(self):
        self.up, self.down = _powers(1 << 16)

    def words(self, data: np.ndarray, starts: np.ndarray, langs: np.ndarray):
        """Word hashes, their starts and ends, and numbers that differ from piece to piece.

        ``starts`` are the places of documents in ``data``, ``langs`` their languages' hashes.
        """
        n = len(data)
        if n > len(self.up):
            self.up, self.down = _powers(max(n, 2 * len(self.up)))
        kind = _KIND[data]
        word = kind == 0
        first = np.zeros(n + 1, bool)
        first[starts] = True
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1] | first[1:n]
        end[:-1] &= ~word[1:] | first[1:n]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if not len(s):
            return np.zeros(0, np.uint64), s, e, s
        doc = np.searchsorted(starts, s, "right") - 1
        piece = np.cumsum(kind == 2, dtype=np.int64)[s] + doc
        sums = np.add.reduceat(_VALUES[data] * self.up[:n], s) * self.down[s]
        return mix64(sums + (e - s).astype(np.uint64), langs[doc]), s, e, piece


def _slices(offsets: np.ndarray, data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut the text bytes of a batch at documents, and long documents after a piece."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(end, at + most)
        if to < end:
            start = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if start > at:
                to = start
            else:
                breaks = np.flatnonzero(_KIND[data[at:to]] == 2)
                if len(breaks):
                    to = at + int(breaks[-1]) + 1
                else:
                    stop = int(offsets[np.searchsorted(offsets, at, "right")])
                    later = np.flatnonzero(_KIND[data[to:stop]] == 2)
                    to = to + int(later[0]) + 1 if len(later) else stop
        yield at, to
        at = to


def _scan(batches: Iterator[pa.RecordBatch], reached: np.ndarray, step: int, longest: int, hasher: Hasher):
    """For each slice of the texts: its bytes, words, and by length (places, hashes, scan of activation, reach).

    Batches have (lang, text, doc).  Hashes and reach are arrays over all words of the slice; only those places have a value
    at which the phrase is active at ``step``.
    """
    mask = np.uint64(len(reached) - 1)
    known: dict[str | None, int] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        codes = np.array([known.setdefault(x, lang_hash(x)) for x in langs], np.uint64)
        numbers = batch.column(2).to_numpy()
        texts = batch.column(1).cast(pa.large_string())
        if not len(texts) or texts.buffers()[2] is None:
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        for at, to in _slices(offsets, data, SLICE_BYTES):
            lo, hi = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, to, "left")
            starts = np.maximum(offsets[lo:hi], at) - at
            part = data[at:to]
            h1, s, e, piece = hasher.words(part, starts, codes[lo:hi])
            n = len(h1)
            if not n:
                continue
            doc = np.searchsorted(starts, s, "right") - 1 + lo
            levels = [(np.arange(n), h1, np.zeros(n, np.uint8), reached[(h1 & mask).astype(np.int64)])]
            for k in range(2, longest + 1):
                if n < k:
                    break
                _, below, _, reach = levels[-1]
                start = np.maximum(reach[:-1], reach[1:])[:n - k + 1]
                idx = np.flatnonzero((start <= step) & (piece[:n - k + 1] == piece[k - 1:]))
                h = np.zeros(n - k + 1, np.uint64)
                h[idx] = mix64(below[idx], h1[idx + (k - 1)])
                r = np.full(n - k + 1, _NEVER, np.uint8)
                # Another phrase may have marked the slot before this one was active.
                r[idx] = np.maximum(reached[(h[idx] & mask).astype(np.int64)], start[idx])
                levels.append((idx, h, start, r))
            yield part, s, e, doc, langs, codes, numbers, levels


class _Tally:
    """Counts by hash, added up in arrays, each with the number of a document that has it."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, h: np.ndarray, start: np.ndarray, doc: np.ndarray) -> None:
        u, first, n = np.unique(h, return_index=True, return_counts=True)
        self.parts.append((u, start[first], n, doc[first]))
        self.size += len(u)

    def merged(self):
        h, start, n, doc = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(h, kind="stable")
        h, start, n, doc = h[order], start[order], n[order], doc[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        out = h[at], start[at], np.add.reduceat(n, at), doc[at]
        self.parts, self.size = [out], len(at)
        return out

    def take(self):
        out = self.merged()
        self.parts, self.size = [], 0
        return out


def _counts(texts: DataFrame, reached, step: int, shards: int, longest: int) -> DataFrame:
    """Counts of one scan: h, k, start, n, doc.  Words per language have k = 0 and the language's hash.

    ``doc`` is the number of a document with the phrase, 0 for words.
    """
    schema = pa.schema([("h", pa.int64()), ("k", pa.int8()), ("start", pa.int16()), ("n", pa.int64()), ("doc", pa.int32())])

    def run(batches):
        table = np.frombuffer(reached.value, np.uint8)
        tallies = {k: _Tally() for k in range(longest + 1)}

        def rows(k):
            h, start, n, doc = tallies[k].take()
            return pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(np.full(len(h), k, np.int8)),
                 pa.array(start.astype(np.int16)), pa.array(n.astype(np.int64)), pa.array(doc)], schema=schema)

        for _, _, _, doc, _, codes, numbers, levels in _scan(batches, table, step, longest, Hasher()):
            none = np.zeros(len(doc), np.int32)
            number = numbers[doc]
            for k, (idx, h, start, _) in enumerate(levels, 1):
                if k == 1 and step < shards:
                    tallies[0].add(codes[doc], np.zeros(len(doc), np.uint8), none)
                counted = idx[step < start[idx].astype(np.int16) + shards]
                if len(counted):
                    tallies[k].add(h[counted], start[counted], (number if k > 1 else none)[counted])
                if tallies[k].size > TALLY_ROWS:
                    tallies[k].merged()
                    if tallies[k].size > TALLY_ROWS // 2:
                        yield rows(k)
        for k, tally in tallies.items():
            if tally.size:
                yield rows(k)

    return texts.mapInArrow(run, "h long, k byte, start short, n long, doc int")


def count_phrases(texts: DataFrame, path: str, least: int, longest: int, shards: int) -> tuple[DataFrame, np.ndarray]:
    """Counts of all words and phrases found ``least`` times, and the table of reached slots.

    ``texts`` has (lang, text).  Result: h, k (words; 0 for all words of a language), n, doc (number of a document with it).
    The texts are written to ``path``, one folder for each shard.
    """
    spark = texts.sparkSession
    place = F.monotonically_increasing_id()
    (texts.filter("text is not null").select("lang", "text")
     .withColumns({"shard": (place % shards).cast("int"), "doc": F.hash(place)})  # two documents may share a number
     .write.partitionBy("shard").parquet(path))
    dealt = spark.read.schema(f"{_DEALT}, shard int").parquet(path)
    size = dealt.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slots = 1 << min(MOST_SLOTS.bit_length() - 1, max(16, (size // SLOT_BYTES).bit_length()))
    table = np.full(slots, _NEVER, np.uint8)
    # Phrases that became active in the last scan or before have had their cycle ``shards`` scans later; a shard
    # without any of them ends nothing.
    open_, done, step, last = None, [], 0, 0
    while step < last + shards:
        sent = spark.sparkContext.broadcast(table.tobytes())  # at most MOST_SLOTS bytes
        shard = dealt.filter(F.col("shard") == step % shards).select("lang", "text", "doc")
        fresh = _counts(shard, sent, step, shards, longest).withColumn("reach", F.lit(None).cast("short"))
        rows = fresh if open_ is None else fresh.unionByName(open_)
        over = F.col("n") >= least
        state = rows.groupBy("h", "k", "start").agg(
            F.sum("n").alias("n"), F.min("doc").alias("doc"), F.min("reach").alias("reach")).withColumns({
            "reach": F.coalesce("reach", F.when(over, F.lit(step + 1).cast("short"))),
            "whole": F.col("start") + (shards - 1) <= step})
        state = cut_lineage(state.filter(~F.col("whole") | over | (F.col("k") == 0)))
        sent.unpersist()
        done.append(state.filter("whole").select("h", "k", "n", "doc"))
        open_ = state.filter("not whole").drop("whole")
        step += 1
        # Phrases of full length activate nothing, but they are looked up by this table in the end.
        if _mark(table, state.filter((F.col("reach") == step) & (F.col("k") > 0)), step, longest):
            last = step
    counts = done[0]
    for df in done[1:]:
        counts = counts.unionByName(df)
    return cut_lineage(counts), table


def _mark(table: np.ndarray, reached: DataFrame, step: int, longest: int) -> bool:
    """Note the slots of newly reached phrases; an earlier scan stays.  They arrive as bitmaps.

    The answer is whether one of them can be part of a longer phrase.
    """
    slot = F.col("h").bitwiseAND(F.lit(len(table) - 1)) + 1
    extend = False
    for row in reached.select(slot.alias("slot"), "k").groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"),
            F.min("k").alias("k")).collect():  # at most MOST_SLOTS bits
        extend |= row.k < longest
        bits = np.unpackbits(np.frombuffer(bytes(row.bits), np.uint8), bitorder="little").astype(bool)
        at = (row.bucket - 1) << 15
        here = table[at:at + len(bits)]
        here[bits[:len(here)] & (here == _NEVER)] = step
    return extend


def _phrases(dealt: DataFrame, counts: DataFrame, reached, longest: int) -> DataFrame:
    """Texts of the phrases of ``counts`` (h, k, n, doc): h, k, n, lang, phrase.

    Each phrase is looked up in the document that came with its count, so a text is made once for each phrase
    (more often where documents share a number).
    """
    wanted = counts.filter("k > 1").groupBy("doc").agg(F.collect_list("h").alias("hs"))  # no more than its text has
    wanted = cut_lineage(wanted)
    docs = keep_matching(dealt, wanted, ["doc"]).join(wanted, "doc").select("lang", "text", "doc", "hs")
    schema = pa.schema([("h", pa.int64()), ("k", pa.int8()), ("lang", pa.string()), ("phrase", pa.string())])

    def run(batches):
        table, hasher = np.frombuffer(reached.value, np.uint8), Hasher()
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                hs = one.column(3)[0].values.to_numpy().view(np.uint64)
                out, seen = [], set()
                for part, s, e, _, langs, _, _, levels in _scan([one], table, _NEVER - 1, longest, hasher):
                    for k, (idx, h, _, _) in enumerate(levels, 1):
                        here = idx[np.isin(h[idx], hs)] if k > 1 else idx[:0]
                        found, first = np.unique(h[here], return_index=True)
                        for x, i in zip(found.tolist(), here[first].tolist()):
                            if (x, k) not in seen:
                                seen.add((x, k))
                                words = (part[s[j]:e[j]].tobytes().lower() for j in range(i, i + k))
                                out.append((x - (1 << 64) if x >> 63 else x, k, langs[0], b" ".join(words).decode()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    found = docs.mapInArrow(run, "h long, k byte, lang string, phrase string").groupBy("h", "k").agg(
        F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))
    return found.join(counts.select("h", "k", "n"), ["h", "k"]).select("h", "k", "lang", "phrase", "n")


def _with_parts(phrases: DataFrame) -> DataFrame:
    """Add hashes: ``g`` of the language, ``cuts`` (at, left, right), ``inner`` (h, k) of shorter phrases within."""
    shape = ("h long, k byte, lang string, phrase string, n long, g long, "
             "cuts array<struct<at:int,left:long,right:long>>, inner array<struct<h:long,k:int>>")

    def run(batches):
        hasher = Hasher()
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                code = lang_hash(row["lang"])
                data = np.frombuffer(row["phrase"].encode(), np.uint8)
                h1 = hasher.words(data, np.zeros(1, np.int64), np.array([code], np.uint64))[0]
                at = {(i, 1): h1[i:i + 1] for i in range(len(h1))}
                for j in range(2, len(h1)):
                    for i in range(len(h1) - j + 1):
                        at[i, j] = mix64(at[i, j - 1], h1[i + j - 1:i + j])
                part = {x: signed(int(v[0])) for x, v in at.items()}
                k = row["k"]
                row["g"] = signed(code)
                row["cuts"] = [{"at": j, "left": part[0, j], "right": part[j, k - j]} for j in range(1, k)]
                row["inner"] = [{"h": v, "k": j} for (_, j), v in part.items() if 1 < j < k]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    part = pa.struct([("at", pa.int32()), ("left", pa.int64()), ("right", pa.int64())])
    inner = pa.struct([("h", pa.int64()), ("k", pa.int32())])
    arrow = pa.schema([("h", pa.int64()), ("k", pa.int8()), ("lang", pa.string()), ("phrase", pa.string()),
                       ("n", pa.int64()), ("g", pa.int64()), ("cuts", pa.list_(part)), ("inner", pa.list_(inner))])
    return phrases.mapInArrow(run, shape)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000,
                 shards: int = SHARDS) -> DataFrame:
    """The ``top`` phrases of each language by how much more often they occur than their parts suggest.

    Phrases have two to ``longest`` words and occur ``least`` times or more.  Cut after its first k words, a phrase of
    count a scores floor(1000 * a * n / (l * r)), with l and r the counts of its two parts and n that of all words of
    the language; its lowest score counts (ties: smallest k).  A phrase within a longer one that occurs as
    often is left out.  Result: lang, rank, phrase, a, l, r, n, score, by score and a descending,
    then phrase.  A null lang is ``und``, a null text has no words; other columns are not looked at.
    Repeated rows count as often as they come.  No rows give none.
    """
    spark: SparkSession = docs.sparkSession
    path = scratch_path(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counts, table = count_phrases(texts, path, least, longest, shards)
    dealt = spark.read.schema(_DEALT).parquet(path)
    sent = spark.sparkContext.broadcast(table.tobytes())  # at most MOST_SLOTS bytes
    found = cut_lineage(_with_parts(cut_lineage(_phrases(dealt, counts, sent, longest))))
    sent.unpersist()

    part = lambda side, at, n: counts.select(F.col("h").alias(side), F.col("k").alias(at), F.col("n").alias(n))
    number = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = (
        found.select("h", "k", "g", F.col("n").alias("a"), F.inline("cuts"))
        .withColumn("rest", F.col("k") - F.col("at"))
        .join(part("left", "at", "l"), ["left", "at"]).join(part("right", "rest", "r"), ["right", "rest"])
        .join(counts.filter("k = 0").select(F.col("h").alias("g"), F.col("n").alias("all")), "g")
        .withColumns({"over": (F.col("a") * 1000).cast("decimal(20,0)") * number("all"), "under": number("l") * number("r")})
        .withColumn("score", F.expr("over div under"))
        .groupBy("h", "k").agg(F.min(F.struct("score", "at", "l", "r", "all")).alias("best"))
    )
    longer = found.filter("k > 2").select(F.col("n").alias("longer"), F.inline("inner")).groupBy("h", "k").agg(
        F.max("longer").alias("longer"))
    kept = (
        found.select("h", "k", "lang", "phrase", F.col("n").alias("a"))
        .join(longer, ["h", "k"], "left").filter("longer is null or longer < a")
        .join(cuts, ["h", "k"])
        .select("lang", "phrase", "a", "best.l", "best.r", F.col("best.all").alias("n"), "best.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
