"""Removal of long repeated strings, found by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, cut_lineage, map_chunks, mix64, with_row_key

#: Bytes of an anchor at most, the first digit that suffixes are dealt by.  Shorter ones are
#: rarer in a text but found again by chance.
ANCHOR = 64

#: Different contexts of one anchor above which its windows are dealt one by one.
HOT = 20_000

#: Bytes of contexts that are sorted at a time.
SORT_BYTES = 1 << 23

#: Bytes that are scanned for anchors together: few enough that the hashes of all stay in a core's cache.
SCAN_BYTES = 1 << 17

_PLACE = (1 << 23) - 1


def anchor_size(length: int) -> int:
    """The largest power of two up to a third of ``length`` and ``ANCHOR``."""
    return 1 << (max(1, min(ANCHOR, length // 3)).bit_length() - 1)


class Scan:
    """Anchors of many texts: the least-hashed few bytes of each window of ``length`` bytes.

    Which anchor a window has depends on its bytes alone, so equal windows have equal anchors
    at equal distance.  ``doc, p, first, last, hash`` describe each anchor: its text, place,
    the first and last window (by start) that it stands for, and its hash.  Places count from
    the text's start.
    """

    def __init__(self, texts: list[bytes], length: int):
        pieces = []
        for i, t in enumerate(texts):
            if len(t) >= length:
                step = CHUNK_BYTES
                pieces += [(i, s, t[s:s + step + length - 1]) for s in range(0, len(t) - length + 1, step)]
        self.parts = []
        at = 0
        while at < len(pieces):
            to, size = at, 0
            while to < len(pieces) and (to == at or size + len(pieces[to][2]) <= SCAN_BYTES):
                size += len(pieces[to][2])
                to += 1
            self.parts.append(self._scan(pieces[at:to], length))
            at = to
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)] if self.parts else [
            np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
        self.doc, self.p, self.first, self.last, self.hash = columns

    @staticmethod
    def _scan(pieces: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(b for _, _, b in pieces), np.uint8)
        n, anchor_bytes = len(data), anchor_size(length)
        lens = np.array([len(b) for _, _, b in pieces])
        ends = np.cumsum(lens)
        h, k = data.astype(np.uint64) + np.uint64(1), 1
        while k < anchor_bytes:
            h[:n - k] = mix64(h[:n - k], h[k:])
            k *= 2
        m = (h & ~np.uint64(_PLACE)) | np.arange(n, dtype=np.uint64)
        wide, k = length - anchor_bytes + 1, 1
        while k * 2 <= wide:
            m[:n - k] = np.minimum(m[:n - k], m[k:])
            k *= 2
        if wide > k:
            m[:n - (wide - k)] = np.minimum(m[:n - (wide - k)], m[wide - k:])
        piece = np.repeat(np.arange(len(pieces)), lens)
        start = np.flatnonzero(np.arange(n) + length <= ends[piece])
        anchor = (m[start] & np.uint64(_PLACE)).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (piece[start[1:]] != piece[start[:-1]])
        at = np.flatnonzero(new)
        p, first = anchor[at], start[at]
        last = start[np.append(at[1:], len(start)) - 1]
        of = piece[first]
        shift = np.array([s for _, s, _ in pieces])[of] - (ends - lens)[of]
        return np.array([i for i, _, _ in pieces])[of], p + shift, first + shift, last + shift, h[p]


def equal_windows(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which windows (by ``start`` in ``data``) equal another one of their group, byte by byte.

    Most-significant-digit radix passes over digits of eight bytes: each pass orders the
    members of a group by their next digit and splits it where digits differ; groups of one
    drop out.  What is left after ``length`` bytes are the groups of equal windows.
    """
    found = np.zeros(len(start), bool)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    digits = np.zeros(len(data), np.uint64)
    for k in range(8):
        digits = digits << np.uint64(8) | padded[k:k + len(data)]
    order = np.argsort(group, kind="stable")
    group, at = group[order], start[order]

    def single() -> np.ndarray:
        edge = np.ones(len(group) + 1, bool)
        edge[1:-1] = group[1:] != group[:-1]
        return edge[1:] & edge[:-1]

    for depth in [*range(0, length - 8, 8), length - 8]:
        alone = single()
        if alone.any():
            group, at, order = group[~alone], at[~alone], order[~alone]
        if not len(group):
            return found
        digit = digits[at + depth]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(first, len(group)))
        mixed = np.logical_or.reduceat(digit != np.repeat(digit[first], size), first)
        if mixed.any():
            sub = np.flatnonzero(np.repeat(mixed, size))
            by = sub[np.lexsort((digit[sub], group[sub]))]
            at[sub], order[sub], digit[sub] = at[by], order[by], digit[by]
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new)
    found[order[~single()]] = True
    return found


def _window_hashes(data: np.ndarray, length: int, seed: int) -> np.ndarray:
    """64-bit hash of the ``length`` bytes from each place on (no meaning near the end)."""
    n = len(data)
    h, k, done, out = mix64(data.astype(np.uint64), np.uint64(seed)), 1, 0, np.full(n, seed, np.uint64)
    while k <= length:
        if length & k:
            out[:n - done] = mix64(out[:n - done], h[done:])
            done += k
        nxt = h.copy()
        nxt[:n - k] = mix64(h[:n - k], h[k:])
        h, k = nxt, k * 2
    return out


def _ranges(flags: np.ndarray, sizes: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """Runs of true in each of the parts of ``flags``: first and last places, from the part's start."""
    part = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flags)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    on = np.flatnonzero(flags)
    new = np.ones(len(on), bool)
    new[1:] = (np.diff(on) > 1) | (part[on[1:]] != part[on[:-1]])
    starts, ends = on[new], on[np.append(new[1:], True)] if len(on) else on
    cuts = np.searchsorted(part[starts], np.arange(len(sizes) + 1))
    return ([place[starts[a:b]].tolist() for a, b in zip(cuts, cuts[1:], strict=False)],
            [place[ends[a:b]].tolist() for a, b in zip(cuts, cuts[1:], strict=False)])


def repeated_spans(keyed: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Texts with a repeated anchor (id, tk, text), and the runs of repeated windows (id, tk, starts, ends)."""
    def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in chunks(batch):
                held.append(Scan([t.encode() for t in part.column("text").to_pylist()], length).hash)
                if sum(map(len, held)) > 2_000_000:
                    h, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int32())})
                    held = []
        if held:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int32())})

    counts = keyed.select("text").mapInArrow(count_anchors, "h long, n int").groupBy("h").agg(F.sum("n").alias("n"))
    often = cut_lineage(counts.filter("n > 1").select("h"))

    def places():
        def run(batch: pa.RecordBatch) -> dict:
            s = Scan([t.encode() for t in batch.column("text").to_pylist()], length)
            ids, tks = (batch.column(c).to_numpy()[s.doc] for c in ("id", "tk"))
            return {"h": pa.array(s.hash.view(np.int64)), "id": ids, "tk": tks, "p": pa.array(s.p, pa.int64())}

        return run

    found = map_chunks(keyed, ["id", "tk", "text"], "h long, id long, tk long, p long", places).join(often, "h")
    per_text = found.groupBy("id", "tk").agg(F.collect_set("p").alias("ps"))
    marked = cut_lineage(keyed.select("id", "tk", "text").join(per_text, ["id", "tk"]))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            for part in chunks(batch):
                texts = [t.encode() for t in part.column("text").to_pylist()]
                s = Scan(texts, length)
                ids, tks = part.column("id").to_pylist(), part.column("tk").to_pylist()
                wanted = [set(ps) for ps in part.column("ps").to_pylist()]
                rows = []
                for d, p, f, e, h in zip(*(x.tolist() for x in (s.doc, s.p, s.first, s.last, s.hash.view(np.int64))),
                                         strict=True):
                    if p in wanted[d]:
                        body = texts[d][f:e + length]
                        cid = hashlib.blake2b(body, digest_size=16, key=(p - f).to_bytes(4, "little")).digest()
                        new = cid not in sent
                        if new:
                            sent.add(cid)
                        rows.append((ids[d], tks[d], f, h, p - f, e - f + 1, cid, body if new else None))
                if len(sent) > 500_000:
                    sent.clear()  # what is sent twice is put together later
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(
                        ("id", "tk", "first", "h", "off", "n", "cid", "body"), map(list, zip(*rows, strict=True)),
                        strict=True)), schema=_CONTEXT)

    occurrences = cut_lineage(marked.mapInArrow(
        contexts, "id long, tk long, first long, h long, off int, n int, cid binary, body binary"))
    distinct = cut_lineage(occurrences.groupBy("cid").agg(
        F.max("body").alias("body"), F.min("h").alias("h"), F.min("off").alias("off"), F.min("n").alias("n"),
        F.count(F.lit(1)).alias("copies")))

    def judge(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        body = table.column("body").to_pylist()
        n, off, h = (table.column(c).to_numpy() for c in ("n", "off", "h"))
        starts = np.cumsum([0, *map(len, body)])[:-1]
        w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        _, group = np.unique(h, return_inverse=True)
        same = equal_windows(np.frombuffer(b"".join(body), np.uint8), np.repeat(starts, n) + w,
                             np.repeat(group, n) * (2 * length) + np.repeat(off, n) - w, length)
        same |= np.repeat(table.column("copies").to_numpy() > 1, n)
        first, last = _ranges(same, n)
        some = np.array([bool(x) for x in first])
        return pa.RecordBatch.from_pydict({
            "cid": table.column("cid").combine_chunks().filter(pa.array(some)),
            "first": pa.array([x for x in first if x], pa.list_(pa.int32())),
            "last": pa.array([x for x in last if x], pa.list_(pa.int32()))})

    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                h = part.column("h").to_numpy()
                if size > SORT_BYTES:
                    # Up to the next change of the anchor, what is held is complete.
                    change = np.flatnonzero(h != held[-1].column("h")[-1].as_py())
                    if len(change):
                        if change[0]:
                            held.append(part.slice(0, change[0]))
                        yield judge(held)
                        held, size, part = [], 0, part.slice(change[0])
                held.append(part)
                size += part.column("body").nbytes
        if held:
            yield judge(held)

    heavy = cut_lineage(distinct.groupBy("h").count().filter(F.col("count") > hot).select("h"))
    out = "cid binary, first array<int>, last array<int>"
    if heavy.isEmpty():
        usual, results = distinct, None
    else:
        usual = distinct.join(heavy, "h", "left_anti")
        results = _one_by_one(distinct.join(heavy, "h", "left_semi"), length)
    sorted_ = usual.select("cid", "body", "h", "off", "n", "copies").repartition("h").sortWithinPartitions("h")
    ranges = sorted_.mapInArrow(sort_groups, out)
    ranges = ranges.unionByName(results) if results is not None else ranges
    runs = occurrences.select("id", "tk", F.col("first").alias("from"), "cid").join(ranges, "cid")
    shifted = lambda c: F.transform(c, lambda x: x + F.col("from"))
    spans = runs.groupBy("id", "tk").agg(F.flatten(F.collect_list(shifted("first"))).alias("starts"),
                                         F.flatten(F.collect_list(shifted("last"))).alias("ends"))
    return marked.select("id", "tk", "text"), spans


_CONTEXT = pa.schema([("id", pa.int64()), ("tk", pa.int64()), ("first", pa.int64()), ("h", pa.int64()),
                      ("off", pa.int32()), ("n", pa.int32()), ("cid", pa.binary()), ("body", pa.binary())])


def _one_by_one(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of contexts whose anchor is too frequent for one task: a row per window.

    Windows are told apart by 128 bits of hash and counted with a partial sum in each task.
    """
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                body = part.column("body").to_pylist()
                n = part.column("n").to_numpy()
                data = np.frombuffer(b"".join(body), np.uint8)
                w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(np.cumsum([0, *map(len, body)])[:-1], n) + w
                of = np.repeat(np.arange(len(n)), n)
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(_window_hashes(data, length, 1)[at].view(np.int64)),
                    "b": pa.array(_window_hashes(data, length, 2)[at].view(np.int64)),
                    "cid": part.column("cid").take(pa.array(of)), "w": pa.array(w, pa.int32()),
                    "copies": part.column("copies").take(pa.array(of))})

    rows = contexts.select("cid", "body", "n", "copies").mapInArrow(
        windows, "a long, b long, cid binary, w int, copies long")
    again = rows.groupBy("a", "b").agg(F.sum("copies").alias("copies")).filter("copies > 1").select("a", "b")
    return rows.join(again, ["a", "b"], "left_semi").groupBy("cid").agg(
        F.collect_set("w").alias("first")).select("cid", "first", F.col("first").alias("last"))


def cover(starts: list[int], ends: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start in the given runs."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + length)
        else:
            out.append([s, e + length])
    return [(s, e) for s, e in out]


def drop_repeats(docs: DataFrame, length: int = 200, hot: int = HOT, keep_text: bool = False,
                 carry: list[str] = (), whole_characters: bool = False) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that starts anywhere else, too.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end) and,
    with ``keep_text``, kept (binary; with ``whole_characters`` less what spans leave of characters cut in half); also the columns ``carry`` of ``docs``.  Texts are UTF-8 bytes; windows never cross texts, may
    overlap in one text, and are judged on the input.

    Suffixes are first dealt by their anchor (see :class:`Scan`): counts of anchors, added up
    before the shuffle, leave those found twice; only their contexts (what all windows of
    the anchor span) go on, equal ones once per task.  Contexts that meet are ordered by
    radix passes down to ``length`` bytes.  An anchor with more than ``hot`` different
    contexts is handled window by window instead, so no group is held in one task.

    Null and empty texts and those shorter than ``length`` lose nothing.  Null ids are kept,
    equal rows count as copies of each other.  An empty table gives an empty result.
    """
    keyed = with_row_key(docs.select("doc_id", "text", *carry)).withColumn("text", F.coalesce("text", F.lit("")))
    marked, spans = repeated_spans(keyed, length, hot)

    def remove():
        def run(batch: pa.RecordBatch) -> dict:
            out = {"id": batch.column("id"), "tk": batch.column("tk"), "n_removed": [], "spans": [], "kept": [],
                   "kept_sha256": []}
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True):
                raw, runs, at, left = text.encode(), cover(starts, ends, length), 0, []
                for s, e in runs:
                    left.append(raw[at:s])
                    at = e
                left.append(raw[at:])
                out["n_removed"].append(len(raw) - sum(map(len, left)))
                if whole_characters:
                    left = [x.decode("utf-8", "ignore").encode() for x in left]
                left = b"".join(left)
                out["spans"].append([{"start": s, "end": e} for s, e in runs])
                out["kept"].append(left if keep_text else None)
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            out["n_removed"] = pa.array(out["n_removed"], pa.int64())
            out["spans"] = pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            out["kept"] = pa.array(out["kept"], pa.binary())
            return out

        return run

    joined = marked.join(spans, ["id", "tk"]).dropDuplicates(["id", "tk"])
    changed = map_chunks(joined, ["id", "tk", "text", "starts", "ends"], "id long, tk long, n_removed long, "
                         "spans array<struct<start: long, end: long>>, kept binary, kept_sha256 string", remove)
    sha = F.sha2(F.col("text").cast("binary"), 256)
    base = keyed.select("doc_id", "id", "tk", *carry, F.octet_length("text").cast("long").alias("n_bytes"), sha.alias("sha"),
                        *([F.col("text").cast("binary").alias("whole")] if keep_text else []))
    result = base.join(changed, ["id", "tk"], "left").select(
        "doc_id", *carry, "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "spans",
        *([F.coalesce("kept", "whole").alias("kept")] if keep_text else []))
    return result
