"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept in sorted hash arrays.

Files of a model, in a folder that driver and executors share:

* ``words-….hash`` / ``.count`` / ``.prob``: sorted 64-bit word hashes (shard by the top bits),
  the words' counts, and their lowest-order probabilities.  A word's id is its place.
* ``pairs-….key`` / ``.prob``: sorted keys ``id << 32 | next id`` and the discounted share.
* ``heads-….id`` / ``.rest``: ids of contexts and the mass left for the lower order.

Workers map the files into memory and look whole batches up by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut_lineage, filesystem, lower_ascii, map_chunks

#: The end of a text as a word: it holds a space, as no word does.
END = xxhash.xxh64_intdigest(b"</ end>")

#: Training tokens per shard of pairs, and words per shard of the vocabulary.
SHARD_TOKENS, SHARD_WORDS = 1_500_000, 500_000

#: Text bytes that a task counts or scores at a time.
PART_BYTES = 1 << 21

#: Contexts with more than one of this many tokens are dealt over all shards.
FREQUENT = 1000

#: Pairs a counting task holds before it hands them on.
HELD_PAIRS = 1_000_000

#: Words whose hashes a worker remembers.
KNOWN_WORDS = 250_000

_KNOWN: dict[bytes, int] = {}


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens (words, then the end of each text), and tokens per text."""
    words = [lower_ascii(t).split() if t else [] for t in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    flat = [w for ws in words for w in ws]
    out = np.full(int(sizes.sum()), END, np.uint64)
    if flat:
        code, unique = pd.factorize(np.array(flat, object))
        if len(_KNOWN) + len(unique) > KNOWN_WORDS:
            _KNOWN.clear()
        for w in unique:
            if w not in _KNOWN:
                _KNOWN[w] = xxhash.xxh64_intdigest(w)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(sizes) - 1] = False
        out[inner] = np.array([_KNOWN[w] for w in unique], np.uint64)[code]
    return out, sizes


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _save(folder: str, name: str, x: np.ndarray) -> None:
    """Written under another name, then moved: a second attempt replaces the file with the same bytes."""
    from pyspark import TaskContext

    fs, top = filesystem(folder)
    fs.create_dir(top, recursive=True)
    part = f"{top}/{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(part) as f:
        f.write(np.ascontiguousarray(x).tobytes())
    fs.move(part, f"{top}/{name}")


def _map(folder: str, name: str, dtype) -> np.ndarray:
    fs, top = filesystem(folder)
    path = f"{top}/{name}"
    if fs.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if fs.type_name == "local":
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:  # a store that can't be mapped
        return np.frombuffer(f.read(), dtype)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2, D3+ of counts of counts n1..n4, kept within bounds on tiny data."""
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), k - 0.1 if k < 3 else 2.9) for k, d in enumerate(raw, 1))


class Words:
    """Vocabulary arrays of a model, mapped: ids of hashes, counts and probabilities of ids."""

    def __init__(self, folder: str, sizes: list[int]):
        self.bits = (len(sizes) - 1).bit_length()
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.folder, self.held = folder, {}

    def array(self, kind: str, shard: int, dtype) -> np.ndarray:
        if (kind, shard) not in self.held:
            there = self.base[shard + 1] > self.base[shard]  # an empty shard has no file
            self.held[kind, shard] = np.zeros(0, dtype) if not there else _map(self.folder, f"words-{shard}.{kind}", dtype)
        return self.held[kind, shard]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(shard, np.arange(len(self.base)))
        for s in range(len(self.base) - 1):
            part = hashes[cuts[s]:cuts[s + 1]]
            known = self.array("hash", s, np.uint64)
            if len(part) and len(known):
                at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                out[cuts[s]:cuts[s + 1]] = np.where(known[at] == part, at + self.base[s], -1)
        return out

    def values(self, kind: str, ids: np.ndarray, dtype, missing) -> np.ndarray:
        """Values of ids; ``missing`` for ids below 0 and beyond the vocabulary."""
        out = np.full(len(ids), missing, dtype)
        shard = np.searchsorted(self.base, ids, "right") - 1
        for s in np.unique(shard[(ids >= 0) & (ids < self.base[-1])]):
            here = (shard == s) & (ids >= 0)
            out[here] = self.array(kind, int(s), dtype)[ids[here] - self.base[s]]
        return out


class Model:
    """A written model, opened by a worker."""

    def __init__(self, folder: str, spec: dict):
        self.folder, self.spec = folder, spec
        self.words = Words(folder, spec["words"])
        self.n, self.v, self.shards = spec["tokens"], sum(spec["words"]), spec["shards"]
        self.often = np.array(spec["frequent"], np.int64)
        self.held: dict = {}

    def _array(self, name: str, dtype) -> np.ndarray:
        if name not in self.held:
            self.held[name] = _map(self.folder, name, dtype) if self.n else np.zeros(0, dtype)
        return self.held[name]

    def _find(self, kind: str, key: str, keys: np.ndarray, shard: np.ndarray, value: str, missing: float) -> np.ndarray:
        out = np.full(len(keys), missing)
        if not len(keys):
            return out
        order = np.argsort(shard, kind="stable")  # keys stay sorted in each shard
        there, first = np.unique(shard[order], return_index=True)
        for s, here in zip(there.tolist(), np.split(order, first[1:]), strict=True):
            known = self._array(f"{kind}-{s}.{key}", np.uint64)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[here]), len(known) - 1)
                hit = known[at] == keys[here]
                out[here[hit]] = self._array(f"{kind}-{s}.{value}", np.float64)[at[hit]]
        return out

    def score(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        hashes, sizes = token_hashes(texts)
        ends = np.cumsum(sizes)
        unique, inverse = np.unique(hashes, return_inverse=True)
        own = self.words.ids(unique)
        counts = self.words.values("count", own, np.int64, 0)
        lower = self.words.values("prob", own, np.float64, self.spec["unknown"])
        base = np.log10((counts + 0.5) / (self.n + 0.5 * (self.v + 1)))
        ids = own[inverse]
        head = np.empty_like(ids)
        head[1:] = ids[:-1]
        head[ends - sizes] = self.v  # a text's start
        seen = (head >= 0) & (ids >= 0)
        key, back = np.unique(head[seen].astype(np.uint64) << np.uint64(32) | ids[seen].astype(np.uint64),
                              return_inverse=True)
        heads = (key >> np.uint64(32)).astype(np.int64)
        share = self._find("pairs", "key", key, shard_of(key, self.often, self.shards), "prob", 0.0)
        u, u_back = np.unique(head, return_inverse=True)
        rest = np.ones(len(u))
        rest[u >= 0] = self._find("heads", "id", u[u >= 0].astype(np.uint64), u[u >= 0] % self.shards, "rest", 1.0)
        prob = lower[inverse] * rest[u_back]
        prob[seen] += share[back]
        start = ends - sizes
        return {"n_tokens": sizes, "n_known": np.add.reduceat((counts > 0)[inverse].astype(np.int64), start),
                "base_score": np.add.reduceat(base[inverse], start), "score": np.add.reduceat(np.log10(prob), start)}


def shard_of(keys: np.ndarray, often: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each pair: by its context, by both words for frequent contexts."""
    head = (keys >> np.uint64(32)).astype(np.int64)
    tail = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return np.where(np.isin(head, often), head + tail, head) % shards


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def train(docs: DataFrame, folder: str) -> dict:
    """Count and write a model of the whole texts of ``docs``; returns its description.

    Words and pairs are added up in each task before they are shuffled.  Pairs are dealt to
    shards by their context, those of very frequent contexts by both words, so a shard grows
    with the corpus over the number of shards, which grows with the corpus, too.  What comes
    to the driver: sums, and one number per shard and per frequent context (under a thousand).
    """
    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add(parts):
            h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, inverse = np.unique(h, return_inverse=True)
            return u, np.bincount(inverse, weights=n).astype(np.int64)

        for batch in batches:
            for part in chunks(batch, most=PART_BYTES):
                if part.num_rows:
                    held.append(np.unique(token_hashes(part.column("text").to_pylist())[0], return_counts=True))
                if sum(len(h) for h, _ in held) > HELD_PAIRS:
                    held = [add(held)]
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield pa.RecordBatch.from_pydict({"hash": _signed(held[0][0]), "n": held[0][1]})
                        held = []
        if held:
            h, n = add(held)
            yield pa.RecordBatch.from_pydict({"hash": _signed(h), "n": n})

    texts = docs.select("text")
    counted = cut_lineage(texts.mapInArrow(count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    n_words, n_tokens = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, (n_words // SHARD_WORDS).bit_length())

    def write_words(table: pa.Table) -> pa.Table:
        hashes = table.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        shard = int(table.column("shard")[0].as_py())
        counts = table.column("n").to_numpy()[order]
        _save(folder, f"words-{shard}.hash", hashes[order])
        _save(folder, f"words-{shard}.count", counts)
        often = np.flatnonzero(counts * FREQUENT > n_tokens)
        return pa.table({"shard": pa.array([shard] * (1 + len(often)), pa.int32()), "n": pa.array(
            [len(hashes), *often], pa.int64())})

    top = F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)
    rows = counted.withColumn("shard", top).groupBy("shard").applyInArrow(write_words, "shard int, n long")
    sizes, frequent = [0] * (1 << bits), []
    listed: dict[int, list[int]] = {}
    for shard, n in cut_lineage(rows.groupBy("shard").agg(F.collect_list("n").alias("n"))).collect():
        sizes[shard], listed[shard] = n[0], n[1:]
    base = np.concatenate([[0], np.cumsum(sizes)])
    for shard, places in listed.items():
        frequent += [int(base[shard] + p) for p in places]
    shards = max(8, -(-n_tokens // SHARD_TOKENS))
    often = np.array([*frequent, n_words], np.int64)  # the start of a text is a frequent context

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Words(folder, sizes), []

        def add(parts):
            k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(k)
            k, n = k[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            return k[first], np.add.reduceat(n, first) if len(k) else n

        def rows(part):
            k, n = part
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(shard_of(k, often, shards), pa.int32()), "key": _signed(k), "n": n.astype(np.int32)})

        for batch in batches:
            for part in chunks(batch, most=PART_BYTES):
                if not part.num_rows:
                    continue
                hashes, n_of = token_hashes(part.column("text").to_pylist())
                unique, inverse = np.unique(hashes, return_inverse=True)
                ids = words.ids(unique)[inverse].astype(np.uint64)
                head = np.empty_like(ids)
                head[1:] = ids[:-1]
                head[np.cumsum(n_of) - n_of] = n_words
                held.append(np.unique(head << np.uint64(32) | ids, return_counts=True))
                if sum(len(k) for k, _ in held) > HELD_PAIRS:
                    held = [add(held)]
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield from rows(held[0])
                        held = []
        if held:
            yield from rows(add(held))

    def add_pairs(table: pa.Table) -> pa.Table:
        keys, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy().astype(np.int64)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = keys[first], np.add.reduceat(n, first)
        shard = int(table.column("shard")[0].as_py())
        _save(folder, f"pairs-{shard}.key", keys)
        _save(folder, f"pairs-{shard}.n", n.astype(np.uint32))
        tails, n_tails = np.unique((keys & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        heads, head_rows = _head_rows(keys, n)
        wide = np.isin(heads, often)
        grade = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
        kinds = [("pair", np.arange(1, 5), grade), ("tail", tails, n_tails)]
        kinds += [(f"head{j}", heads[wide], head_rows[j][wide]) for j in range(4)]
        return pa.table({"kind": np.repeat([k for k, _, _ in kinds], [len(i) for _, i, _ in kinds]),
                         "shard": pa.array([shard] * sum(len(i) for _, i, _ in kinds), pa.int32()),
                         "id": np.concatenate([i for _, i, _ in kinds]).astype(np.int64),
                         "n": np.concatenate([x for _, _, x in kinds]).astype(np.int64)})

    pairs = texts.mapInArrow(count_pairs, "shard int, key long, n int")
    facts = cut_lineage(pairs.groupBy("shard").applyInArrow(add_pairs, "kind string, shard int, id long, n long")
                        .groupBy("kind", "id").agg(F.sum("n").alias("n")))
    small = {(k, i): n for k, i, n in facts.filter("kind <> 'tail'").collect()}  # 4 + 4 per frequent context
    d = discounts([small.get(("pair", k), 0) for k in range(1, 5)])
    wide_heads = {int(i): [small.get((f"head{j}", int(i)), 0) for j in range(4)] for i in often}

    def finish_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                keys = np.array(_map(folder, f"pairs-{shard}.key", np.uint64))
                n = np.array(_map(folder, f"pairs-{shard}.n", np.uint32)).astype(np.int64)
                heads, (total, n1, n2, n3) = _head_rows(keys, n)
                known = dict(wide_heads)
                for i in np.flatnonzero(np.isin(heads, often)):
                    total[i], n1[i], n2[i], n3[i] = known.pop(int(heads[i]))
                lone = [(h, x) for h, x in known.items() if h % shards == shard]  # here by id, with no pair here
                of = np.searchsorted(heads, (keys >> np.uint64(32)).astype(np.int64))
                _save(folder, f"pairs-{shard}.prob", (n - np.array([0, *d])[np.minimum(n, 3)]) / total[of])
                heads = np.concatenate([heads, np.array([h for h, _ in lone], np.int64)])
                columns = [np.concatenate([c, np.array([x[j] for _, x in lone], np.int64)])
                           for j, c in enumerate((total, n1, n2, n3))]
                rest = (d[0] * columns[1] + d[1] * columns[2] + d[2] * columns[3]) / np.maximum(columns[0], 1)
                mine = heads % shards == shard
                order = np.argsort(heads[mine])
                _save(folder, f"heads-{shard}.id", heads[mine][order].astype(np.uint64))
                _save(folder, f"heads-{shard}.rest", np.where(columns[0] > 0, rest, 1.0)[mine][order])
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32())})

    spark = docs.sparkSession
    there = cut_lineage(pairs_shards(spark, shards, folder))
    cut_lineage(there.repartition("shard").mapInArrow(finish_pairs, "shard int"))

    tails = facts.filter("kind = 'tail'")
    grades = {r[0]: r[1] for r in tails.groupBy(F.least("n", F.lit(5)).alias("g")).count().collect()}
    all_pairs, n_tails, t1, t2, t3 = tails.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.sum((F.col("n") == 1).cast("long")),
        F.sum((F.col("n") == 2).cast("long")), F.sum((F.col("n") > 2).cast("long"))).first()
    e = discounts([grades.get(k, 0) for k in range(1, 5)])
    spread = (e[0] * (t1 or 0) + e[1] * (t2 or 0) + e[2] * (t3 or 0)) / max(all_pairs, 1) if all_pairs else 1.0
    unknown = spread / (n_words + 1)

    def write_probs(table: pa.Table) -> pa.Table:
        shard = int(table.column("shard")[0].as_py())
        n = np.zeros(sizes[shard], np.int64)
        n[table.column("id").to_numpy() - base[shard]] = table.column("n").to_numpy()
        _save(folder, f"words-{shard}.prob", np.maximum(n - np.array([0, *e])[np.minimum(n, 3)], 0) / all_pairs + unknown)
        return pa.table({"shard": pa.array([shard], pa.int32())})

    if all_pairs:
        starts = [int(b) for b in base[1:-1]]
        shard = sum([(F.col("id") >= b).cast("int") for b in starts], F.lit(0)) if len(starts) < 64 else F.size(
            F.filter(F.array(*map(F.lit, starts)), lambda b: b <= F.col("id")))
        cut_lineage(tails.withColumn("shard", shard).groupBy("shard").applyInArrow(write_probs, "shard int"))
    return {"words": sizes, "tokens": n_tokens, "shards": shards, "frequent": often.tolist(), "unknown": unknown,
            "discounts": [d, e]}


def pairs_shards(spark, shards: int, folder: str) -> DataFrame:
    """The shards that have a file of pairs."""
    fs, top = filesystem(folder)
    from pyarrow.fs import FileSelector

    fs.create_dir(top, recursive=True)
    names = {i.base_name for i in fs.get_file_info(FileSelector(top))}
    return spark.createDataFrame([(s,) for s in range(shards) if f"pairs-{s}.key" in names], "shard int")


def _head_rows(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Contexts of sorted pairs: tokens, and how many followers came once, twice, more often."""
    head = (keys >> np.uint64(32)).astype(np.int64)
    if not len(head):
        return head, [head.copy() for _ in range(4)]
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    rows = [np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n > 2)]
    return head[first], rows


_MODELS: dict[str, Model] = {}


def score(docs: DataFrame, folder: str, spec: dict) -> DataFrame:
    """Scores of whole texts by a written model; see :func:`train_and_score`."""
    def make():
        model = _MODELS.get(folder)
        if model is None:
            _MODELS.clear()
            model = _MODELS[folder] = Model(folder, spec)

        def run(batch: pa.RecordBatch) -> dict | None:
            if not batch.num_rows:
                return None
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                    **model.score(batch.column("text").to_pylist()),
                    "train_tokens": pa.array([model.n] * batch.num_rows, pa.int64())}

        return run

    rows = docs.withColumn("held_out", is_held_out(F.col("doc_id")))
    return map_chunks(rows, ["doc_id", "text", "held_out"], "doc_id long, held_out boolean, n_tokens long, "
                      "n_known long, base_score double, score double, train_tokens long", make, PART_BYTES)


def train_and_score(docs: DataFrame, folder: str) -> DataFrame:
    """A model of the training documents, and the score of all: see the columns of :func:`score`.

    Tokens are words in lower case (A-Z only) and one end per text; null and empty texts are
    their end alone.  ``base_score`` is the add-half unigram log10 probability, ``score`` that
    of the bigram model; an unknown word has the share of the lowest order that is spread
    evenly over the vocabulary and one more word.  Null ids train.  Repeated rows count each.
    With no training text every token is unknown.  An empty table gives an empty result.
    """
    spec = train(docs.filter(~is_held_out(F.col("doc_id"))), folder)
    return score(docs, folder, spec)
