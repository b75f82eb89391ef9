"""Quality classifier by importance resampling with hashed n-grams."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, give_back, map_chunks, mix64

#: Hash buckets of single tokens and of pairs.
UNIGRAMS, BIGRAMS = 1 << 19, 1 << 18

#: Tokens that a weight is scaled to.
PASSAGE = 16

#: Labelled documents that the fit looks at, at most (those with the smallest hashes of their ids).
FIT_ROWS = 100_000

#: Words whose tokens a task remembers; they go with the task.
KNOWN_WORDS = 300_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Features:
    """Buckets of the tokens and token pairs of many texts at once."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        # Tokens of all known words one after the other; a word's number, start and length.
        self.known: dict[bytes, int] = {}
        self.pool, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KNOWN_WORDS:
            self._forget()
            new = words
        found = [[zlib.crc32(t.encode()) for t in _TOKEN.findall(w.decode().lower())] for w in new]
        sizes = np.array([len(f) for f in found], np.int64)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, np.array([t for f in found for t in f], np.uint64)])

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """64-bit token hashes of all texts one after the other, and the number of each text's."""
        words = [t.encode().split() if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        code, unique = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, np.int64), [])
        self._learn(list(unique))
        number = np.array([self.known[w] for w in unique], np.int64)
        pool, starts, sizes = self.pool, self.starts[number], self.sizes[number]
        of = sizes[code] if len(sizes) else np.zeros(0, np.int64)
        at = np.repeat(starts[code] - (np.cumsum(of) - of), of) + np.arange(of.sum()) if len(of) else of
        ends = np.concatenate([[0], np.cumsum(of)])
        bounds = np.concatenate([[0], np.cumsum([len(ws) for ws in words])])
        return mix64(pool[at], np.uint64(1)), np.diff(ends[bounds])

    @staticmethod
    def buckets(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each token, and of each token with the one before it (-1 at a text's start)."""
        one = (tokens % np.uint64(UNIGRAMS)).astype(np.int64)
        two = np.full(len(tokens), -1, np.int64)
        if len(tokens) > 1:
            two[1:] = (mix64(tokens[:-1], tokens[1:]) % np.uint64(BIGRAMS)).astype(np.int64) + UNIGRAMS
        starts = np.cumsum(sizes) - sizes
        two[starts[sizes > 0]] = -1
        return one, two


def bucket_counts(docs: DataFrame) -> DataFrame:
    """bucket, target, raw: n-grams of the documents flagged ``target`` and of all, over whole texts.

    Each task adds up its counts before anything is shuffled.
    """
    def run(batches):
        from .common import chunks

        sums = np.zeros((2, UNIGRAMS + BIGRAMS), np.int64)
        features = _Features()
        for batch in batches:
            for part in chunks(batch):
                tokens, sizes = features.tokens(part.column("text").to_pylist())
                one, two = features.buckets(tokens, sizes)
                good = np.repeat(part.column("target").to_numpy(zero_copy_only=False).astype(bool), sizes)
                for b in (one, two):
                    sums[1] += np.bincount(b[b >= 0], minlength=sums.shape[1])
                    sums[0] += np.bincount(b[good & (b >= 0)], minlength=sums.shape[1])
        there = np.flatnonzero(sums[1])
        for i in range(0, len(there), 100_000):
            at = there[i:i + 100_000]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "target": sums[0][at], "raw": sums[1][at]})
        sums = features = batch = part = tokens = sizes = one = two = good = None
        give_back()

    parts = docs.select("text", "target").mapInArrow(run, "bucket int, target long, raw long")
    return parts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(counts: DataFrame, z: float = 2.5) -> np.ndarray:
    """Log of target share over raw share per bucket, 0 where the two don't differ by ``z`` sigmas.

    Shares are taken among single tokens and among pairs apart, with half a count added.  Only
    buckets with a ratio come to the driver, at most one number per bucket of the fixed table.
    """
    counts = cut_lineage(counts.withColumn("pair", F.col("bucket") >= UNIGRAMS))
    totals = counts.groupBy("pair").agg(F.sum("target").alias("all_target"), F.sum("raw").alias("all_raw"))
    expected = F.col("raw") * F.col("all_target") / F.col("all_raw")
    sigma = z * F.sqrt(expected + 1)
    ratio = F.log((F.col("target") + 0.5) / (expected + 0.5))
    marked = counts.join(F.broadcast(totals), "pair").filter(  # two rows
        (F.col("all_target") > 0) & (F.abs(F.col("target") - expected) > sigma))
    rows = marked.select("bucket", ratio.alias("ratio")).toPandas()
    table = np.zeros(UNIGRAMS + BIGRAMS, np.float32)
    table[rows["bucket"].to_numpy(np.int64)] = rows["ratio"]
    return table


def log_weights(docs: DataFrame, table: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``log_weight``: the log ratio of a whole text, per ``PASSAGE`` tokens.

    A sum or a minimum over passages would follow the length of a text.  Texts without tokens get 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)  # of fixed size
    schema = docs.select(*keep).schema.add("log_weight", "double")

    def make():
        features = _Features()

        def run(batch: pa.RecordBatch) -> dict:
            ratios = shared.value
            tokens, sizes = features.tokens(batch.column("text").to_pylist())
            one, two = features.buckets(tokens, sizes)
            score = ratios[one].astype(float) + np.where(two >= 0, ratios[two], 0)
            # Sums as differences of one running sum; in 2**-20 steps they are exact.
            run_sum = np.concatenate([[0], np.cumsum(np.round(score * (1 << 20)).astype(np.int64))])
            ends = np.cumsum(sizes)
            total = run_sum[ends] - run_sum[ends - sizes]
            return {**{c: batch.column(c) for c in keep}, "log_weight": total / np.maximum(sizes, 1) * (PASSAGE / (1 << 20))}

        return run

    return map_chunks(docs, [*dict.fromkeys([*keep, "text"])], schema, make)


def place_bar(scored: DataFrame) -> float:
    """Log weight that parts good from bad labelled documents with the fewest errors of either kind.

    ``scored`` has log_weight and good (boolean), at most ``FIT_ROWS`` rows; errors are shares
    of the good and of the bad.  Without good or bad rows nothing is rejected.
    """
    rows = scored.select("log_weight", "good").toPandas().sort_values("log_weight", ignore_index=True)
    good, value = rows["good"].to_numpy(bool), rows["log_weight"].to_numpy(float)
    if not good.any() or good.all():
        return -np.inf
    below_good = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    below_bad = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    # A good document lost weighs more than a bad one kept.
    loss = 2 * below_good - below_bad
    cut = np.concatenate([[True], value[1:] != value[:-1], [True]])
    loss[~cut] = np.inf
    least = np.flatnonzero(loss == loss.min())
    at = int(least[len(least) // 2])
    if at == 0:
        return -np.inf
    return float((value[at - 1] + value[at]) / 2) if at < len(value) else np.inf


def kth_largest(values: DataFrame, k: int, bits: int = 11) -> float | None:
    """The k-th largest of a column ``value`` of finite doubles, by counts of ever finer ranges.

    Doubles are ordered by their bits; each round counts ``2**bits`` ranges and goes into the
    one that holds the k-th, so at most that many rows come to the driver and nothing is sorted.
    """
    if k <= 0:
        return None
    ordered = values.selectExpr("value").mapInArrow(_ordered_bits, "value double, code long")
    ordered = cut_lineage(ordered)
    low, shift = None, 63
    prefix = 0
    while shift > 0:
        width = min(bits, shift)
        shift -= width
        live = ordered if low is None else ordered.filter(F.shiftright("code", shift + width) == prefix)
        counts = {r[0]: r[1] for r in live.groupBy(F.shiftright("code", shift).alias("b")).count().collect()}
        low = 0
        for b in sorted(counts, reverse=True):
            if counts[b] >= k:
                prefix = b
                break
            k -= counts[b]
        else:
            return None
    return ordered.filter(F.col("code") == prefix).first()["value"]


def _ordered_bits(batches):
    for batch in batches:
        raw = batch.column("value").to_numpy(zero_copy_only=False).view(np.uint64)
        top = np.uint64(1 << 63)
        code = np.where(raw & top, ~raw, raw | top) >> np.uint64(1)
        yield pa.RecordBatch.from_pydict({"value": batch.column("value"), "code": pa.array(code.astype(np.int64))})


def _sample(marks: DataFrame, most: int, seed: int) -> DataFrame:
    """About ``most`` rows, and no more: those with the smallest hashes of their ids."""
    n = marks.count()
    if n <= most:
        return marks
    bits = 40
    share = int((1 << bits) * most / n * (1 - 4 / most ** 0.5))  # four sigmas below
    return marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << bits)) < share).limit(most)


def quality_filter(docs: DataFrame, labels: DataFrame, seed: int = 11, temperature: float = 0.02,
                   fit_rows: int = FIT_ROWS, carry: list[str] = ()) -> DataFrame:
    """Importance resampling of documents: doc_id, log_weight, gumbel_key, kept, and columns ``carry`` of ``docs``.

    The fit looks at ``fit_rows`` labelled documents at most, those with the smallest hash of
    their id.  The target model is that of the whole texts of quality 1 among them that are not
    toxic, the raw model that of all documents.  How many are drawn (k) is the number of
    documents whose log weight clears a bar placed on the labelled ones.  The k documents with the largest log weight plus
    ``temperature`` times Gumbel noise are kept, with all that tie with the last; the noise
    comes from a hash of the id and the seed, so reruns agree and equal rows share their fate.

    Null and empty texts weigh 0, rows with null ids take part with noise of their own hash;
    labels with null fields are left out, and an id labelled twice is good only if all its
    labels are.  Without usable labels everything is kept.  An empty table gives an empty result.
    """
    marks = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    marks = cut_lineage(_sample(marks, fit_rows, seed))
    # Of bounded size, so no text is shuffled.
    marked = docs.select("doc_id", "text", *carry).join(F.broadcast(marks), "doc_id", "left")
    table = log_ratios(bucket_counts(marked.select("text", F.coalesce("good", F.lit(False)).alias("target"))))
    scored = cut_lineage(log_weights(marked, table, ["doc_id", "good", *carry]))
    # Repeated rows of a labelled id count once.
    bar = place_bar(scored.filter("good is not null").groupBy("doc_id").agg(
        F.first("good").alias("good"), F.min("log_weight").alias("log_weight")))
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = cut_lineage(scored.withColumn("gumbel_key", F.col("log_weight") - temperature * F.log(-F.log(uniform))))
    k = keyed.filter(F.col("log_weight") >= F.lit(bar)).count()
    last = kth_largest(keyed.select(F.col("gumbel_key").alias("value")), k)
    kept = F.lit(False) if last is None else F.col("gumbel_key") >= F.lit(last)
    return keyed.select("doc_id", "log_weight", "gumbel_key", kept.alias("kept"), *carry)
