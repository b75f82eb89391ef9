"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionlog.functions.scratch import scratch_path, written

#: Words, for Spark and DuckDB patterns; ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that a Python task works on at a time.
CHUNK_BYTES = 1 << 22


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_uri(spark: SparkSession) -> str:
    """A new folder that driver and executors share, for files that tasks write themselves."""
    return scratch_path(spark)


def filesystem(uri: str):
    """pyarrow file system and the path in it, of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without space, tab, line feed, vertical tab, form feed, carriage return."""
    return text.encode().split() if text else []


def lower_ascii(text: str) -> bytes:
    """UTF-8 of ``text`` with A-Z lowered, other letters as they are."""
    return text.encode().lower()


def mix64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two 64-bit values each; not symmetric."""
    x = a * np.uint64(0xBF58476D1CE4E5B9) ^ (b + np.uint64(0x9E3779B97F4A7C15) + (a << np.uint64(6)))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` characters (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Return freed memory to the system: a task's worker stays for others, with what its allocators keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def map_chunks(df: DataFrame, columns: list[str], schema: str | StructType,
               make: Callable[[], Callable[[pa.RecordBatch], dict | None]],
               most: int = CHUNK_BYTES) -> DataFrame:
    """Run a function over ``columns`` of ``df`` in slices of bounded text size.

    ``make`` runs once per task and returns the function, which gives the new columns as
    a dict of arrays or lists.  ``columns`` must include ``text``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in chunks(batch, most=most):
                out = fn(part)
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)
        fn = batch = part = out = None
        give_back()

    return df.select(*columns).mapInArrow(run, schema)


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``id`` (the doc_id, null as the smallest long) and ``tk`` (a hash of the text).

    ``tk`` also tells a null id and a null text from others; rows with equal (id, tk) are equal rows.
    """
    return docs.withColumns({
        "id": F.coalesce("doc_id", F.lit(-(1 << 63))),
        "tk": F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), F.coalesce("text", F.lit("")))})


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, kept if executors are lost."""
    return written(df)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): columns id, component (smallest id reachable).

    Each node holds a label that only falls, and each round joins edges to their two labels
    once: the larger label is hooked to the smaller one, then labels jump to the label of
    their label.  Hooking works on whole trees, so the number of rounds is logarithmic in
    practice.  Edges within one tree are dropped, so later rounds are small.  Only counts
    come to the driver.  Null ends are ignored.
    """
    live = cut_lineage(edges.filter("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = cut_lineage(live.select(F.explode(F.array("a", "b")).alias("id")).distinct()
                        .withColumn("component", F.col("id")))
    for _ in range(rounds):
        if live.isEmpty():
            break
        # Here both ends of an edge are roots: hook each root to its smallest neighbour.
        hook = live.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up"))
        for _ in range(rounds):
            # Jump until every hook points to a root.
            top = hook.select(F.col("id").alias("up"), F.col("up").alias("upper"))
            hook = cut_lineage(hook.join(top, "up", "left").select(
                "id", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")))
            if hook.filter("moved").isEmpty():
                break
            hook = hook.select("id", "up")
        hook = hook.select("id", "up")
        to = hook.select(F.col("id").alias("component"), "up")
        label = cut_lineage(label.join(to, "component", "left").select(
            "id", F.coalesce("up", "component").alias("component")))
        ends = live
        for end in ("a", "b"):
            ends = ends.join(hook.select(F.col("id").alias(end), "up"), end, "left").withColumn(
                end, F.coalesce("up", end)).drop("up")
        live = cut_lineage(ends.filter("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    return label
