"""The whole run: session files, two loads, all signals, two named queries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlog.functions.scratch import scratch_path
from sessionlog.plans import queries as named
from sessionlog.plans.pipeline import derive, ingest
from sessionlog.sources.store import SessionStore

from .frames import SIGNATURES, Frames

#: Lines of a session that the first load finds; the second finds all.
FIRST_LINES = 40


def write_files(lines: DataFrame, root: str) -> int:
    """Lines (path, block, line, value) as files below ``root``; the number of files.

    Lines are dealt by path and sorted, so each task writes one file after the other.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        place, top = fs.FileSystem.from_uri(root)
        open_path, out, n = None, None, 0
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if path != open_path:
                    if out is not None:
                        out.close()
                    place.create_dir((top + path).rpartition("/")[0], recursive=True)
                    open_path, out, n = path, place.open_output_stream(top + path), n + 1
                out.write(value.encode() + b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": [n]})

    rows = lines.repartition("path").sortWithinPartitions("path", "block", "line").select("path", "value")
    return rows.mapInArrow(run, "files long").agg(F.sum("files")).first()[0]


def run(f: Frames) -> SessionStore:
    """Some sessions whole and some from their start, loaded; then all, loaded again; then the signals."""
    root = scratch_path(f.spark)
    store = SessionStore(f.spark, scratch_path(f.spark))
    number = F.regexp_extract("path", r"u(\d+)\.jsonl$", 1).cast("int")
    known = f.lines.filter((number % 3 == 0) | (number % 3 == 1) & (F.col("line") < FIRST_LINES * 8))
    write_files(known, root)
    ingest(f.spark, root, store)
    write_files(f.lines, root)
    ingest(f.spark, root, store)
    derive(store, SIGNATURES)
    return store


def headline(f: Frames) -> None:
    """What a user of the whole run waits for."""
    store = run(f)
    named.top_bloat(store.signal("signal_bloat")).collect()
    named.recurring(store.signal("signal_recurring_sequences")).collect()
