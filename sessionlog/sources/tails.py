"""Reading only what session files have gained since they were read last.

Files are listed by size and modification time (their content is not touched).  A file that is as it was
is not opened.  A file that has grown is read from the end of its last whole line on,
if the bytes before that place are those seen last time; else, or if it is shorter, from its start.  Files are
read in byte ranges dealt over all tasks, so one very long file does not go through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that one task reads at a time.
RANGE_BYTES = 64 << 20
#: Bytes before the place up to which a file was read, by which it is known again.
MARK_BYTES = 4096
#: Bytes of lines in a batch.
BATCH_BYTES = 4 << 20


def list_files(spark: SparkSession, root: str, glob: str = "*.jsonl", modified_after: str | None = None) -> DataFrame:
    """Session files below ``root``: uri, path (without scheme), size, modified."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    reader = reader.option("modifiedAfter", modified_after) if modified_after else reader
    return reader.load(root).filter("length > 0").select(
        F.col("path").alias("uri"), F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?(?=/)", "").alias("path"),
        F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))


def _opener():
    """Function that makes a function from a file's URI to a random-access file, on any store that Arrow knows.

    Inner functions travel to the executors by value; the package need not be there.
    """
    def make():
        from pyarrow import fs

        known = {}

        def open_file(uri: str):
            if ":" not in uri.split("/", 1)[0] or uri.startswith("file:"):
                return fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
            scheme = "/".join(uri.split("/", 3)[:3])
            place, path = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
            return known.setdefault(scheme, place).open_input_file(path)

        return open_file

    return make


def changed_files(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or not as they were, with the place to read them from.

    ``known`` has (path, size, modified, place, mark): the file up to ``place`` has been read, and ``mark``
    is a hash of the bytes before it.  Result: path, uri, size, modified, start, place, mark; ``start`` is
    0 or the old place, ``place`` and ``mark`` are the new ones.  Of a file only a few bytes are looked at.
    """
    seen = known.select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"),
                        F.col("place").alias("old_place"), F.col("mark").alias("old_mark"))
    work = listed.join(seen, "path", "left").filter(
        "old_size is null or old_size <> size or old_modified <> modified")
    mark_bytes, make_opener = MARK_BYTES, _opener()

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file = make_opener()

        def mark(file, at):
            file.seek(max(0, at - mark_bytes))
            return hashlib.blake2b(file.read(min(at, mark_bytes)), digest_size=16).hexdigest()

        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                with open_file(r["uri"]) as file:
                    old = r["old_place"] or 0
                    same = old and r["size"] >= max(old, r["old_size"]) and mark(file, old) == r["old_mark"]
                    r["start"] = old if same else 0
                    at, place = r["size"], r["start"]
                    while at > r["start"]:  # the last line end
                        low = max(r["start"], at - (1 << 20))
                        file.seek(low)
                        found = file.read(at - low).rfind(b"\n")
                        if found >= 0:
                            place = low + found + 1
                            break
                        at = low
                    r["place"], r["mark"] = place, mark(file, place)
            if rows:
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in shape.names} for r in rows], schema=shape)

    shape = pa.schema([("path", pa.string()), ("uri", pa.string()), ("size", pa.int64()), ("modified", pa.int64()),
                       ("start", pa.int64()), ("place", pa.int64()), ("mark", pa.string())])
    ask = work.select("path", "uri", "size", "modified", "old_size", "old_place", "old_mark")
    return ask.mapInArrow(inspect, "path string, uri string, size long, modified long, start long, place long, mark string")


def read_tails(work: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of files from their ``start`` on: path, line (its byte offset), value.

    ``work`` has (path, uri, size, start).  A line belongs to the range that holds its first byte.  What a
    file gains after it was listed is left for the next time.
    """
    cut = F.sequence(F.col("start"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    ranges = work.filter("start < size").select("path", "uri", "size", "start", F.explode(cut).alias("low"))
    batch_bytes, make_opener = BATCH_BYTES, _opener()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file = make_opener()

        def lines_of(file, size, start, low):
            """(offset, line) of the lines whose first byte is in the range."""
            high = min(size, low + range_bytes)
            at = low
            if low > start:  # the line that holds the byte before is another range's
                at = low - 1
                file.seek(at)
                rest = b""
                while True:
                    got = file.read(min(1 << 20, size - at - len(rest)))
                    found = got.find(b"\n")
                    if found >= 0 or not got:
                        at = at + len(rest) + (found + 1 if got else 0)
                        break
                    rest += got
                if not got:
                    return
            file.seek(at)
            begin, pieces = at, []
            while begin < high:
                got = file.read(min(1 << 20, size - at))
                if not got:
                    if pieces:
                        yield begin, b"".join(pieces)
                    return
                at += len(got)
                *whole, last = got.split(b"\n")
                for x in whole:
                    pieces.append(x)
                    line = b"".join(pieces)
                    yield begin, line
                    begin, pieces = begin + len(line) + 1, []
                    if begin >= high:
                        return
                if last:
                    pieces.append(last)

        def out(rows):
            path, at, text = zip(*rows)
            text = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in text]
            return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(at, pa.int64()), pa.array(text, pa.string())],
                                              names=["path", "line", "value"])

        for batch in batches:
            rows, held = [], 0
            for r in batch.to_pylist():
                with open_file(r["uri"]) as file:
                    for at, line in lines_of(file, r["size"], r["start"], r["low"]):
                        rows.append((r["path"], at, line))
                        held += len(line)
                        if held > batch_bytes:
                            yield out(rows)
                            rows, held = [], 0
            if rows:
                yield out(rows)

    # Ranges are few and small rows, but the work of each is large: one shuffle of the list spreads them.
    spread = ranges.repartition(ranges.sparkSession.sparkContext.defaultParallelism * 2, "path", "low")
    return spread.mapInArrow(run, "path string, line long, value string")
