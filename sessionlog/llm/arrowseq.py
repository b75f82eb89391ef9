"""Token ids in Arrow stream files of equal-length sequences, and random access to them.

A written set is a folder with one pair of files per partition of the documents:

* ``part-….arrow``: record batches of ``batch_rows`` rows with ``ids``
  (fixed-size list of unsigned 16- or 32-bit integers) and ``mask`` (fixed-size list of
  bool).  A row is one sequence; documents follow each other and run on into the next row.
  Only a file's last sequence is padded, with id 0 and mask false.
* ``part-….docs.arrow``: ``doc_id``, ``start`` (ids before it in this file) and ``n_tokens``.

and of a manifest table that names the files of the task attempts that counted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import library_encoder
from .common import chunks, cut_lineage, filesystem

MANIFEST = "part int, ids_file string, docs_file string, n_docs long, n_ids long, n_sequences long"

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Writer:
    """Appends ids to a file of equal-length sequences, a bounded number of rows at a time."""

    def __init__(self, fs, path: str, length: int, batch_rows: int, dtype):
        self.length, self.rows, self.dtype = length, batch_rows, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = fs.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_sequences = 0

    def _put(self, ids: np.ndarray, valid: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:valid] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.n_sequences += len(ids) // self.length

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        full = self.length * self.rows
        if self.n_held >= full:
            flat = np.concatenate(self.held)
            whole = len(flat) // full * full
            for i in range(0, whole, full):
                self._put(flat[i:i + full], full)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[:len(flat)] = flat
            self._put(padded, len(flat))
        self.out.close()
        self.sink.close()


class SequenceFile:
    """Random access to the sequences and ids of one file; no copy where it can be mapped."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view on the file) and mask of sequence ``i``."""
        batch = self.file.get_batch(i // self.rows)
        at = i % self.rows * self.length
        ids, mask = (batch.column(c).values[at:at + self.length] for c in ("ids", "mask"))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` of the file's stream on."""
        per, out, left = self.rows * self.length, [], n
        while left > 0:
            flat = self.file.get_batch(start // per).column("ids").values
            part = flat[start % per:start % per + left].to_numpy()
            out.append(part)
            start, left = start + len(part), left - len(part)
        return np.concatenate(out) if len(out) != 1 else out[0]


def write_sequences(docs: DataFrame, path: str, folder: str, length: int = 2048, batch_rows: int = 64,
                    end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode whole texts, an end id after each, and write them in ascending doc_id order.

    ``path`` is the tokenizer file, ``folder`` one that all executors share.  Returns the
    manifest, a written table with one row per file, in order of ``part``.  Documents are
    dealt by ranges of doc_id and sorted inside them, so files hold ascending ranges; null
    ids come first, equal ids in order of their texts.  Null and empty texts are their end
    id alone; an empty table gives an empty manifest.  A task that is run again writes new
    files, and the manifest names those of the attempt that succeeded.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder = library_encoder(path)
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        writer = index = index_sink = None
        n_docs = 0
        for batch in batches:
            for part in chunks(batch):
                if writer is None:
                    width = np.uint16 if max(encoder.top, end_id) < 1 << 16 else np.uint32
                    writer = _Writer(fs, f"{top}/{name}.arrow", length, batch_rows, width)
                    index_sink = fs.open_output_stream(f"{top}/{name}.docs.arrow")
                    index = pa.ipc.new_file(index_sink, INDEX)
                starts, counts = [], []
                for ids in encoder.encode(part.column("text").to_pylist()):
                    ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                    starts.append(writer.n_ids)
                    counts.append(len(ids))
                    writer.append(ids)
                index.write_batch(pa.record_batch(
                    [part.column("doc_id").cast(pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(counts, pa.int64())], schema=INDEX))
                n_docs += part.num_rows
        if writer is None:
            return
        writer.close()
        index.close()
        index_sink.close()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([task.partitionId()], pa.int32()),
            "ids_file": [f"{folder}/{name}.arrow"], "docs_file": [f"{folder}/{name}.docs.arrow"],
            "n_docs": [n_docs], "n_ids": [writer.n_ids], "n_sequences": [writer.n_sequences]})

    rows = docs.select("doc_id", "text")
    ranged = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    return cut_lineage(ranged.sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Documents back from the files: doc_id, start (ids before it in the set), n_tokens, ids_crc32.

    One task per few files; a document's ids are read by its place in the file.  The running
    total over files is taken over the manifest alone, one row per file.
    """
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", "ids_file", "docs_file", before.alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids_file = SequenceFile(row["ids_file"])
                fs, path = filesystem(row["docs_file"])
                with fs.open_input_file(path) as source:
                    index = pa.ipc.open_file(source)
                    for b in range(index.num_record_batches):
                        docs = index.get_batch(b)
                        starts, counts = (docs.column(c).to_pylist() for c in ("start", "n_tokens"))
                        crc = [zlib.crc32(ids_file.ids(s, n).astype("<u4").tobytes())
                               for s, n in zip(starts, counts, strict=True)]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": docs.column("doc_id"), "start": pa.array([s + row["base"] for s in starts], pa.int64()),
                            "n_tokens": docs.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})

    spread = files.repartition(max(1, manifest.count()), "part")  # AQE would put many files into one task
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
