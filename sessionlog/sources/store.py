"""The stored tables: Parquet in pieces, one folder for each version of a piece.

A piece of a table is a day on which sessions started, or one of ``buckets`` parts of it.  A change writes
the touched pieces as new folders beside the old ones, then the list of the folders that are
now in use (``live``), then one row in ``pointer``.  Readers take the last row there, so they see the old version
until that row is written, and a change that broke off leaves nothing but folders
that no list names.  Nothing is overwritten; :meth:`SessionStore.unused` finds what may be deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..operators.incremental import replace_sessions
from ..schemas import BASE_TABLES, FILES, MANIFEST, PARTS, PAYLOADS, SIGNALS, columns_of

DAY, BUCKET, VERSION = "day", "bucket", "version"
_PIECE = [DAY, BUCKET]
_LIVE = "name string, day string, bucket int, version string"
_POINTER = "n bigint, version string"
#: Tables that are written as a whole.
_WHOLE = {"manifest": MANIFEST, "files": FILES}


def day_of(started_at: Column) -> Column:
    """Day of a session: the date part of its start, ``none`` if it has no time."""
    day = F.regexp_extract(started_at, r"^\d{4}-\d{2}-\d{2}", 0)
    return F.coalesce(F.nullif(day, F.lit("")), F.lit("none"))


def few_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows as one partition made in the JVM."""
    shape = StructType.fromDDL(ddl)
    text = json.dumps([dict(zip(shape.names, r)) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), ArrayType(shape))))


class SessionStore:
    """Base tables, payloads, manifest and signals below one folder.

    ``buckets`` cuts each day by a hash of the session, so that a change rewrites less of a large day.  It
    is fixed with the first write of a store.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 1):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._pinned: tuple[int, str | None] | None = None
        self._listed: tuple[str, list[Row]] | None = None

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # -- versions -----------------------------------------------------------

    def _parquet(self, ddl: str, *paths: str, base: str | None = None) -> DataFrame:
        """Files with a given schema; no rows if there are none."""
        reader = self.spark.read.schema(ddl)
        try:
            return (reader.option("basePath", base) if base else reader).parquet(*paths)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return few_rows(self.spark, [], ddl)

    def version(self) -> tuple[int, str | None]:
        """Number and name of the version that readers see now; (0, None) before the first one."""
        if self._pinned is not None:
            return self._pinned
        last = self._parquet(_POINTER, self.path("pointer")).agg(F.max(F.struct("n", VERSION)).alias("p")).first().p
        return (last.n, last.version) if last else (0, None)

    def snapshot(self) -> SessionStore:
        """The store as it is now: all tables read from it are of one version."""
        fixed = SessionStore(self.spark, self.root, self.buckets)
        fixed._pinned = self.version()
        return fixed

    def live(self) -> list[Row]:
        """(name, day, bucket, version): the folders in use, one short row each."""
        _, version = self.version()
        if version is None:
            return []
        if self._listed is None or self._listed[0] != version:
            self._listed = version, self._parquet(_LIVE, f"{self.path('live')}/{version}").collect()
        return self._listed[1]

    def _commit(self, version: str, replaced: list[tuple]) -> None:
        """Make ``replaced`` (name, day, bucket), written under ``version``, the pieces in use."""
        n, old = self.version()
        gone = set(replaced)
        rows = [tuple(r) for r in self.live() if (r.name, r.day, r.bucket) not in gone]
        rows += [(*r, version) for r in replaced]
        few_rows(self.spark, rows, _LIVE).write.parquet(f"{self.path('live')}/{version}")
        few_rows(self.spark, [(n + 1, version)], _POINTER).write.mode("append").parquet(self.path("pointer"))

    def unused(self) -> list[str]:
        """Folders of older versions and of changes that broke off; for deletion when no reader needs them."""
        used = {f"{r.name}/{DAY}={r.day}/{BUCKET}={r.bucket}/{VERSION}={r.version}" for r in self.live()}
        _, now = self.version()
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
            "pathGlobFilter", "*.parquet").load(self.root)
        folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
        found = {r[0] for r in files.select(folder).distinct().collect()}  # one row a folder
        keep = lambda f: any(f.endswith("/" + u) for u in used) or f.endswith((f"/live/{now}", "/pointer")) or "/payloads/" in f
        return sorted(f for f in found if not keep(f))

    # -- reading ------------------------------------------------------------

    def pieces(self, name: str, wanted: Collection[tuple[str, int]] | None = None) -> DataFrame:
        """A table's rows with ``day`` and ``bucket``, of the ``wanted`` pieces only if given.

        Folders are read by name, so a filter on ``day`` prunes them.
        """
        columns = {**BASE_TABLES, **_WHOLE, **PARTS}.get(name) or columns_of(SIGNALS[name])
        ddl = ", ".join(f"`{c}` {t}" for c, t in columns.items()) + f", {DAY} string, {BUCKET} int, {VERSION} string"
        names = [r for r in self.live() if r.name == name and (wanted is None or (r.day, r.bucket) in wanted)]
        if not names:
            return few_rows(self.spark, [], ddl).drop(VERSION)
        base = self.path(name)
        paths = [f"{base}/{DAY}={r.day}/{BUCKET}={r.bucket}/{VERSION}={r.version}" for r in names]
        return self._parquet(ddl, *paths, base=base).drop(VERSION)

    def _rows(self, name: str, wanted: Collection[tuple[str, int]] | None = None) -> DataFrame:
        """Rows with a session; a row without one only marks a piece that may have lost all its rows."""
        return self.pieces(name, wanted).filter(F.col("session_id").isNotNull())

    @staticmethod
    def places(rows: DataFrame) -> set[tuple[str, int]]:
        """The pieces that rows are in."""
        return {tuple(r) for r in rows.select(*_PIECE).distinct().collect()}

    def table(self, name: str) -> DataFrame:
        """A base table."""
        return self._rows(name).drop(*_PIECE)

    def of_session(self, session_id: str, with_subagents: bool = False) -> dict[str, DataFrame]:
        """The base tables of a session (and of its children), read from its pieces only."""
        mine = F.col("session_id") == session_id
        if with_subagents:
            mine = mine | (F.col("parent_session_id") == session_id)
        now = self.snapshot()
        pieces = now.places(now.pieces("sessions").filter(mine))
        return {name: now._rows(name, pieces).drop(*_PIECE) for name in BASE_TABLES if name != "lines"}

    def manifest(self) -> DataFrame:
        return self.pieces("manifest").drop(*_PIECE)

    def files(self) -> DataFrame:
        """Files by size, time, and the place up to which they are in ``lines``."""
        return self.pieces("files").drop(*_PIECE)

    def payloads(self) -> DataFrame:
        return self._parquet(", ".join(f"`{c}` {t}" for c, t in PAYLOADS.items()), self.path("payloads"))

    def signal(self, name: str) -> DataFrame:
        rows = self.pieces(name).drop(*_PIECE)
        first = rows.columns[0]
        return rows.filter(F.col(first).isNotNull())

    def tables(self) -> dict[str, DataFrame]:
        """All tables by name, of one version, as far as they are for reading by SQL; base tables with
        ``day``, by which they can be pruned."""
        now = self.snapshot()
        return {
            **{n: now._rows(n).drop(BUCKET) for n in BASE_TABLES if n != "lines"},
            **{n: now.signal(n) for n in SIGNALS},
        }

    # -- writing ------------------------------------------------------------

    def piece_of(self, day: Column, session_id: Column) -> list[Column]:
        return [day.alias(DAY), F.pmod(F.xxhash64(session_id), F.lit(self.buckets)).cast("int").alias(BUCKET)]

    def _write(self, name: str, df: DataFrame, version: str) -> None:
        """Pieces of a table as new folders."""
        by = [c for c in ("session_id", "path") if c in df.columns][:1]
        df = df.hint("rebalance", *_PIECE)  # whole pieces per file where small, several files where large
        df = df.sortWithinPartitions(*_PIECE, *by) if by else df
        writer = df.withColumn(VERSION, F.lit(version)).write.mode("append").partitionBy(*_PIECE, VERSION)
        if name == "sessions":  # looked up by id
            writer = writer.option("parquet.bloom.filter.enabled#session_id", "true").option(
                "parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(self.path(name))

    def _marked(self, df: DataFrame, pieces: Collection[tuple[str, int]]) -> DataFrame:
        """With a row of nulls for each piece, so that each has a folder."""
        marks = few_rows(self.spark, sorted(pieces), f"{DAY} string, {BUCKET} int")
        return df.unionByName(marks.select(
            *[(F.col(c) if c in _PIECE else F.lit(None).cast(t)).alias(c) for c, t in df.dtypes]))

    def new_version(self) -> str:
        return uuid.uuid4().hex

    def replace(self, new: dict[str, DataFrame], replaced: DataFrame, whole: dict[str, DataFrame] | None = None) -> None:
        """Replace all rows of the ``replaced`` sessions (session_id, day) by ``new`` ones, in one version.

        ``whole`` has tables to be written as a whole in the same version.  Only pieces that hold an old
        or a new version of such a session are rewritten.
        """
        version, now = self.new_version(), self.snapshot()
        old = now._rows("sessions").join(replaced.select("session_id"), "session_id", "left_semi")
        fresh = replaced.select(*self.piece_of(F.col(DAY), F.col("session_id")))
        pieces = self.places(old.select(*_PIECE).unionByName(fresh))
        for name, rows in new.items():
            existing = now._rows(name, pieces)
            rows = rows.withColumn(BUCKET, self.piece_of(F.col(DAY), F.col("session_id"))[1])
            merged = replace_sessions(existing, rows.select(*existing.columns), replaced)
            self._write(name, self._marked(merged, pieces), version)
        self._finish(list(new), pieces, whole or {}, version)

    def put_pieces(self, tables: dict[str, DataFrame], pieces: Collection[tuple[str, int]],
                   whole: dict[str, DataFrame] | None = None) -> None:
        """Write ``pieces`` of tables (rows with day and bucket) anew, in one version."""
        version = self.new_version()
        for name, rows in tables.items():
            self._write(name, self._marked(rows, pieces), version)
        self._finish(list(tables), pieces, whole or {}, version)

    def _finish(self, names: list[str], pieces: Collection[tuple[str, int]], whole: dict[str, DataFrame], version: str) -> None:
        for name, rows in whole.items():
            self._write_whole(name, rows, version)
        self._commit(version, [(n, *p) for n in names for p in sorted(pieces)] + [(n, "all", 0) for n in whole])

    def _write_whole(self, name: str, df: DataFrame, version: str) -> None:
        df.write.parquet(f"{self.path(name)}/{DAY}=all/{BUCKET}=0/{VERSION}={version}")

    def add_payloads(self, new: DataFrame) -> None:
        (
            new.hint("rebalance", "prefix").sortWithinPartitions("prefix", "hash").write.mode("append").partitionBy("prefix")
            # Readers skip row groups that cannot have a hash.
            .option("parquet.bloom.filter.enabled#hash", "true").option("parquet.bloom.filter.expected.ndv#hash", "100000")
            .parquet(self.path("payloads"))
        )

    def overwrite(self, name: str, df: DataFrame) -> None:
        """Write a table as a whole, as a new version."""
        self._finish([], (), {name: df}, self.new_version())
