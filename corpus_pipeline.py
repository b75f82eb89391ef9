"""The corpus pipeline: quality, near duplicates, repeated passages, mixture, token ids."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlog.functions.joins import BROADCAST_ROWS
from sessionlog.llm import bpe, cube, jaccard, repeats, resample
from sessionlog.llm.common import cut_lineage, load, with_row_key
from sessionlog.llm.queries import find_package, vocabulary_path

_KEY = ["id", "tk"]
_NO_ID = -(1 << 63)

#: The columns of documents; others are carried under names of their own while a stage works.
_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _carrying(stage):
    """The stage, with other columns of ``docs`` renamed while it works: none can clash with its own names."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in _COLUMNS]
        safe = {c: f"_carried_{i}" for i, c in enumerate(others)}
        out = stage(spark, docs.withColumnsRenamed(safe), sf_dir)
        return out.withColumnsRenamed({s: c for c, s in safe.items() if s in out.columns})

    return run

#: SQL has no hashed n-gram classifier, cube sampling or byte-pair merges.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows with a key of ``gone``; their order of columns stays."""
    gone = cut_lineage(gone.select(*_KEY).distinct())
    few = gone.count() <= BROADCAST_ROWS
    return with_row_key(docs).join(F.broadcast(gone) if few else gone, _KEY, "left_anti").select(*docs.columns)


@_carrying
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws."""
    judged = resample.quality_filter(with_row_key(docs), load(spark, sf_dir, "labels"), carry=_KEY)
    return _without(docs, judged.filter("not kept"))


@_carrying
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one document: that with the smallest id, then text hash.

    Of rows with the same id and text one stays.  A group in which no row has an id is known by its texts
    only: of equal texts one stays.
    """
    found = cut_lineage(jaccard.classes(with_row_key(docs), 5, 80, carry=_KEY).filter("n_shingles > 0").select(
        *_KEY, "component_id"))
    first = found.filter("component_id is not null").groupBy("component_id").agg(
        F.min(F.struct(F.when(F.col("id") > _NO_ID, F.col("id")).isNull().alias("no_id"), "id", "tk")).alias("first"))
    gone = found.join(first, "component_id").filter("not (id = first.id and tk = first.tk)")
    rows = _without(docs, gone)
    again = with_row_key(rows).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if again.isEmpty():
        return rows
    twice = with_row_key(rows).join(again, _KEY, "left_semi").dropDuplicates(_KEY).select(*docs.columns)
    return _without(rows, again).unionByName(twice)


@_carrying
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less every 200-byte string found twice; characters cut in half go, and n_chars follows.

    A document of which nothing is left stays, with an empty text.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    left = repeats.drop_repeats(docs, keep_text=True, carry=[*others, "n_chars"], whole_characters=True)
    text = F.col("kept").cast("string")
    return left.withColumns({
        "text": text, "n_chars": F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(
            F.length(text)).cast(docs.schema["n_chars"].dataType)}).select(*docs.columns)


@_carrying
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mixture of sources takes."""
    taken = cube.mix(with_row_key(docs), carry=_KEY).filter("copies > 0").select(*_KEY, "copies")
    # Equal rows are drawn one by one: their copies are added up, and each of them brings its share.
    taken = taken.groupBy(*_KEY).agg(F.sum("copies").alias("copies"))
    rows = with_row_key(docs).join(taken, _KEY)
    one = rows.dropDuplicates(_KEY)
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


@_carrying
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text: doc_id, source, n_tokens, ids."""
    return bpe.encode(docs, vocabulary_path(), carry=["source"])


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    find_package(spark)
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
