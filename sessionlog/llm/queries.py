"""Queries of this subpackage's operators over the given tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arrowseq, bpe, cube, dic, hostrules, jaccard, knlm, pivots, repeats, resample, wordpiece, wrapper, zfast
from .common import load, shared_uri

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster it is installed or given with ``--py-files``; a path that is not there does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH")]))


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        find_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.quality_filter(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@_query
def op2_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(load(spark, sf_dir, "embeddings"))


@_query
def op3_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.mix(load(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@_query
def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.host_verdicts(load(spark, sf_dir, "documents"))


@_query
def op5_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = arrowseq.write_sequences(load(spark, sf_dir, "documents"), vocabulary_path(), shared_uri(spark))
    return arrowseq.read_documents(manifest)


@_query
def op6_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(load(spark, sf_dir, "documents"), vocabulary_path())


@_query
def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knlm.train_and_score(load(spark, sf_dir, "documents"), shared_uri(spark)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op8_divide_skip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(load(spark, sf_dir, "documents"))


@_query
def op9_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(load(spark, sf_dir, "documents"), vocabulary_path())


@_query
def op10_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op12_zfast_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = zfast.numbered_turns(load(spark, sf_dir, "conversations"))
    return zfast.prefix_tree(zfast.rebuilt(turns))


@_query
def op11_dic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.collocations(load(spark, sf_dir, "documents"))


@_query
def op13_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(load(spark, sf_dir, "pages"))
