"""The pipeline's stages take effect, and the registered SQL agrees."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from checks.compare import normal
from sessionlog.llm.common import cut_lineage
from sessionlog.llm.oracle import ORACLE
from sessionlog.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(cut_lineage(stage(spark, docs[-1], SF)))
    return docs


def test_columns_stay_until_the_last(staged):
    assert all(d.dtypes == staged[0].dtypes for d in staged[:-1])


def test_each_stage_takes_effect(spark, staged):
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in staged]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in labels.filter("quality = 1 and toxic = 0").collect()} & ids[0]
    assert len(good & ids[1]) > 0.9 * len(good)
    assert len(ids[1]) < len(ids[0]) and ids[3] == ids[2]
    assert staged[5].count() == staged[4].count()


CLASHES = ["id", "tk", "copy", "copies", "kept", "spans", "n_spans", "whole", "component_id", "n_shingles", "first",
           "log_weight", "n_removed", "size", "taken", "key", "ids", "n_tokens"]


def test_edge_rows(spark, docs):
    """Nulls, empty and repeated rows go through all stages, and other columns keep their values."""
    names = [*corpus_pipeline._COLUMNS, *CLASHES]
    # What an extra column holds follows from the row, so it can be told whether it was changed.
    rows = [(*r, *[f"{c} {r.doc_id}" for c in CLASHES])
            for r in docs.select(*corpus_pipeline._COLUMNS).collect()]
    plain = spark.createDataFrame(rows, ", ".join(
        [*(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*corpus_pipeline._COLUMNS).schema), *(f"`{c}` string" for c in CLASHES)]))
    assert plain.columns == names
    left = plain
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in left.select("doc_id").collect()}
        left = cut_lineage(stage(spark, left, SF))
        assert left.columns == names
        got = left.collect()
        assert got and {r.doc_id for r in got} <= before
        assert all(r[c] == f"{c} {r.doc_id}" for r in got for c in CLASHES)
    ids = stage_ids = corpus_pipeline.STAGES[-1][1](spark, left, SF).collect()
    assert len(ids) == left.count() and stage_ids[0].asDict().keys() == {"doc_id", "source", "n_tokens", "ids"}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), SF).count() == 0


def test_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(60))
    near, other = text + " end", " ".join(f"thing{i}" for i in range(60))
    rows = [(5, text), (3, near), (3, text), (None, near), (9, other), (None, other), (None, "only null ids here at all"),
            (None, "only null ids here at all"), (7, None), (7, ""), (8, "  "), (8, "  "), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got if r.doc_id in (3, 5, 9) or r.text == "only null ids here at all") in [
        sorted([("3", t), ("9", other), ("None", "only null ids here at all")]) for t in (text, near)]
    assert sorted(str(r.doc_id) for r in got if not (r.text or "").strip()) == ["7", "7", "8", "None"]
    assert len(got) == 7


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), columns)


# Queries that SQL cannot express, and their tests by plain loops, round trips or held-out accuracy.
TESTED = {
    "op1_importance_resampling": "test_filters.test_rejected_of_held_out_labels", "op2_pivot_index": "test_duplicates.test_near_duplicates",
    "op3_cube_mixing": "test_filters.test_mix", "op5_arrow_sequences": "test_tokens.test_sequence_files",
    "op6_rank_array_bpe": "test_tokens.test_digests", "op7_kneser_ney": "test_knlm.test_scores",
    "op8_divide_skip_join": "test_duplicates.test_classes", "op9_piece_counts": "test_tokens.test_piece_counts",
    "op10_radix_repeats": "test_duplicates.test_repeats", "op13_wrapper_induction": "test_wrapper.test_layouts",
}


def test_every_query_is_tested():
    assert set(QUERIES) == set(ORACLE) | set(TESTED)
    for place in TESTED.values():
        module, name = place.split(".")
        assert f"def {name}(" in (Path(__file__).parent / f"{module}.py").read_text()


def test_replacement_characters_of_the_source_stay(spark):
    passage = "".join(chr(0x4E00 + i) for i in range(100))
    rows = [(1, f"own \ufffd word é{passage}", "a", 0), (2, f"other è{passage} end", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeats(spark, docs, "").collect()}
    assert got == {1: "own \ufffd word é", 2: "other è end"}
