"""Registered queries of the subpackage on the smallest tables, and the pipeline."""

from __future__ import annotations

import os
from collections import Counter

import corpus_pipeline
import pytest
from compare import TABLES, connect, differences
from odd_tables import COLUMNS, ROWS, empty, odd, prose

from triagelake.llm import queries

SF_DIR = os.path.join(TABLES, os.environ.get("TEST_SF", "sf0.001"))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
#: Result columns that the contracts name.
COLUMNS_OF = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_mixing": "doc_id size source_size target taken",
    "op3_jaccard_join": "doc_id class_id n_links copy_id",
    "op4_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_quality_classifier": "doc_id log_weight kept",
    "op10_token_output": "doc_id start n_tokens ids_crc32",
    "op11_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op12_resampling": "doc_id n_features weight score rank",
    "op13_license_scans": "doc_id n_words n_base first_word last_word base_labels labels score",
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, name):
    found = differences(spark, connect(SF_DIR), queries.QUERIES[name], queries.ORACLES[name], SF_DIR)
    assert found is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole_table_and_columns(spark, name):
    rows = queries.QUERIES[name](spark, SF_DIR)
    names = COLUMNS_OF[name].split()
    assert rows.columns[: len(names)] == names or set(names) <= set(rows.columns)
    if name not in ("op6_chat_format", "op11_conversation_repair"):
        ids = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
        assert {r.doc_id for r in rows.select("doc_id").collect()} == ids


def test_held_out_accuracy(spark):
    rows = queries.QUERIES["op7_language_id"](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    right = [r.lang == r.lang_pred for r in rows.join(docs, "doc_id").filter("held_out").collect()]
    assert len(right) > 20 and sum(right) >= 0.97 * len(right)


def test_pipeline_runs_its_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "language_id", "jaccard_join", "mixing", "packing"
    ]
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.count() > 0 and "sequence_id" in rows.columns


def test_stages_on_odd_rows(spark):
    clean = [(50 + k, prose(60, 50 + k), "en", "abc"[k % 3]) for k in range(30)]
    docs = spark.createDataFrame(ROWS + clean, COLUMNS).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        if name != "mixing":
            assert not Counter(map(tuple, rows)) - Counter(map(tuple, docs.collect())), name
    assert corpus_pipeline.packing(spark, docs, SF_DIR).count() >= len(ROWS)


def test_stages_on_an_empty_table_and_clashing_names(spark):
    none, clashing = empty(spark), odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, none, SF_DIR)
        assert rows.columns == none.columns and rows.count() == 0, name
        rows = stage(spark, clashing, SF_DIR)
        assert rows.columns == clashing.columns and rows.count() <= 3 * len(ROWS), name
    assert corpus_pipeline.packing(spark, none, SF_DIR).count() == 0
    assert corpus_pipeline.packing(spark, clashing, SF_DIR).count() >= len(ROWS)
