"""Block-max, segment and vector indexes against rankings of everything."""

from __future__ import annotations

import os
import random

import pytest
from compare import TABLES
from pyspark.sql import functions as F
from test_retrieval import DOCS, frames

from triagelake.operators import ann, pruned
from triagelake.operators import retrieval as rt
from triagelake.operators.pruned import build_block_index, pruned_top, pruned_top_with_work
from triagelake.operators.segments import SegmentIndex
from triagelake.queries.tables import search_docs, search_queries
from triagelake.sources import versions

BIG = os.path.join(TABLES, "sf0.1")


# --- block-max pruning ---


@pytest.mark.parametrize("k", [1, 7, 250])
def test_pruned_head_is_the_ranking(spark, k):
    queries, docs = frames(spark)
    index = rt.build_index(docs, legs=(rt.LEXICAL,))
    got = pruned_top(queries, build_block_index(index, block_docs=4), k)
    want = rt.leading_documents(queries, index, k, (rt.LEXICAL,))

    def rows(frame):
        return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 7)) for r in frame.collect())

    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables")
def test_most_postings_are_not_read(spark):
    """At sf0.1, of the postings of the words of all queries."""
    index = build_block_index(rt.build_index(search_docs(spark, BIG), legs=(rt.LEXICAL,)))
    _, work = pruned_top_with_work(search_queries(spark, BIG), index, 10)
    read, all_ = work.agg(F.sum("decoded"), F.sum("postings")).first()
    print(f"{read} of {all_} postings read: {read / all_:.3f}")
    assert 0 < read < all_ / 3


def test_pruned_search_goes_through_pieces(spark, monkeypatch):
    """Every document is in one piece, inverted as a whole; pieces and buckets of queries change no row."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]

    def text():
        return " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 25)))

    texts = [text() for _ in range(150)]
    texts += texts[:60] * 3 + [texts[7]] * 70  # copies tie
    schema = "id bigint, text string"
    docs = rt.searchable(spark.createDataFrame(list(enumerate(texts)), schema), "id", "text")
    queries = rt.searchable(
        spark.createDataFrame([*((900 + i, text()) for i in range(30)), (999, "unknown")], schema), "id", "text"
    )
    index = rt.build_index(docs, legs=(rt.LEXICAL,))
    monkeypatch.setattr(pruned, "PIECE_POSTINGS", 300)
    monkeypatch.setattr(pruned, "MAX_ASKED", 40)
    blocks = build_block_index(index)
    placed = [d for r in blocks.blocks.select("doc_ids").collect() for d in r.doc_ids]
    assert sorted(placed) == [i for i, t in enumerate(texts) if t]
    assert 3 < blocks.blocks.count() <= index.n_postings / 300 + 1
    got, work = pruned_top_with_work(queries, blocks, 5)
    want = rt.leading_documents(queries, index, 5, (rt.LEXICAL,))

    def rows(frame):
        return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 7)) for r in frame.collect())

    assert rows(got) == rows(want)
    read = work.agg(F.sum("decoded"), F.sum("postings")).first()
    assert 0 < read[0] <= read[1]  # none is read twice


def test_pruned_on_an_empty_corpus(spark):
    queries, docs = frames(spark)
    index = rt.build_index(docs.filter("doc_id < 0"), legs=(rt.LEXICAL,))
    assert pruned_top(queries, build_block_index(index), 3).count() == 0


# --- segments ---


def _same(spark, index, docs, queries):
    opened, fresh = index.open_index(), rt.build_index(docs)
    for c in ("n_docs", "n_tokens", "n_postings", "vector_bytes"):
        assert getattr(opened, c) == getattr(fresh, c), c

    def terms(i):
        return {(r.term, r.df, round(r.idf, 9)) for r in i.terms.collect()}

    assert terms(opened) == terms(fresh)

    def hits(i):
        found = rt.retrieve(queries, i, resident="corpus")
        return {(r.query_id, r["rank"], r.doc_id, round(r.rrf_score, 9)) for r in found.collect()}

    assert hits(opened) == hits(fresh)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_changes_equals_a_fresh_build(spark, tmp_path, seed):
    rng = random.Random(seed)
    queries, docs = frames(spark, partitions=2)
    docs = docs.cache()
    index = SegmentIndex(spark, f"file://{tmp_path}/index")
    ids = [i for i, _ in DOCS]
    held: set[int] = set()
    for step in range(7):
        absent = [i for i in ids if i not in held]
        change = rng.choice(["append", "append", "delete", "compact"]) if held else "append"
        if change == "append" and absent:
            some = rng.sample(absent, min(len(absent), rng.randint(1, 70)))
            index.append(docs.filter(F.col("doc_id").isin(some)))
            held |= set(some)
        elif change == "delete" and held:
            some = rng.sample(sorted(held), rng.randint(1, len(held) // 2 + 1))
            index.delete(docs.filter(F.col("doc_id").isin([*some, -99])))
            held -= set(some)
        else:
            index.compact(rng.choice([None, 60]))
        if step % 2 or step == 6:
            _same(spark, index, docs.filter(F.col("doc_id").isin(sorted(held))), queries)


def test_changes_count_whole_or_not_at_all(spark, tmp_path):
    _, docs = frames(spark, partitions=2)
    index = SegmentIndex(spark, f"file://{tmp_path}/index")
    index.append(docs.filter("doc_id < 100"))
    with pytest.raises(ValueError):
        index.append(docs.filter("doc_id BETWEEN 90 AND 110"))  # some are there already
    assert index.documents().count() == 100
    version, state = index.state()
    with pytest.raises(versions.Conflict):  # another writer published first
        versions.publish(spark, index.path, version, state)
    assert index.state() == (version, state)
    # an addition reads nothing but its own rows: data of older segments is not written again
    before = {s["name"] for s in state["segments"]}
    index.append(docs.filter("doc_id >= 100"))
    after = index.state()[1]["segments"]
    assert before < {s["name"] for s in after} and len(after) == 2
    assert sum(s["n_docs"] for s in after) == len(DOCS)


# --- vectors ---


def test_all_cells_are_the_full_ranking(spark, tmp_path):
    queries, docs = frames(spark)
    index = ann.build_vector_index(docs.select("doc_id", "embedding"), f"file://{tmp_path}/v", cells=5, parts=3)
    got = ann.nearest_documents(queries.select("doc_id", "embedding"), index, 12, 5)
    want = rt.leading_documents(queries, rt.build_index(docs, legs=(rt.DENSE,)), 12, (rt.DENSE,))

    def rows(frame):
        return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in frame.collect())

    assert rows(got) == rows(want)
    again = ann.read_vector_index(spark, f"file://{tmp_path}/v")
    assert rows(ann.nearest_documents(queries.select("doc_id", "embedding"), again, 12, 5)) == rows(want)


def test_pieces_of_a_hot_cell(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "PIECE_ROWS", 7)
    monkeypatch.setattr(ann, "PIECE_QUERIES", 2)
    same = [(i, [1.0, 0.5, 0.0, 0.0]) for i in range(40)] + [(100 + i, [0.0, 0.0, 1.0, i / 9]) for i in range(20)]
    docs = spark.createDataFrame(same, "doc_id bigint, embedding array<float>")
    index = ann.build_vector_index(docs, f"file://{tmp_path}/v", cells=3, parts=2)
    got = ann.nearest_documents(docs, index, 3, 3).collect()
    assert len(got) == 3 * 60
    assert {r.doc_id for r in got if r.query_id < 40} == {37, 38, 39}


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables")
def test_recall_at_ten(spark):
    vectors = spark.read.parquet(f"{BIG}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    index = ann.build_vector_index(vectors)
    asked = vectors.filter(F.col("doc_id") % 100 == 0)
    every = ann.nearest_documents(asked, index, 10, index.cells).select("query_id", "doc_id")
    # other queries choose the cells
    probes = ann.probes_for(vectors.filter(F.col("doc_id") % 100 == 1), index)
    some = ann.nearest_documents(asked, index, 10, probes, 200).select("query_id", "doc_id")
    recall = every.join(some, ["query_id", "doc_id"]).count() / every.count()
    print(f"recall at 10: {recall:.4f}, {probes} of {index.cells} cells")
    assert recall >= 0.9


def test_empty_and_missing_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id bigint, embedding array<float>")
    index = ann.build_vector_index(none, f"file://{tmp_path}/a")
    assert ann.nearest_documents(none, index, 3, 1).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [1.0, 0.0])], "doc_id bigint, embedding array<float>")
    index = ann.build_vector_index(nulls, f"file://{tmp_path}/b")
    got = ann.nearest_documents(nulls, index, 2, 1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in got] == [(1, 2, 0.0), (1, 1, 0.0), (2, 2, 1.0), (2, 1, 0.0)]

