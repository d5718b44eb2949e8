"""Indexes for scale: block-max pruning, additions and deletions, approximate vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.operators import ann
from triagelake.operators import retrieval as rt
from triagelake.operators.pruned import build_block_index, pruned_top
from triagelake.operators.segments import SegmentIndex
from triagelake.queries import sql
from triagelake.queries.registry import ORACLES, query
from triagelake.queries.search_queries import _index, _r
from triagelake.queries.tables import search_docs, search_queries, table
from triagelake.session import scratch_path

HEAD = 10

# --- block-max pruning -------------------------------------------------------


@query("bm4_pruned", f"SELECT query_id, doc_id, {sql.rounded('bm25_score')} AS score, bm25_rank AS rank "
                     f"FROM t_search_ranked WHERE bm25_rank <= {HEAD}")
def bm4_pruned(spark, sf):
    """The head of the full lexical ranking, without scoring most of it."""
    index = build_block_index(_index(spark, sf))
    return pruned_top(search_queries(spark, sf), index, HEAD).select(
        "query_id", "doc_id", _r(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


# --- additions, deletions, compaction ---------------------------------------


def _segments(spark, sf) -> SegmentIndex:
    """All documents, added source by source letter, some taken out and put back."""
    docs = search_docs(spark, sf)
    index = SegmentIndex(spark, scratch_path(spark, "segments"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    for k in range(3):
        index.append(docs.filter(part == k))
    again = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    index.delete(again)
    index.append(again)
    index.compact()
    index.delete(docs.filter(part == 0))
    index.append(docs.filter(part == 0))
    return index


@query("bm2_segments", ORACLES["bm2"])
def bm2_segments(spark, sf):
    """Term weights of an index that grew, shrank and was compacted."""
    return _segments(spark, sf).open_index().terms.select("term", "df", _r(F.col("idf")).alias("idf"))


@query("rrf2_segments", ORACLES["rrf2"])
def rrf2_segments(spark, sf):
    """Fused results over such an index."""
    found = rt.retrieve(search_queries(spark, sf), _segments(spark, sf).open_index())
    return found.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id",
        _r(F.col("bm25_score")).alias("bm25_score"), _r(F.col("dense_score")).alias("dense_score"),
        _r(F.col("rrf_score"), 9).alias("rrf_score"),
    )


# --- approximate vectors -----------------------------------------------------

RERANK = 200  # scored exactly, of what the codes put first


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


sql.cte("t_vector_asked", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0")
sql.cte(
    "t_vector_ranked",
    "SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.v, d.v) / "
    "(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))), 9) AS score, "
    "row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, d.v) / "
    "(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))), 9) DESC, d.vec_id DESC) AS rank "
    "FROM t_vector_asked q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) d",
)


@query("vec3_cells", f"SELECT query_id, doc_id, {sql.rounded('score')} AS score, rank "
                     f"FROM t_vector_ranked WHERE rank <= {HEAD}")
def vec3_cells(spark, sf):
    """Every hundredth vector against all of them, probing every cell: the full ranking's head."""
    vectors = _vectors(spark, sf)
    index = ann.build_vector_index(vectors)
    asked = vectors.filter(F.col("doc_id") % 100 == 0)
    return ann.nearest_documents(asked, index, HEAD, index.cells).select(
        "query_id", "doc_id", _r(F.col("score")).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


@query("vec3_recall", f"SELECT count(*) AS wanted, true AS enough FROM t_vector_ranked WHERE rank <= {HEAD}")
def vec3_recall(spark, sf):
    """How much of those heads a few cells and codes give: nine tenths or more."""
    vectors = _vectors(spark, sf)
    index = ann.build_vector_index(vectors)
    asked = vectors.filter(F.col("doc_id") % 100 == 0)
    every = ann.nearest_documents(asked, index, HEAD, index.cells).select("query_id", "doc_id")
    sample = vectors.orderBy(F.xxhash64(F.lit(3), "doc_id")).limit(100)
    some = ann.nearest_documents(asked, index, HEAD, ann.probes_for(sample, index, HEAD), RERANK).select(
        "query_id", "doc_id", F.lit(1).alias("hit")
    )
    met = every.join(some, ["query_id", "doc_id"], "left")
    return met.agg(
        F.count(F.lit(1)).alias("wanted"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough")
    )
