"""Tokens, corpus statistics, rankings, fusion, numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions.text import tokenize
from triagelake.operators import retrieval as rt
from triagelake.operators.ranking import number_within, top_per_group
from triagelake.queries import sql
from triagelake.queries.registry import query
from triagelake.queries.tables import (
    pairs, search_docs, search_queries, table,
)
from triagelake.session import spread



def _r(column, digits=6):
    """Rounded by the same arithmetic as ``sql.rounded``."""
    scale = F.lit(10.0**digits)
    return F.floor(column * scale + 0.5).cast("double") / scale


def _index(spark, sf, *legs):
    return rt.build_index(search_docs(spark, sf), legs=legs or (rt.LEXICAL,))


# --- tokens and statistics ---------------------------------------------------


@query("tok1", (f"SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 "
                 f"FROM (SELECT doc_id, {sql.tokens('text')} AS w FROM documents)"))
def tok1(spark, sf):
    docs = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", tokenize(F.col("text")).alias("w"))
    return docs.select(
        "doc_id", F.size("w").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("w", " ").cast("binary")).alias("tokens_md5"),
    )


@query("bm1", ("SELECT doc_id, max(dl) AS dl, count(*) AS n_terms, max(tf) AS max_tf "
                "FROM t_search_postings GROUP BY doc_id"))
def bm1(spark, sf):
    return rt.postings(_index(spark, sf).docs).groupBy("doc_id").agg(
        F.max("dl").alias("dl"), F.count(F.lit(1)).alias("n_terms"), F.max("tf").alias("max_tf")
    )


@query("agg10", (f"SELECT n_docs, n_tokens, {sql.rounded('avgdl')} AS avgdl, n_terms, n_postings, max_df "
                  "FROM t_search_size, (SELECT count(*) AS n_terms, max(df) AS max_df, "
                  "CAST(sum(df) AS BIGINT) AS n_postings FROM t_search_idf)"))
def agg10(spark, sf):
    index = _index(spark, sf)
    size = rt.corpus_size(index.docs).first()
    terms = index.terms.agg(F.count(F.lit(1)).alias("n_terms"), F.max("df").alias("max_df"))
    return terms.select(
        *[F.lit(size[c]).cast("bigint").alias(c) for c in ("n_docs", "n_tokens", "n_postings")],
        _r(F.lit(size["avgdl"])).alias("avgdl"), "n_terms", "max_df",
    )


@query("bm2", (f"SELECT term, df, {sql.rounded('idf')} AS idf FROM t_search_idf"))
def bm2(spark, sf):
    return _index(spark, sf).terms.select(
        "term", "df", _r(F.col("idf")).alias("idf")
    )


@query("jn2", (f"SELECT query_id, term, qtf, df, {sql.rounded('idf')} AS idf "
                "FROM t_search_asked JOIN t_search_idf USING (term)"))
def jn2(spark, sf):
    return rt.look_up_terms(search_queries(spark, sf), _index(spark, sf)).select(
        "query_id", "term", "qtf", "df", _r(F.col("idf")).alias("idf")
    )


# --- one ranking at a time ---------------------------------------------------


# How many leading documents these queries list; the totals beside them are over
# every document, so nothing of a ranking goes unread or uncounted.
MATCHES, RANKED, CANDIDATES = 50, 100, 200
_TOTALS = ("ranked", "matches", "score_sum")


def _leaders(spark, sf, keep, *legs):
    return rt.leading_documents(search_queries(spark, sf), _index(spark, sf, *legs), keep, legs)


def _leg_sql(leg):
    """A full ranking, with what the whole of it comes to beside every row."""
    score = {"lexical": "bm25", "dense": "dense"}[leg]
    return (f"SELECT query_id, '{leg}' AS leg, doc_id, {score}_score AS score, {score}_rank AS rank, "
            "count(*) OVER q AS ranked, "
            f"CAST(sum(CASE WHEN {score}_score <> 0 THEN 1 ELSE 0 END) OVER q AS BIGINT) AS matches, "
            f"CAST(sum(CAST(floor({score}_score * 1e6 + 0.5) AS BIGINT)) OVER q AS BIGINT) "
            "AS score_sum FROM t_search_ranked WINDOW q AS (PARTITION BY query_id)")


def _ranked(leg, keep, extra=""):
    return (f"SELECT query_id, doc_id, {sql.rounded('score')} AS score, rank, {', '.join(_TOTALS)} "
            f"FROM ({_leg_sql(leg)}) WHERE rank <= {keep} {extra}")


def _columns(leaders):
    return leaders.select(
        "query_id", "doc_id", _r(F.col("score")).alias("score"),
        F.col("rank").cast("bigint").alias("rank"), *_TOTALS,
    )


@query("bm3", _ranked("lexical", MATCHES, "AND score <> 0"))
def bm3(spark, sf):
    """The best matches per query; the totals count and add up all matches."""
    return _columns(_leaders(spark, sf, MATCHES, rt.LEXICAL).filter(F.col("score") != 0))


@query("bm4", _ranked("lexical", RANKED))
def bm4(spark, sf):
    """The head of the full ranking; documents without a match fill it up."""
    return _columns(_leaders(spark, sf, RANKED, rt.LEXICAL))


@query("vec3", _ranked("dense", RANKED))
def vec3(spark, sf):
    return _columns(_leaders(spark, sf, RANKED, rt.DENSE))


@query("jn1", " UNION ALL ".join(
    f"SELECT query_id, leg, doc_id, {sql.rounded('score')} AS score, {', '.join(_TOTALS)} "
    f"FROM ({_leg_sql(leg)}) WHERE rank = 1" for leg in ("lexical", "dense")))
def jn1(spark, sf):
    """All pairs of a query and a document, reduced per ranking: the best and the totals."""
    return _leaders(spark, sf, 1, rt.LEXICAL, rt.DENSE).select(
        "query_id", "leg", "doc_id", _r(F.col("score")).alias("score"), *_TOTALS
    )


@query("jn5", ("SELECT query_id, doc_id, bm25_rank, dense_rank FROM t_search_ranked "
                f"WHERE bm25_rank <= {CANDIDATES} OR dense_rank <= {CANDIDATES}"))
def jn5(spark, sf):
    """Both ranks of every candidate: a document among the first of either ranking."""
    index = _index(spark, sf, rt.LEXICAL, rt.DENSE)
    return rt.ranked_candidates(search_queries(spark, sf), index, CANDIDATES).select(
        "query_id", "doc_id", "bm25_rank", "dense_rank"
    )


# --- vectors -----------------------------------------------------------------

_UNIT = ("SELECT vec_id, label, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS u FROM "
         "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")


@query("src3", "SELECT vec_id AS doc_id, len(embedding) AS dims, "
               f"{sql.rounded('CAST(embedding[1] AS DOUBLE)')} AS first_value FROM embeddings")
def src3(spark, sf):
    from triagelake.sources.readers import load_vectors

    return load_vectors(spark, f"{sf}/embeddings.parquet", "vec_id").select(
        "doc_id", F.size("embedding").cast("bigint").alias("dims"),
        _r(F.element_at("embedding", 1).cast("double")).alias("first_value"),
    )


@query("vec1", f"SELECT vec_id, {sql.rounded('u[1]')} AS first_value, "
               f"{sql.rounded('u[len(u)]')} AS last_value, "
               f"{sql.rounded('list_dot_product(u, u)')} AS length FROM ({_UNIT})")
def vec1(spark, sf):
    units = table(spark, sf, "embeddings").select("vec_id", rt.unit(F.col("embedding")).alias("u"))
    return units.select(
        "vec_id", _r(F.element_at("u", 1)).alias("first_value"),
        _r(F.element_at("u", -1)).alias("last_value"),
        _r(rt.dot(F.col("u"), F.col("u"))).alias("length"),
    )


@query("vec2", f"SELECT a.vec_id, {sql.rounded('list_dot_product(a.u, b.u)')} AS cosine "
               f"FROM ({_UNIT}) a JOIN ({_UNIT}) b ON b.vec_id = a.vec_id + 1")
def vec2(spark, sf):
    """Cosine of each vector and the next."""
    units = table(spark, sf, "embeddings").select("vec_id", rt.unit(F.col("embedding")).alias("u"))
    following = units.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v"))
    return units.join(following, "vec_id").select(
        "vec_id", _r(rt.dot(F.col("u"), F.col("v"))).alias("cosine")
    )


@query("emb1", ("SELECT doc_id, md5(query_text || ' -> ' || resolution_text) AS text_md5 FROM t_pairs"))
def emb1(spark, sf):
    text = rt.embedding_text(F.col("query_text"), F.col("resolution_text"))
    return pairs(spark, sf).select("doc_id", F.md5(text.cast("binary")).alias("text_md5"))


# --- fusion ------------------------------------------------------------------


def _fused(k, columns):
    return (f"SELECT {columns} FROM t_search_fused WHERE rank <= {k}")


@query("rrf1", _fused(20, "query_id, doc_id, bm25_rank, dense_rank, " + sql.rounded("rrf_score", 9)
                      + " AS rrf_score"))
def rrf1(spark, sf):
    """Fused score and both full-corpus ranks of the first 20, queries resident."""
    found = rt.retrieve(
        search_queries(spark, sf), search_docs(spark, sf), k=20, resident="queries"
    )
    return found.select(
        "query_id", "doc_id", "bm25_rank", "dense_rank", _r(F.col("rrf_score"), 9).alias("rrf_score")
    )


_RRF2 = (f"query_id, rank, doc_id, {sql.rounded('bm25_score')} AS bm25_score, "
         f"{sql.rounded('dense_score')} AS dense_score, {sql.rounded('rrf_score', 9)} AS rrf_score")


def _top(spark, sf, **options):
    return rt.retrieve(search_queries(spark, sf), search_docs(spark, sf), **options).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id",
        _r(F.col("bm25_score")).alias("bm25_score"), _r(F.col("dense_score")).alias("dense_score"),
        _r(F.col("rrf_score"), 9).alias("rrf_score"),
    )


@query("rrf2", _fused(3, _RRF2))
def rrf2(spark, sf):
    return _top(spark, sf)


@query("rrf2_corpus", _fused(3, _RRF2))
def rrf2_corpus(spark, sf):
    """The same with the corpus resident."""
    return _top(spark, sf, resident="corpus")


@query("jn4", ("SELECT query_id, rank, doc_id, lang, source, n_chars FROM t_search_fused "
                "JOIN documents USING (doc_id) WHERE rank <= 3"))
def jn4(spark, sf):
    attributes = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return _top(spark, sf).select("query_id", "rank", "doc_id").join(attributes, "doc_id")


@query("src4", "SELECT count(*) AS n_queries, (SELECT count(*) FROM documents d "
               "ANTI JOIN documents e ON e.doc_id = d.doc_id) AS n_hits FROM benchmark")
def src4(spark, sf):
    """A corpus that turns out empty, as every document is left out, gives no hits."""
    queries, every = search_queries(spark, sf), search_docs(spark, sf)
    docs = every.join(every.select("doc_id"), "doc_id", "left_anti")
    hits = rt.retrieve(queries, docs).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.select(F.col("doc_id").alias("query_id")).join(hits, "query_id", "left").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_hits"),
    )


# --- numbering ---------------------------------------------------------------

def _by_size():
    return [F.col("n_chars").desc(), F.col("doc_id").desc()]


@query("win1", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang "
               "ORDER BY n_chars DESC, doc_id DESC) AS rank FROM documents")
def win1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return number_within(docs, ["lang"], _by_size(), "rank").drop("n_chars")


@query("srt1", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) AS place "
               "FROM documents")
def srt1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return number_within(docs, [], _by_size(), "place").drop("n_chars")


@query("top1", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER "
               "(PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS rank FROM documents) "
               "WHERE rank <= 3")
def top1(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    found = top_per_group(docs, ["source"], _by_size(), 3)
    return found.select("source", "doc_id", F.col("rank").cast("bigint").alias("rank"))
