"""The test tables in the roles the operators give them, for Spark and for the SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake import rules
from triagelake.operators.classify import classify
from triagelake.operators.retrieval import searchable
from triagelake.queries import fixtures
from triagelake.queries.sql import classified, cte, lit, tokens
from triagelake.session import cut_lineage, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# --- messages ----------------------------------------------------------------

cte(
    "t_messages",
    f"SELECT id, coalesce(text, '') AS text FROM "
    f"(SELECT doc_id AS id, text FROM documents UNION ALL {fixtures.values('messages')})",
)
cte("t_classified", classified("t_messages"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text``: all documents, and the inline messages."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("id"), "text")
    both = docs.unionByName(fixtures.frame(spark, "messages"))
    return both.withColumn("text", F.coalesce("text", F.lit("")))


def lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).withColumn("lc", F.lower("text"))


cte(
    "t_drafts",
    f"SELECT doc_id AS id, text AS draft_text FROM documents "
    f"UNION ALL {fixtures.values('drafts')}",
)


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, draft_text``: document texts taken as replies, and the inline drafts."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text").alias("draft_text")
    )
    return docs.unionByName(fixtures.frame(spark, "drafts"))


# --- question and reply pairs of conversations -------------------------------

cte(
    "t_pairs",
    "SELECT u.conv_id * 1000000 + u.turn AS doc_id, u.conv_id AS conv_id, "
    "u.text AS query_text, a.text AS resolution_text "
    "FROM conversations u JOIN conversations a "
    "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 "
    "WHERE u.role = 'user' AND a.role = 'assistant'",
)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, conv_id, query_text, resolution_text``: user turns and their replies."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("query_text")
    )
    reply = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("resolution_text")
    )
    return user.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("doc_id"),
        "conv_id", "query_text", "resolution_text",
    )


cte(
    "t_replies",
    "SELECT doc_id AS id, query_text AS query, resolution_text AS response FROM t_pairs "
    f"UNION ALL {fixtures.values('replies')}",
)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, query, response``: conversation pairs, and the inline replies."""
    return (
        pairs(spark, sf_dir)
        .select(
            F.col("doc_id").alias("id"),
            F.col("query_text").alias("query"),
            F.col("resolution_text").alias("response"),
        )
        .unionByName(fixtures.frame(spark, "replies"))
    )


# --- past resolutions --------------------------------------------------------

cte(
    "t_resolutions",
    "SELECT doc_id, 'hist_' || doc_id AS tweet_id, query_text, resolution_text, intent, embedding "
    f"FROM ({classified('t_pairs', 'query_text')}) p "
    "LEFT JOIN embeddings e ON e.vec_id = p.conv_id",
)


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus of past resolutions, one vector per conversation, written once."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("conv_id"), "embedding"
    )
    found = classify(pairs(spark, sf_dir), "query_text").join(vectors, "conv_id", "left")
    return cut_lineage(
        found.select(
            "doc_id",
            F.concat(F.lit("hist_"), F.col("doc_id").cast("string")).alias("tweet_id"),
            "query_text",
            "resolution_text",
            F.col("classification.intent").alias("intent"),
            "embedding",
        )
    )


cte(
    "t_inbound",
    "SELECT doc_id AS id, coalesce(text, '') AS text, embedding FROM documents d "
    "LEFT JOIN embeddings e ON e.vec_id = d.doc_id",
)


def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text, embedding``: all documents as messages with their vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("id"), "text")
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).join(vectors, "id", "left")


# --- search: benchmark texts against all documents ---------------------------


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searchable(inbound(spark, sf_dir), "id", "text", "embedding")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), "embedding"
    )
    items = table(spark, sf_dir, "benchmark").join(vectors, "item_id", "left")
    return searchable(items, "item_id", "text", "embedding")


cte(
    "t_search_queries",
    "SELECT item_id AS id, text, embedding FROM benchmark b "
    "LEFT JOIN embeddings e ON e.vec_id = b.item_id",
)


def ranking_ctes(prefix: str, queries: str, docs: str, text: str = "text", key: str = "id") -> None:
    """SQL tables of a full ranking of ``docs`` for every row of ``queries``."""
    p = f"t_{prefix}"
    cte(f"{p}_tokens", f"SELECT {key} AS doc_id, {tokens(text)} AS words FROM {docs}")
    cte(
        f"{p}_postings",
        f"SELECT doc_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc_id, "
        f"unnest(words) AS term, len(words) AS dl FROM {p}_tokens) GROUP BY doc_id, term",
    )
    cte(
        f"{p}_size",
        f"SELECT count(*) AS n_docs, CAST(coalesce(sum(len(words)), 0) AS BIGINT) AS n_tokens, "
        f"CAST(sum(len(words)) AS DOUBLE) / count(*) AS avgdl FROM {p}_tokens",
    )
    cte(
        f"{p}_raw",
        f"SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw "
        f"FROM (SELECT term, count(*) AS df FROM {p}_postings GROUP BY term), {p}_size",
    )
    cte(
        f"{p}_idf",
        f"SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {p}_raw) "
        f"ELSE raw END AS idf FROM {p}_raw",
    )
    cte(
        f"{p}_asked",
        f"SELECT query_id, term, count(*) AS qtf FROM (SELECT id AS query_id, "
        f"unnest({tokens('text')}) AS term FROM {queries}) GROUP BY query_id, term",
    )
    cte(
        f"{p}_lexical",
        f"SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / "
        f"(tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score "
        f"FROM {p}_asked JOIN {p}_idf USING (term) JOIN {p}_postings USING (term), {p}_size "
        f"GROUP BY query_id, doc_id",
    )
    unit = (
        "SELECT {k} AS {a}, CAST(embedding AS DOUBLE[]) AS v FROM {t} WHERE embedding IS NOT NULL"
    )
    cte(
        f"{p}_dense",
        f"SELECT query_id, doc_id, list_dot_product(q.v, d.v) / "
        f"(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))) AS score "
        f"FROM ({unit.format(k='id', a='query_id', t=queries)}) q, "
        f"({unit.format(k=key, a='doc_id', t=docs)}) d",
    )
    cte(
        f"{p}_scored",
        f"SELECT q.id AS query_id, d.{key} AS doc_id, round(coalesce(l.score, 0), 9) AS bm25_score, "
        f"round(coalesce(v.score, 0), 9) AS dense_score FROM {queries} q CROSS JOIN {docs} d "
        f"LEFT JOIN {p}_lexical l ON l.query_id = q.id AND l.doc_id = d.{key} "
        f"LEFT JOIN {p}_dense v ON v.query_id = q.id AND v.doc_id = d.{key}",
    )
    cte(
        f"{p}_ranked",
        "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, "
        "doc_id DESC) AS bm25_rank, row_number() OVER (PARTITION BY query_id "
        f"ORDER BY dense_score DESC, doc_id DESC) AS dense_rank FROM {p}_scored",
    )
    cte(
        f"{p}_fused",
        "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) "
        "AS rank FROM (SELECT *, CAST(1 AS DOUBLE) / (60 + bm25_rank) + "
        f"CAST(1 AS DOUBLE) / (60 + dense_rank) AS rrf_score FROM {p}_ranked)",
    )


ranking_ctes("search", "t_search_queries", "t_inbound")
ranking_ctes("past", "t_inbound", "t_resolutions", text="query_text", key="doc_id")


# --- labelled documents ------------------------------------------------------

_INTENT_LIST = "[" + ", ".join(map(lit, rules.INTENTS)) + "]"
cte(
    "t_labelled",
    "SELECT d.doc_id AS seq, 'doc_' || d.doc_id AS id, coalesce(d.text, '') AS tweet_text, "
    f"{_INTENT_LIST}[CAST(regexp_extract(d.source, '[0-9]+') AS BIGINT) % 6 + 1] AS expected_intent, "
    "CASE WHEN l.toxic = 1 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS expected_action, "
    "(l.toxic = 1 AND l.quality = 0) AS is_critical, "
    "CAST(CASE WHEN l.toxic = 1 THEN 4.5 WHEN l.quality = 1 THEN 5.0 ELSE 3.5 END AS DOUBLE) "
    "AS human_quality_score FROM labels l JOIN documents d ON d.doc_id = l.doc_id",
)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as golden items: the class follows from the source."""
    joined = table(spark, sf_dir, "labels").join(
        spread(table(spark, sf_dir, "documents"), "doc_id"), "doc_id"
    )
    place = F.regexp_extract("source", "[0-9]+", 0).cast("bigint") % 6 + 1
    toxic = F.col("toxic") == 1
    return joined.select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
        F.coalesce("text", F.lit("")).alias("tweet_text"),
        F.element_at(F.array(*[F.lit(i) for i in rules.INTENTS]), place.cast("int")).alias(
            "expected_intent"
        ),
        F.when(toxic, rules.ESCALATE).otherwise(rules.AUTO_HANDLE).alias("expected_action"),
        (toxic & (F.col("quality") == 0)).alias("is_critical"),
        F.when(toxic, 4.5).when(F.col("quality") == 1, 5.0).otherwise(3.5).alias(
            "human_quality_score"
        ),
    )
