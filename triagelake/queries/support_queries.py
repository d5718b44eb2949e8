"""Threads, agreement of many raters, runs, array files, retries, live figures, the borderline queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.operators.agreement import fleiss_kappa
from triagelake.operators.threads import reply_roots, thread_context
from triagelake.plans.triage import rules_only
from triagelake.queries import sql
from triagelake.queries.evaluation_queries import _routing_sql
from triagelake.queries.registry import ORACLES, query
from triagelake.queries.search_queries import _r
from triagelake.queries.tables import inbound, labelled, table
from triagelake.session import scratch_path
from triagelake.sources.json_arrays import read_json_array
from triagelake.sources.runs import RunTable
from triagelake.streaming import arrivals, borderline
from triagelake.streaming import triage_stream as ts

# --- threads of conversations ------------------------------------------------

# A turn replies to the one before it; every seventh names one that is not there,
# and the openings of every tenth conversation name each other in a circle.
sql.cte(
    "t_replies_to",
    "SELECT conv_id * 1000000 + turn AS id, text, CASE WHEN turn % 7 = 6 THEN -1 - turn "
    "WHEN turn > 0 THEN conv_id * 1000000 + turn - 1 WHEN conv_id % 10 = 0 THEN conv_id * 1000000 + 1 "
    "END AS parent_id FROM conversations",
)
sql.cte(
    "t_roots",
    "WITH RECURSIVE up(id, root, depth) AS (SELECT id, id, 0::BIGINT FROM t_replies_to m "
    "WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM t_replies_to) "
    "UNION ALL SELECT m.id, up.root, up.depth + 1 FROM up JOIN t_replies_to m ON m.parent_id = up.id) "
    "SELECT * FROM up",
)


def _messages(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    key = F.col("conv_id") * 1_000_000
    parent = (
        F.when(F.col("turn") % 7 == 6, -1 - F.col("turn"))
        .when(F.col("turn") > 0, key + F.col("turn") - 1)
        .when(F.col("conv_id") % 10 == 0, key + 1)
    )
    return turns.select((key + F.col("turn")).alias("id"), "text", parent.alias("parent_id"))


@query("thr1", "SELECT m.id, m.parent_id, root, depth, parent_id IS NOT NULL AND parent_id NOT IN "
               "(SELECT id FROM t_replies_to) AS orphan, root IS NULL AS circular "
               "FROM t_replies_to m LEFT JOIN t_roots USING (id)")
def thr1(spark, sf):
    """Root and depth of every message."""
    return reply_roots(_messages(spark, sf))


@query("thr2", "SELECT m.id, md5(concat_ws(chr(10), c.text, b.text, a.text)) AS context_md5 FROM t_replies_to m "
               "LEFT JOIN t_replies_to a ON a.id = m.parent_id LEFT JOIN t_replies_to b ON b.id = a.parent_id "
               "LEFT JOIN t_replies_to c ON c.id = b.parent_id")
def thr2(spark, sf):
    """What the three messages before each one said."""
    found = thread_context(_messages(spark, sf), 3)
    return found.select("id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


# --- many raters -------------------------------------------------------------

sql.cte(
    "t_rated_parts",
    "SELECT l_orderkey AS item, l_returnflag || l_linestatus AS category, CAST(year(l_shipdate) AS INTEGER) AS g FROM lineitem",
)
sql.cte(
    "t_rated_counts",
    "SELECT g, item, category, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY g, item)::DOUBLE AS size "
    "FROM t_rated_parts GROUP BY g, item, category QUALIFY size >= 2",
)
sql.cte(
    "t_rated_items",
    "SELECT g, item, max(size) AS size, sum(n * n) AS square, sum(n * whole) AS crossed, "
    "(sum(n * n) - max(size)) / (max(size) * (max(size) - 1)) AS agree "
    "FROM (SELECT *, sum(n) OVER (PARTITION BY g, category) AS whole FROM t_rated_counts) GROUP BY g, item",
)
sql.cte(
    "t_rated_sums",
    "SELECT g, count(*) AS items, sum(size) AS sizes, sum(agree) AS agreed, (SELECT sum(c * c) FROM "
    "(SELECT sum(n) AS c FROM t_rated_counts c WHERE c.g = i.g GROUP BY category)) AS squares "
    "FROM t_rated_items i GROUP BY g",
)
sql.cte(
    "t_rated_without",
    "SELECT g, ((agreed - agree) / (items - 1) - e) / (1 - e) AS k FROM (SELECT *, "
    "(squares - 2 * crossed + square) / ((sizes - size) * (sizes - size)) AS e "
    "FROM t_rated_items JOIN t_rated_sums USING (g))",
)


@query("kap2", "SELECT g, items, sizes::BIGINT AS ratings, "
               f"{sql.rounded('agreed / items')} AS agreement, {sql.rounded('squares / (sizes * sizes)')} AS chance, "
               f"{sql.rounded('(agreed / items - squares / (sizes * sizes)) / (1 - squares / (sizes * sizes))')} AS kappa, "
               f"{sql.rounded('sqrt((items - 1) * (items - 1) / items * v)')} AS stderr FROM t_rated_sums "
               "JOIN (SELECT g, var_samp(k) AS v FROM t_rated_without GROUP BY g) USING (g)")
def kap2(spark, sf):
    """Fleiss' kappa of the parts of an order as its ratings, by year shipped."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item"), F.concat("l_returnflag", "l_linestatus").alias("category"),
        F.year("l_shipdate").alias("g"),
    )
    found = fleiss_kappa(rows, by=["g"])
    return found.select("g", "items", "ratings", *[_r(F.col(c)).alias(c) for c in ("agreement", "chance", "kappa", "stderr")])


# --- sources and sinks -------------------------------------------------------

_TEXTS = "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, lang, source FROM documents"


@query("src1_split", _TEXTS)
def src1_split(spark, sf):
    """Documents written as JSON arrays and read by many tasks."""
    path = scratch_path(spark, "arrays")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    # one array per hundred documents or so, several to a file
    groups = docs.groupBy(F.floor(F.col("doc_id") / 100).alias("g")).agg(
        F.collect_list(F.to_json(F.struct("doc_id", "text", "lang", "source"))).alias("rows")
    )
    groups.select(F.concat(F.lit("["), F.array_join("rows", ",\n "), F.lit("]")).alias("value")).write.text(path)
    read = read_json_array(spark, path, docs.schema)
    return read.select(
        "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "lang", "source"
    )


@query("snk_runs", ORACLES["str1"])
def snk_runs(spark, sf):
    """Decisions written in two runs, one of them twice, and one that died before its end."""
    rows = rules_only(inbound(spark, sf).select("id", F.coalesce("text", F.lit("")).alias("text"))).select(
        "id", "classification.intent", "decision.action", F.array_join("decision.reasons", " | ").alias("reasons")
    )
    runs = RunTable(spark, scratch_path(spark, "runs"), "json")
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    runs.write(rows.filter(half == 0), "first")
    runs.write(rows.filter(half == 1).limit(0), "second")  # repeated below: the last one counts
    runs.stage(rows, "third")  # never committed
    runs.write(rows.filter(half == 1), "second")
    return runs.read()


# --- streams with state ------------------------------------------------------


def _timed(spark, sf):
    """Documents with an event time, a minute apart; the first is after the epoch, where watermarks start."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("at", F.timestamp_seconds(F.col("id") * 60 + 60))


def _stream(spark, rows, name):
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("str_retries", "SELECT DISTINCT sha256(text) AS message_key FROM t_inbound")
def str_retries(spark, sf):
    """Every document sent twice, a minute apart, as messages without a key: each text once."""
    rows = _timed(spark, sf)
    again = rows.withColumn("at", F.col("at") + F.expr("INTERVAL 1 MINUTE"))
    stream = _stream(spark, rows.unionByName(again), "sent")
    out = scratch_path(spark, "first")
    # the delay covers the whole table, so copies of a text count as retries
    first = arrivals.first_arrivals(stream, "at", "36500 days", key=None)
    ts.write_stream(first.select(arrivals.KEY), out, scratch_path(spark, "first-state")).awaitTermination()
    return spark.read.parquet(out)


sql.cte("t_timed", "SELECT *, epoch_ms(CAST(seq * 60000 + 60000 AS BIGINT)) AS ts FROM t_predicted")


@query("str_windows", "SELECT epoch(w)::BIGINT AS start_s, epoch(w)::BIGINT + 21600 AS end_s, * EXCLUDE (w) FROM ("
                      + _routing_sql("(SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS w FROM t_timed)", "w") + ")")
def str_windows(spark, sf):
    """Routing metrics of labelled messages, window by window; a last row closes the last window."""
    rows = rules_only(labelled(spark, sf), "tweet_text").select(
        F.timestamp_seconds(F.col("seq") * 60 + 60).alias("at"), "expected_action", "is_critical",
        F.col("decision.action").alias("action"),
    )
    end = spark.range(1).select(
        F.timestamp_seconds(F.lit(9_000_000_000)).alias("at"), F.lit("").alias("expected_action"),
        F.lit(False).alias("is_critical"), F.lit("").alias("action"),
    )
    out = scratch_path(spark, "windows")
    stream = _stream(spark, rows.unionByName(end), "decided")
    windows = arrivals.routing_windows(stream, "at", "6 hours", "1 hour")
    ts.write_stream(windows, out, scratch_path(spark, "windows-state")).awaitTermination()
    return spark.read.parquet(out).select(
        F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("end").alias("end_s"), "*"
    ).drop("start", "end")


sql.cte(
    "t_borderline",
    "SELECT id, to_timestamp(id * 60 + 60) AS ts, 0.7 + (id % 20) / 100.0 AS confidence, "
    "CASE WHEN id % 3 = 0 THEN id % 50 END AS after, CASE WHEN id % 2 = 0 THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END AS verdict "
    "FROM t_inbound",
)


@query("str_borderline", "SELECT CAST(id AS VARCHAR) AS id, CASE WHEN confidence >= 0.85 THEN 'auto' WHEN confidence <= 0.75 THEN "
                         "'escalated' WHEN after <= 30 THEN CASE verdict WHEN 'AUTO_HANDLE' THEN 'released' ELSE 'rejected' END "
                         "ELSE 'timed_out' END AS outcome, epoch(ts)::BIGINT + 60 * CASE WHEN confidence >= 0.85 OR confidence <= 0.75 "
                         "THEN 0 WHEN after <= 30 THEN after ELSE 30 END AS decided_s FROM t_borderline")
def str_borderline(spark, sf):
    """Documents with a confidence by their id, a third of them reviewed some minutes later, waiting half an hour."""
    rows = _timed(spark, sf)
    messages = rows.select("id", "at", (F.lit(0.7) + (F.col("id") % 20) / 100.0).alias("confidence"))
    reviews = rows.filter(F.col("id") % 3 == 0).select(
        "id", F.timestamp_seconds(F.col("id") * 60 + 60 + (F.col("id") % 50) * 60).alias("at"),
        F.when(F.col("id") % 2 == 0, "AUTO_HANDLE").otherwise("ESCALATE").alias("verdict"),
    )
    end = spark.range(1).select(
        F.lit("end").alias("id"), F.timestamp_seconds(F.lit(9_000_000_000)).alias("at"),
        F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("verdict"),
    )
    stream = _stream(spark, borderline.events(messages, reviews).unionByName(end), "queue")
    out = scratch_path(spark, "outcomes")
    ts.write_stream(
        borderline.decide(stream, 30 * 60 * 1000), out, scratch_path(spark, "outcomes-state")
    ).awaitTermination()
    return spark.read.parquet(out).filter("id <> 'end'").select(
        "id", "outcome", F.unix_timestamp("decided_at").alias("decided_s")
    )
