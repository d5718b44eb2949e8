"""Golden sets, metrics, failure mining, the whole job and its evaluation, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake import rules as R
from triagelake import schemas
from triagelake.operators import failures as fl
from triagelake.operators import metrics
from triagelake.operators.golden import expand_to_quota, golden_set
from triagelake.plans import evaluation as ev
from triagelake.plans.triage import rules_only, triage
from triagelake.queries import fixtures, sql
from triagelake.queries.registry import query
from triagelake.queries.tables import (
    inbound, labelled, pairs, resolutions, table,
)
from triagelake.session import cut_lineage, scratch_path
from triagelake.sources import readers, writers



def _r(column, digits=6):
    """Rounded by the same arithmetic as ``sql.rounded``."""
    scale = F.lit(10.0**digits)
    return F.floor(column * scale + 0.5).cast("double") / scale


def _routing_sql(source: str, by: str = "") -> str:
    head = f"{by}, " if by else ""

    def percent(part, whole, name):
        return (f"CASE WHEN {whole} > 0 THEN round(CAST({part} AS DOUBLE) / {whole} * 100, 2) "
                f"ELSE 0 END AS {name}")

    return f"""
      SELECT {head} total_queries, total_auto_handled, wrong_auto_handled, total_escalations,
        critical_escapes, total_critical_items,
        {percent('total_auto_handled', 'total_queries', 'deflection_rate')},
        {percent('wrong_auto_handled', 'total_auto_handled', 'fahr')},
        {percent('critical_escapes', 'total_critical_items', 'cer')},
        {percent('wrong_auto_handled', 'total_escalations', 'fahr_of_escalations')}
      FROM (SELECT {head} count(*) AS total_queries,
              count(*) FILTER (action = 'AUTO_HANDLE') AS total_auto_handled,
              count(*) FILTER (action = 'AUTO_HANDLE' AND expected_action = 'ESCALATE')
                AS wrong_auto_handled,
              count(*) FILTER (expected_action = 'ESCALATE') AS total_escalations,
              count(*) FILTER (action = 'AUTO_HANDLE' AND is_critical) AS critical_escapes,
              count(*) FILTER (is_critical) AS total_critical_items
            FROM {source} {f'GROUP BY {by}' if by else ''})"""


# --- predictions of the labelled documents, rules only -----------------------

sql.cte(
    "t_predicted",
    "SELECT id, seq, text AS tweet_text, expected_intent, expected_action, is_critical, "
    "human_quality_score, intent AS predicted_intent, confidence, action, reasons FROM ("
    + sql.decided(
        "(SELECT *, CAST(NULL AS VARCHAR) AS draft_text FROM ("
        + sql.classified("(SELECT *, tweet_text AS text FROM t_labelled)")
        + "))"
    )
    + ")",
)


def _predicted(spark, sf):
    return rules_only(labelled(spark, sf), "tweet_text").select(
        "id", "seq", "tweet_text", "expected_intent", "expected_action", "is_critical",
        F.col("classification.intent").alias("predicted_intent"),
        F.col("classification.confidence").alias("confidence"),
        F.col("decision.action").alias("action"),
        F.col("decision.reasons").alias("reasons"),
    )


_THRESHOLDS = (0.5, 0.7, 0.72, 0.85, 0.91, 0.92, 0.93, 0.94, 0.95, 0.99)


sql.cte(
    "t_swept",
    "SELECT threshold, expected_action, p.is_critical, CASE WHEN layer <> 'HARD_RULE' "
    "AND grounding_passed AND confidence >= threshold THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END AS action "
    "FROM ("
    + sql.decided(
        "(SELECT *, CAST(NULL AS VARCHAR) AS draft_text FROM ("
        + sql.classified("(SELECT id, tweet_text AS text, expected_action FROM t_labelled)")
        + "))"
    )
    + ") d JOIN (SELECT id, is_critical FROM t_labelled) p USING (id), "
    f"(SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _THRESHOLDS)}]) AS threshold)",
)


@query("swp1", f"SELECT * FROM ({_routing_sql('t_swept', 'threshold')})")
def swp1(spark, sf):
    """Deflection against false automatic handling, by confidence threshold."""
    decided = rules_only(labelled(spark, sf), "tweet_text")
    hard = F.col("decision.layer") == "HARD_RULE"
    return metrics.threshold_sweep(
        decided.withColumns(
            {
                "allowed": ~hard & F.col("decision.grounding_passed"),
                "confidence": F.col("classification.confidence"),
            }
        ),
        _THRESHOLDS,
    )


@query("aud1", "SELECT expected_intent, count(*) AS items, count(*) FILTER "
               "(expected_action = 'ESCALATE') AS escalations, count(*) FILTER (is_critical) AS critical, "
               "round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS share "
               "FROM t_labelled GROUP BY expected_intent")
def aud1(spark, sf):
    """How the labels of a golden set are distributed."""
    return metrics.label_audit(labelled(spark, sf))


@query("jn3", ("SELECT l.id, l.expected_intent, c.intent AS predicted_intent FROM t_labelled l "
                "JOIN t_classified c ON c.id = l.seq"))
def jn3(spark, sf):
    """Truth and prediction, joined by id rather than by position."""
    from triagelake.operators.classify import classify
    from triagelake.queries.tables import messages

    found = classify(messages(spark, sf)).select(
        F.col("id").alias("seq"), F.col("classification.intent").alias("predicted_intent")
    )
    truth = labelled(spark, sf).select("id", "seq", "expected_intent")
    return truth.join(found, "seq").select("id", "expected_intent", "predicted_intent")


@query("agg1", ("SELECT expected_intent AS y_true, predicted_intent AS y_pred, count(*) AS n "
                 "FROM t_predicted GROUP BY ALL"))
def agg1(spark, sf):
    return metrics.confusion(_predicted(spark, sf), "expected_intent", "predicted_intent")


def _class_sql(source: str, by: str = "") -> str:
    listed = "(" + " UNION ALL ".join(f"SELECT '{i}' AS label" for i in R.INTENTS) + ")"
    groups = f"(SELECT DISTINCT {by} FROM {source})" if by else "(SELECT 1 AS one)"
    same = f"s.{by} = g.{by} AND " if by else ""
    head = f"{by}, " if by else ""
    return f"""
      SELECT {head}label, tp, fp, fn, tp + fn AS support,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
             CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_score
      FROM (SELECT {('g.' + by + ', ') if by else ''} label,
              CAST(count(CASE WHEN expected_intent = label AND predicted_intent = label THEN 1 END) AS DOUBLE) AS tp,
              CAST(count(CASE WHEN expected_intent <> label AND predicted_intent = label THEN 1 END) AS DOUBLE) AS fp,
              CAST(count(CASE WHEN expected_intent = label AND predicted_intent <> label THEN 1 END) AS DOUBLE) AS fn
            FROM {groups} g CROSS JOIN {listed} l
            LEFT JOIN {source} s ON {same} (s.expected_intent = label OR s.predicted_intent = label)
            GROUP BY ALL)"""


@query("agg2", ("SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, "
                 "CAST(fn AS BIGINT) AS fn, CAST(support AS BIGINT) AS support, "
                 f"{sql.rounded('precision')} AS precision, {sql.rounded('recall')} AS recall, "
                 f"{sql.rounded('f1_score')} AS f1_score FROM ({_class_sql('t_predicted')})"))
def agg2(spark, sf):
    found = metrics.class_metrics(_predicted(spark, sf), "expected_intent", "predicted_intent")
    return found.select(
        "label", "tp", "fp", "fn", "support",
        *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1_score")],
    )


@query("agg3", (f"SELECT {sql.rounded('avg(f1_score)')} AS macro_f1 FROM ({_class_sql('t_predicted')})"))
def agg3(spark, sf):
    found = metrics.class_metrics(_predicted(spark, sf), "expected_intent", "predicted_intent")
    return metrics.macro_f1(found).select(_r(F.col("macro_f1")).alias("macro_f1"))


@query("agg4", (_routing_sql("t_predicted")))
def agg4(spark, sf):
    return metrics.routing_metrics(_predicted(spark, sf))


# --- ratings -----------------------------------------------------------------


@query("agg6", "SELECT o_orderkey, CAST(round_even(round(o_totalprice / 100000, 1), 0) AS BIGINT) "
               "AS rating FROM orders")
def agg6(spark, sf):
    rating = F.round(F.col("o_totalprice") / 100000, 1)
    return table(spark, sf, "orders").select(
        "o_orderkey", metrics.discretise(rating).cast("bigint").alias("rating")
    )


_RATED = ("SELECT o_orderstatus AS g, CAST(o_orderpriority[1] AS INTEGER) AS a, "
          "CAST(round_even(round(o_totalprice / 100000, 1), 0) AS INTEGER) AS b FROM orders")


@query("agg7", f"SELECT g AS o_orderstatus, n, cohens_kappa FROM ({sql.kappa(_RATED)})")
def agg7(spark, sf):
    rated = table(spark, sf, "orders").select(
        "o_orderstatus",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.round(F.col("o_totalprice") / 100000, 1).alias("price"),
    )
    return metrics.quadratic_kappa(rated, "priority", "price", ["o_orderstatus"])


_HUMAN = "CASE WHEN l.toxic = 1 THEN 1 WHEN l.quality = 1 THEN 5 ELSE 3 END"
_CASES = (
    f"(SELECT 'calibration' AS g, query, response, rating FROM ({fixtures.values('calibration')}) "
    f"UNION ALL SELECT 'conversations', query_text, resolution_text, {_HUMAN} "
    "FROM t_pairs p JOIN labels l ON l.doc_id = p.conv_id)"
)


@query("agg8", (
    "SELECT g AS scope, n, cohens_kappa FROM ("
    + sql.kappa(
        "SELECT g, rating AS a, CAST(round_even(overall, 0) AS INTEGER) AS b FROM ("
        + sql.judged(_CASES, "query", "response") + ")"
    )
    + ")"))
def agg8(spark, sf):
    """Agreement on the 25 rated cases, and on conversations rated by their labels."""
    human = (
        F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 5).otherwise(3)
    )
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"), human.alias("rating"))
    rated = pairs(spark, sf).join(labels, "conv_id").select(
        F.lit("conversations").alias("scope"), F.col("query_text").alias("query"),
        F.col("resolution_text").alias("response"), "rating",
    )
    fixed = fixtures.frame(spark, "calibration").select(
        F.lit("calibration").alias("scope"), "query", "response", "rating"
    )
    return ev.calibration(rated.unionByName(fixed), ("scope",))


# --- failures ----------------------------------------------------------------

sql.cte("t_failures", f"""
    SELECT *, CASE WHEN mode = '{R.MODE_INTENT}'
                   THEN 'Classified as ' || predicted_intent || ' instead of ' || expected_intent
                   ELSE 'Safe query escalated due to: ' || array_to_string(reasons, '; ')
              END AS details
    FROM (SELECT *, CASE WHEN expected_intent <> predicted_intent THEN '{R.MODE_INTENT}'
                         WHEN expected_action = 'AUTO_HANDLE' AND action = 'ESCALATE'
                         THEN '{R.MODE_OVER_ESCALATION}' END AS mode FROM t_predicted)
    WHERE mode IS NOT NULL""")


def _failures(spark, sf):
    return fl.tag_failures(_predicted(spark, sf), key="seq")


def _stored_failures(spark, sf):
    return cut_lineage(_failures(spark, sf))


@query("fail1", (
    f"SELECT seq, mode, details, CASE WHEN mode = '{R.MODE_INTENT}' THEN confidence END AS confidence, "
    f"CASE WHEN mode = '{R.MODE_INTENT}' THEN expected_intent END AS gold_intent, "
    f"CASE WHEN mode <> '{R.MODE_INTENT}' THEN action END AS predicted_action FROM t_failures"))
def fail1(spark, sf):
    return _failures(spark, sf).select(
        "seq", "mode", "details", "confidence", "gold_intent", "predicted_action"
    )


@query("agg9", ("SELECT mode, count(*) AS total_occurrences FROM t_failures GROUP BY mode"))
def agg9(spark, sf):
    return fl.count_modes(_failures(spark, sf), "seq").select("mode", "total_occurrences")


@query("win2", ("SELECT mode, seq, example FROM (SELECT mode, seq, row_number() OVER "
                 "(PARTITION BY mode ORDER BY seq) AS example FROM t_failures) WHERE example <= 2"))
def win2(spark, sf):
    return fl.examples(_failures(spark, sf), "seq").select(
        "mode", "seq", F.col("example").cast("bigint").alias("example")
    )


@query("top2", ("SELECT mode, count(*) AS total_occurrences, min(seq) AS first_seen "
                 "FROM t_failures GROUP BY mode ORDER BY first_seen, mode LIMIT 5"))
def top2(spark, sf):
    return fl.first_modes(_failures(spark, sf), "seq")


_REPORT = (f"""
    SELECT mode AS failure_mode, count(*) AS total_occurrences,
           string_agg(details, ' | ' ORDER BY seq) FILTER (example <= 2) AS examples,
           CASE WHEN contains(mode, 'Intent') THEN '{R.MITIGATION_INTENT}'
                ELSE '{R.MITIGATION_OTHER}' END AS recommended_mitigation
    FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY seq) AS example FROM t_failures)
    GROUP BY mode""")


def _flat_report(report):
    return report.select(
        "failure_mode", "total_occurrences",
        F.array_join("representative_examples.details", " | ").alias("examples"),
        "recommended_mitigation",
    )


@query("fail2", _REPORT)
def fail2(spark, sf):
    return _flat_report(fl.summarise(_stored_failures(spark, sf), "seq"))


@query("snk2", _REPORT)
def snk2(spark, sf):
    """The failure report written as nested JSON and read back."""
    report = fl.summarise(_stored_failures(spark, sf), "seq")
    path = scratch_path(spark, "failures")
    writers.write_json(report, path)
    return _flat_report(spark.read.schema(report.schema).json(path))


# --- golden sets -------------------------------------------------------------

_QUOTA = "(SELECT count(*) // 3 FROM labels)"
sql.cte("t_golden", f"""
    SELECT p.*, n, CASE WHEN n < size THEN tweet_text
             WHEN contains(tweet_text, '?')
             THEN replace(tweet_text, '?', '? [var-' || n || ']')
             ELSE tweet_text || ' [var-' || n || ']' END AS varied,
           printf('gold_%03d', (list_position([{', '.join(f"'{i}'" for i in R.INTENTS)}],
                  expected_intent) - 1) * {_QUOTA} + n + 1) AS gold_id
    FROM (SELECT *, row_number() OVER (PARTITION BY expected_intent ORDER BY seq) - 1 AS pos,
                 count(*) OVER (PARTITION BY expected_intent) AS size FROM t_labelled) p
    JOIN (SELECT unnest(range({_QUOTA})) AS n) r ON r.n % p.size = p.pos""")


def _templates(spark, sf):
    none = F.lit(None).cast("string")
    return labelled(spark, sf).select(
        "*", none.alias("expected_escalation_reason"), none.alias("context_note")
    )


def _quota(spark, sf):
    """A third of the labelled rows per class: about two passes over each class."""
    return table(spark, sf, "labels").count() // 3


_GOLDEN = ("SELECT gold_id AS id, md5(varied) AS text_md5, expected_intent, expected_action, "
            "is_critical, human_quality_score FROM t_golden")


def _flat_golden(golden):
    return golden.select(
        "id", F.md5(F.col("tweet_text").cast("binary")).alias("text_md5"), "expected_intent",
        "expected_action", "is_critical", "human_quality_score",
    )


@query("gen1", _GOLDEN)
def gen1(spark, sf):
    return _flat_golden(golden_set(_templates(spark, sf), _quota(spark, sf)))


@query("win3", ("SELECT expected_intent, CAST(n AS BIGINT) AS n, seq FROM t_golden"))
def win3(spark, sf):
    return expand_to_quota(_templates(spark, sf), _quota(spark, sf)).select(
        "expected_intent", F.col("n").cast("bigint").alias("n"), "seq"
    )


@query("src2", _GOLDEN)
def src2(spark, sf):
    """The golden set is missing, so it is built, written and read."""
    path = scratch_path(spark, "golden")
    return _flat_golden(
        readers.load_golden(spark, path, _templates(spark, sf), _quota(spark, sf))
    )


def _as_resolutions(corpus):
    none = F.lit(None).cast("string")
    return corpus.select(
        "tweet_id", F.col("doc_id").cast("string").alias("inbound_id"),
        none.alias("author_id"), "query_text", "resolution_text", "intent",
        F.lit(None).cast("timestamp").alias("created_at"),
    )


@query("src1", ("SELECT tweet_id, md5(query_text) AS query_md5, md5(resolution_text) AS reply_md5, "
                 "intent FROM t_resolutions"))
def src1(spark, sf):
    """Past resolutions written as JSON and loaded with the fixed schema."""
    path = scratch_path(spark, "resolutions")
    writers.write_json(_as_resolutions(resolutions(spark, sf)), path)
    return readers.load_resolutions(spark, path).select(
        "tweet_id", F.md5(F.col("query_text").cast("binary")).alias("query_md5"),
        F.md5(F.col("resolution_text").cast("binary")).alias("reply_md5"), "intent",
    )


@query("snk3", "SELECT intent, tweet_id, md5(query_text) AS query_md5, md5(resolution_text) AS reply_md5 "
               "FROM t_resolutions")
def snk3(spark, sf):
    """Past resolutions written as parquet by intent and read back."""
    path = scratch_path(spark, "resolutions")
    writers.write_parquet(
        _as_resolutions(resolutions(spark, sf)), path, partition_by=["intent"]
    )
    read = spark.read.schema(schemas.RESOLUTION).parquet(path)
    return read.select(
        "intent", "tweet_id", F.md5(F.col("query_text").cast("binary")).alias("query_md5"),
        F.md5(F.col("resolution_text").cast("binary")).alias("reply_md5"),
    )


# --- the whole job -----------------------------------------------------------

sql.cte("t_triaged", sql.decided("t_drafted"))
sql.cte(
    "t_found",
    "SELECT query_id AS id, string_agg(concat_ws(' ', tweet_id, intent, "
    "md5(query_text || chr(10) || resolution_text), "
    "CAST(floor(bm25_score * 1e6 + 0.5) AS BIGINT), CAST(floor(dense_score * 1e6 + 0.5) AS BIGINT), "
    "CAST(floor(rrf_score * 1e9 + 0.5) AS BIGINT)), '; ' ORDER BY rank) AS found "
    "FROM t_past_fused JOIN t_resolutions USING (doc_id) WHERE rank <= 3 GROUP BY query_id",
)


@query("pip1", (
    "SELECT CAST(id AS VARCHAR) AS tweet_id, intent, sources, draft_text, action AS final_action, "
    f"layer, is_critical, CASE WHEN action = 'AUTO_HANDLE' THEN draft_text ELSE '{R.ROUTED_PREFIX}' "
    "|| array_to_string(reasons, '; ') END AS final_response, confidence, reasoning, "
    "array_to_string(reasons, ' | ') AS reasons, confidence_passed, grounding_passed, "
    "sanitized_draft, found FROM t_triaged JOIN t_found USING (id)"))
def pip1(spark, sf):
    done = triage(inbound(spark, sf), resolutions(spark, sf), embedding="embedding")
    return done.select(
        "tweet_id", "classification.intent",
        F.array_join("draft.grounded_sources", ",").alias("sources"), "draft.draft_text",
        "final_action", "arbiter_decision.layer", "arbiter_decision.is_critical",
        "final_response", "classification.confidence", "classification.reasoning",
        F.array_join("arbiter_decision.reasons", " | ").alias("reasons"),
        "arbiter_decision.confidence_passed", "arbiter_decision.grounding_passed",
        "arbiter_decision.sanitized_draft",
        F.array_join(F.transform("retrieved_resolutions", _found), "; ").alias("found"),
    )


def _found(row):
    """A retrieved row in one line, its scores in whole millionths (fused: billionths)."""
    def units(score, digits):
        return F.floor(row[score] * (10.0**digits) + 0.5).cast("bigint").cast("string")

    texts = F.concat(row["query_text"], F.lit("\n"), row["resolution_text"])
    return F.concat_ws(
        " ", row["tweet_id"], row["intent"], F.md5(texts.cast("binary")),
        units("bm25_score", 6), units("dense_score", 6), units("rrf_score", 9),
    )


sql.cte(
    "t_systems",
    "SELECT * FROM (" + sql.judged(f"""
      (SELECT '{R.SYSTEMS[0]}' AS system, tweet_text, expected_intent, expected_action, is_critical,
              human_quality_score, '{R.CONSTANT_INTENT}' AS predicted_intent, 'ESCALATE' AS action,
              '{R.CONSTANT_REPLY}' AS response FROM t_labelled
       UNION ALL
       SELECT '{R.SYSTEMS[1]}', tweet_text, expected_intent, expected_action, is_critical,
              human_quality_score, predicted_intent, 'AUTO_HANDLE',
              {sql.reply_case('lower(tweet_text)')} FROM t_predicted
       UNION ALL
       SELECT '{R.SYSTEMS[2]}', tweet_text, expected_intent, expected_action, l.is_critical,
              human_quality_score, t.intent, t.action, t.draft_text
       FROM t_labelled l JOIN t_triaged t ON t.id = l.seq)""", "tweet_text", "response") + ")",
)


def _judged(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), "embedding")
    golden = labelled(spark, sf).join(vectors, "seq", "left")
    return ev.judged_predictions(golden, resolutions(spark, sf), "embedding", keep=["seq"])


_JOB_FAILURES = f"""
    SELECT *, CASE WHEN mode = '{R.MODE_INTENT}'
                   THEN 'Classified as ' || intent || ' instead of ' || expected_intent
                   ELSE 'Safe query escalated due to: ' || array_to_string(reasons, '; ')
              END AS details
    FROM (SELECT *, CASE WHEN expected_intent <> intent THEN '{R.MODE_INTENT}'
                         WHEN expected_action = 'AUTO_HANDLE' AND action = 'ESCALATE'
                         THEN '{R.MODE_OVER_ESCALATION}' END AS mode
          FROM t_triaged t JOIN (SELECT seq, expected_intent, expected_action FROM t_labelled) l
          ON l.seq = t.id)
    WHERE mode IS NOT NULL"""


@query("fail2_job", _REPORT.replace("FROM t_failures", f"FROM ({_JOB_FAILURES})"))
def fail2_job(spark, sf):
    """The failure report of the whole triage job, drafts and grounding included."""
    return _flat_report(ev.failure_report(_judged(spark, sf)[0], "seq"))


_MEANS = ", ".join(f"round(avg({s}), 2) AS {s}" for s in ("grounding", "tone", "actionability"))


@query("agg5", (f"SELECT system, {_MEANS} FROM t_systems GROUP BY system"))
def agg5(spark, sf):
    return metrics.mean_scores(_judged(spark, sf)[1], by=["system"])


_SYSTEM_KAPPA = sql.kappa(
    "SELECT system AS g, CAST(round_even(human_quality_score, 0) AS INTEGER) AS a, "
    "CAST(round_even(overall, 0) AS INTEGER) AS b FROM t_systems"
)
_COMPARISON = f"""
    SELECT system, {sql.rounded('macro_f1')} AS macro_f1, deflection_rate, fahr, cer, grounding, tone,
           actionability, cohens_kappa, total_queries, total_auto_handled, critical_escapes,
           total_critical_items
    FROM (SELECT system, avg(f1_score) AS macro_f1 FROM ({_class_sql('t_systems', 'system')})
          GROUP BY system)
    JOIN ({_routing_sql('t_systems', 'system')}) USING (system)
    JOIN (SELECT system, {_MEANS} FROM t_systems GROUP BY system) USING (system)
    JOIN (SELECT g AS system, cohens_kappa FROM ({_SYSTEM_KAPPA})) USING (system)"""


@query("evl1", (_COMPARISON))
def evl1(spark, sf):
    """Three systems over the labelled documents, compared."""
    comparison = ev.compare(_judged(spark, sf)[1])
    return comparison.withColumn("macro_f1", _r(F.col("macro_f1")))


@query("set1", ("SELECT system, action, predicted_intent, count(*) AS n, "
                 f"{sql.rounded('avg(overall)')} AS overall FROM t_systems GROUP BY ALL"))
def set1(spark, sf):
    """The three systems stacked into one table."""
    return _judged(spark, sf)[1].groupBy("system", "action", "predicted_intent").agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("judgement.overall")).alias("overall")
    )


@query("snk1", (f"""
    SELECT system, total_queries AS golden_set_size, macro_f1, deflection_rate, grounding,
           CASE WHEN system = '{R.SYSTEMS[2]}'
                THEN (SELECT cohens_kappa FROM ({sql.kappa(
                    "SELECT 1 AS g, rating AS a, CAST(round_even(overall, 0) AS INTEGER) AS b FROM ("
                    + sql.judged(f"({fixtures.values('calibration')})", "query", "response") + ")")}))
                ELSE cohens_kappa END AS cohens_kappa,
           CASE WHEN system = '{R.SYSTEMS[2]}' THEN (
             SELECT string_agg(concat_ws(' ', label, {', '.join(
                 f"CAST(floor({c} * 1e6 + 0.5) AS BIGINT)" for c in ("precision", "recall", "f1_score"))},
                 CAST(support AS BIGINT)), '; ' ORDER BY label)
             FROM ({_class_sql('t_systems', 'system')}) WHERE system = '{R.SYSTEMS[2]}') END AS classes
    FROM ({_COMPARISON})"""))
def snk1(spark, sf):
    """The nested results record written as JSON and read back."""
    judged = _judged(spark, sf)[1]
    record = ev.payload(
        ev.compare(judged), ev.per_class(judged),
        ev.calibration(fixtures.frame(spark, "calibration")),
    )
    path = scratch_path(spark, "results")
    writers.write_json(record, path)
    read = spark.read.schema(record.schema).json(path)
    rows = read.select("golden_set_size", F.explode("systems").alias("system", "m"))
    return rows.select(
        "system", "golden_set_size", _r(F.col("m.macro_f1")).alias("macro_f1"),
        "m.deflection_rate", "m.grounding", "m.cohens_kappa",
        F.array_join(
            F.array_sort(F.transform(F.map_entries("m.per_intent_metrics"), _class_line)), "; "
        ).alias("classes"),
    )


def _class_line(entry):
    """A class's values in one line, ratios in whole millionths."""
    values = entry["value"]
    ratios = [
        F.floor(values[c] * 1e6 + 0.5).cast("bigint").cast("string")
        for c in ("precision", "recall", "f1_score")
    ]
    return F.concat_ws(" ", entry["key"], *ratios, values["support"].cast("bigint").cast("string"))
