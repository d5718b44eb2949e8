"""Scalar rules: predicates, classification, personal data, arbiter, drafts, judge."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake import rules as R
from triagelake.functions import pii
from triagelake.functions.words import in_flags, in_text, with_words
from triagelake.functions.text import contains_any, ends_with_any, message_id
from triagelake.operators import arbiter, draft, judge
from triagelake.operators.baselines import with_baselines
from triagelake.operators.classify import classify, parse_classification, rule_hits
from triagelake.operators.quality import violations
from triagelake.plans.triage import ATTRIBUTES, rules_only, with_drafts
from triagelake.operators.retrieval import attach_attributes, searchable, with_hits
from triagelake.queries import fixtures, sql
from triagelake.queries.registry import query
from triagelake.queries.tables import (
    drafts, inbound, lowered, messages, pairs, replies, resolutions, table,
)

def lower_text():
    return F.col("lc")


def _classified(spark, sf):
    return classify(messages(spark, sf))


# --- predicates --------------------------------------------------------------


@query("prd1", (f"SELECT id, {sql.has_any('lc', R.LEGAL_WORDS)} AS legal, "
                 f"{sql.has_any('lc', R.HOW_TO_WORDS)} AS how_to FROM t_classified"))
def prd1(spark, sf):
    return lowered(spark, sf).select(
        "id", contains_any(lower_text(), R.LEGAL_WORDS).alias("legal"),
        contains_any(lower_text(), R.HOW_TO_WORDS).alias("how_to"),
    )


@query("prd2", (
    f"SELECT id, ({sql.has_any('lc', R.HARDWARE_WORDS)} AND NOT (contains(lc, 'ios') OR "
    f"contains(lc, 'update'))) AS hardware, ({sql.has_any('lc', R.ORDER_WORDS)} OR "
    "(contains(lc, 'track') AND NOT contains(lc, 'trackpad'))) AS orders_hit FROM t_classified"))
def prd2(spark, sf):
    return lowered(spark, sf).select(
        "id", rule_hits(in_text(lower_text()), R.INTENT_RULES[1]).alias("hardware"),
        rule_hits(in_text(lower_text()), R.INTENT_RULES[3]).alias("orders_hit"),
    )


@query("prd3", ("SELECT id, (" + " OR ".join(f"ends_with(draft_text, '{s}')" for s in R.SIGNOFFS)
                 + ") AS signed FROM t_drafts"))
def prd3(spark, sf):
    return drafts(spark, sf).select(
        "id", ends_with_any(F.col("draft_text"), R.SIGNOFFS).alias("signed")
    )


@query("prd4", (f"SELECT id, {sql.has_any('draft_text', R.SIGNOFFS)} AS has_signoff FROM t_drafts"))
def prd4(spark, sf):
    return drafts(spark, sf).select(
        "id", contains_any(F.col("draft_text"), R.SIGNOFFS).alias("has_signoff")
    )


@query("prd5", ("SELECT id, confidence, confidence >= 0.85 AS confident FROM t_classified"))
def prd5(spark, sf):
    confidence = F.col("classification.confidence")
    return _classified(spark, sf).select(
        "id", confidence.alias("confidence"),
        (confidence >= R.CONFIDENCE_THRESHOLD).alias("confident"),
    )


# --- record checks -----------------------------------------------------------


@query("v1", (f"""
    SELECT id, rule FROM (
      SELECT id, unnest([x FOR x IN [
        CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence_range' END,
        CASE WHEN NOT coalesce(intent IN {sql.in_list(R.INTENTS)}, false) THEN 'intent_domain' END,
        CASE WHEN NOT coalesce(action IN {sql.in_list(R.ACTIONS)}, false) THEN 'action_domain' END
      ] IF x IS NOT NULL]) AS rule
      FROM (SELECT id, intent, confidence, 'ESCALATE' AS action FROM t_classified
            UNION ALL SELECT 1000000000 + event_id, upper(event_type), value / 10,
                             CASE WHEN value > 10 THEN 'AUTO_HANDLE' END FROM events))"""))
def v1(spark, sf):
    good = _classified(spark, sf).select(
        "id", "classification.intent", "classification.confidence",
        F.lit(R.ESCALATE).alias("action"),
    )
    events = table(spark, sf, "events").select(
        (F.lit(1000000000) + F.col("event_id")).alias("id"),
        F.upper("event_type").alias("intent"),
        (F.col("value") / 10).alias("confidence"),
        F.when(F.col("value") > 10, R.AUTO_HANDLE).alias("action"),
    )
    return violations(good.unionByName(events))


_VALID = (
    f"json_extract_string(payload, '$.intent') IN {sql.in_list(R.INTENTS)} AND "
    "TRY_CAST(json_extract_string(payload, '$.confidence') AS DOUBLE) BETWEEN 0 AND 1 AND "
    "json_extract_string(payload, '$.reasoning') IS NOT NULL"
)


@query("v2", (f"""
    SELECT id, CASE WHEN ok THEN json_extract_string(payload, '$.intent')
                    ELSE '{R.FALLBACK_INTENT.intent}' END AS intent,
           CASE WHEN ok THEN CAST(json_extract_string(payload, '$.confidence') AS DOUBLE)
                ELSE 0.7 END AS confidence,
           CASE WHEN ok THEN json_extract_string(payload, '$.reasoning')
                ELSE '{R.FALLBACK_INTENT.reasoning}' END AS reasoning
    FROM (SELECT *, coalesce({_VALID}, false) AS ok FROM (
      SELECT id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM (
        SELECT 1000000000 + event_id AS id, props AS payload FROM events
        UNION ALL SELECT doc_id, '{{"intent":"' || intent || '","confidence":' || confidence ||
                         ',"reasoning":"past"}}' FROM ({sql.classified('t_pairs', 'query_text')})
        UNION ALL {fixtures.values('payloads')})))"""))
def v2(spark, sf):
    events = table(spark, sf, "events").select(
        (F.lit(1000000000) + F.col("event_id")).alias("id"), F.col("props").alias("payload")
    )
    past = classify(pairs(spark, sf), "query_text").select(
        F.col("doc_id").alias("id"),
        F.to_json(
            F.struct(
                "classification.intent", "classification.confidence",
                F.lit("past").alias("reasoning"),
            )
        ).alias("payload"),
    )
    rows = events.unionByName(past).unionByName(fixtures.frame(spark, "payloads"))
    return rows.withColumn("c", parse_classification(F.col("payload"))).select("id", "c.*")


# --- classification ----------------------------------------------------------


@query("cls1", (f"SELECT id, {sql.has_any('lc', R.AMBIGUOUS_PHRASES)} AS ambiguous, "
                 "confidence FROM t_classified"))
def cls1(spark, sf):
    return _classified(spark, sf).select(
        "id", rule_hits(in_flags(), R.INTENT_RULES[0]).alias("ambiguous"),
        F.col("classification.confidence").alias("confidence"),
    )


@query("cls2", ("SELECT id, intent, confidence, reasoning FROM t_classified"))
def cls2(spark, sf):
    return _classified(spark, sf).select("id", "classification.*")


@query("cls3", ("SELECT intent, confidence, count(*) AS n FROM t_classified GROUP BY ALL"))
def cls3(spark, sf):
    return (
        _classified(spark, sf)
        .groupBy("classification.intent", "classification.confidence")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- personal data -----------------------------------------------------------


@query("pii1", (f"SELECT id, {sql.has_card('text')} AS has_card FROM t_messages"))
def pii1(spark, sf):
    return messages(spark, sf).select("id", pii.has_card(F.col("text")).alias("has_card"))


@query("pii2", (f"""
    SELECT id, number, {sql.luhn('number')} AS luhn_valid, {sql.is_card('number')} AS is_card
    FROM (SELECT id, unnest({sql.candidates('text')}) AS number FROM t_messages
          UNION ALL {fixtures.values('cards')})"""))
def pii2(spark, sf):
    found = messages(spark, sf).select(
        "id", F.explode(pii.card_candidates(F.col("text"))).alias("number")
    )
    return found.unionByName(fixtures.frame(spark, "cards")).select(
        "id", "number", pii.luhn_valid(F.col("number")).alias("luhn_valid"),
        pii.is_card(F.col("number")).alias("is_card"),
    )


def _flag(name, check, condition):
    @query(name, (f"SELECT id, {condition} AS hit FROM t_messages"))
    def run(spark, sf):
        return messages(spark, sf).select("id", check(F.col("text")).alias("hit"))

    return run


pii3 = _flag("pii3", pii.has_ssn, sql.matches("text", R.SSN_PATTERN))
pii4 = _flag("pii4", pii.has_password, sql.matches("text", R.PASSWORD_PATTERN))
pii5 = _flag("pii5", pii.has_email, sql.matches("text", R.EMAIL_PATTERN))
pii6 = _flag("pii6", pii.has_phone, sql.has_phone("text"))


@query("pii7", (f"SELECT id, array_to_string(kinds, ', ') AS kinds, len(kinds) AS n "
                 f"FROM (SELECT id, {sql.pii_list('text')} AS kinds FROM t_messages)"))
def pii7(spark, sf):
    found = with_words(messages(spark, sf), "text")
    return found.withColumn("kinds", pii.pii_kinds(F.col("text"), F.col("_words"))).select(
        "id", F.array_join("kinds", ", ").alias("kinds"), F.size("kinds").cast("bigint").alias("n")
    )


# --- hard and soft rules -----------------------------------------------------


def _words(name, words):
    @query(name, (f"SELECT id, {sql.has_any('lc', words)} AS hit FROM t_classified"))
    def run(spark, sf):
        return lowered(spark, sf).select("id", contains_any(lower_text(), words).alias("hit"))

    return run


hrd1 = _words("hrd1", R.HAZARD_WORDS)
hrd2 = _words("hrd2", R.LEGAL_WORDS)
hrd3 = _words("hrd3", R.PROFANITY_WORDS)
hrd4 = _words("hrd4", R.CHURN_WORDS)


@query("hrd5", (f"SELECT id, intent = '{R.RESTRICTED_INTENT}' AS restricted FROM t_classified"))
def hrd5(spark, sf):
    return _classified(spark, sf).select(
        "id", (F.col("classification.intent") == R.RESTRICTED_INTENT).alias("restricted")
    )


@query("sft1", (f"SELECT id, CASE WHEN confidence < 0.85 THEN '{R.REASON_LOW_CONFIDENCE}' || "
                 "printf('%.2f', confidence) || ' < 0.85)' END AS reason FROM t_classified"))
def sft1(spark, sf):
    confidence = F.col("classification.confidence")
    return _classified(spark, sf).select(
        "id",
        F.when(
            confidence < R.CONFIDENCE_THRESHOLD,
            arbiter.low_confidence_reason(confidence, R.CONFIDENCE_THRESHOLD),
        ).alias("reason"),
    )


@query("sft2", (f"SELECT id, {sql.issue('draft_text')} AS issue FROM t_drafts"))
def sft2(spark, sf):
    return drafts(spark, sf).select("id", arbiter.grounding_issue(F.col("draft_text")).alias("issue"))


_CASES = (
    f"(SELECT id, text, intent, confidence, {sql.signed(sql.reply_case('lc'))} AS draft_text "
    f"FROM t_classified UNION ALL {fixtures.values('decisions')})"
)
_DECIDED = sql.decided(_CASES)


def _cases(spark, sf):
    found = _classified(spark, sf).withColumn(
        "draft_text", draft.signed(draft.reply_template(F.col("_lower")))
    )
    inline = fixtures.frame(spark, "decisions").select(
        "id", "text",
        F.struct("intent", "confidence", F.lit("inline").alias("reasoning")).alias("classification"),
        "draft_text",
    )
    rows = found.select("id", "text", "classification", "draft_text").unionByName(inline)
    return arbiter.arbitrate(rows, "text", "classification", "draft_text")


@query("arb1", (
    "SELECT id, text = '' AS empty_text, action, layer, array_to_string(reasons, ' | ') AS reasons, "
    f"is_critical, confidence_passed, grounding_passed, sanitized_draft FROM ({_DECIDED})"))
def arb1(spark, sf):
    return _cases(spark, sf).select(
        "id", (F.col("text") == "").alias("empty_text"),
        "decision.action", "decision.layer",
        F.array_join("decision.reasons", " | ").alias("reasons"),
        "decision.is_critical", "decision.confidence_passed", "decision.grounding_passed",
        "decision.sanitized_draft",
    )


@query("rte1", (
    "SELECT id, text = '' AS empty_text, action AS final_action, CASE WHEN action = 'AUTO_HANDLE' "
    f"THEN draft_text ELSE '{R.ROUTED_PREFIX}' || array_to_string(reasons, '; ') END "
    f"AS final_response FROM ({_DECIDED})"))
def rte1(spark, sf):
    return arbiter.route(_cases(spark, sf)).select(
        "id", (F.col("text") == "").alias("empty_text"), "final_action", "final_response"
    )


@query("triage_rules", (
    "SELECT action, layer, is_critical, count(*) AS n FROM ("
    + sql.decided("(SELECT id, text, intent, confidence, CAST(NULL AS VARCHAR) AS draft_text "
                  "FROM t_classified)")
    + ") GROUP BY ALL"))
def triage_rules(spark, sf):
    """The smallest whole job: classify, arbitrate, count."""
    return (
        rules_only(messages(spark, sf))
        .groupBy("decision.action", "decision.layer", "decision.is_critical")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- message ids -------------------------------------------------------------


@query("src5", ("SELECT d.doc_id, coalesce(CAST(l.doc_id AS VARCHAR), "
                 "'twt_' || substr(sha256(text), 1, 8)) AS message_id "
                 "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"))
def src5(spark, sf):
    given = table(spark, sf, "labels").select("doc_id", F.col("doc_id").alias("key"))
    return table(spark, sf, "documents").join(given, "doc_id", "left").select(
        "doc_id", message_id(F.col("key"), F.col("text")).alias("message_id")
    )


# --- drafts ------------------------------------------------------------------

_CONTEXT = (
    "SELECT query_id AS id, string_agg('\n--- Historical Resolution #' || rank || ' (' || intent "
    "|| ') ---\nCustomer: ' || query_text || '\n" + R.CONTEXT_AGENT + ": ' || resolution_text "
    "|| '\n', '' ORDER BY rank) AS context, string_agg(tweet_id, ',' ORDER BY rank) AS sources "
    "FROM t_past_fused JOIN t_resolutions USING (doc_id) WHERE rank <= 3 GROUP BY query_id"
)
sql.cte("t_context", _CONTEXT)
sql.cte(
    "t_drafted",
    "SELECT i.id, i.text, i.intent, i.confidence, i.reasoning, i.lc, c.context, c.sources, "
    + sql.signed(sql.reply_case("lower(i.text || '\n' || i.intent || '\n' || c.context)"))
    + f" AS draft_text FROM ({sql.classified('t_inbound')}) i JOIN t_context c USING (id)",
)


def _contexts(spark, sf):
    corpus = resolutions(spark, sf)
    hits = with_hits(
        inbound(spark, sf), searchable(corpus, "doc_id", "query_text", "embedding"),
        embedding="embedding",
    )
    return attach_attributes(hits, corpus, ATTRIBUTES)


@query("drf1", ("SELECT id, md5(context) AS context_md5, length(context) AS context_length, "
                 "sources FROM t_context"))
def drf1(spark, sf):
    context = draft.grounding_context(F.col("retrieved"))
    return _contexts(spark, sf).select(
        "id", F.md5(context.cast("binary")).alias("context_md5"),
        F.length(context).cast("bigint").alias("context_length"),
        F.array_join(draft.source_ids(F.col("retrieved")), ",").alias("sources"),
    )


@query("drf2", ("SELECT id, intent, draft_text FROM t_drafted"))
def drf2(spark, sf):
    drafted = with_drafts(
        inbound(spark, sf), resolutions(spark, sf), embedding="embedding"
    )
    return drafted.select("id", "classification.intent", "draft.draft_text")


@query("drf3", (f"SELECT id, md5({sql.signed('draft_text')}) AS signed_md5 FROM t_drafts"))
def drf3(spark, sf):
    return drafts(spark, sf).select(
        "id", F.md5(draft.signed(F.col("draft_text")).cast("binary")).alias("signed_md5")
    )


# --- judge -------------------------------------------------------------------

_JUDGED = sql.judged("t_replies", "query", "response")


def _judged(spark, sf):
    return judge.judge(replies(spark, sf))


@query("jdg1", ("SELECT id, CASE fail WHEN 1 THEN 'severe' WHEN 2 THEN 'poor' END AS guard, "
                 f"rationale FROM ({_JUDGED})"))
def jdg1(spark, sf):
    return _judged(spark, sf).select(
        "id",
        judge.guard(judge.is_hazard(F.lower("query")), F.lower("response")).alias("guard"),
        "judgement.rationale",
    )


def _score(name, field):
    @query(name, (f"SELECT id, {field} FROM ({_JUDGED})"))
    def run(spark, sf):
        column = F.col(f"judgement.{field}")
        return _judged(spark, sf).select(
            "id", (column if field == "overall" else column.cast("bigint")).alias(field)
        )

    return run


jdg2 = _score("jdg2", "grounding")
jdg3 = _score("jdg3", "tone")
jdg4 = _score("jdg4", "actionability")
jdg5 = _score("jdg5", "overall")


# --- baselines ---------------------------------------------------------------


@query("bsl1", (f"SELECT id, '{R.CONSTANT_INTENT}' AS predicted_intent, 'ESCALATE' AS action, "
                 f"'{R.CONSTANT_REPLY}' AS response, '{R.CONSTANT_REASON}' AS escalation_reason "
                 "FROM t_messages"))
def bsl1(spark, sf):
    return with_baselines(messages(spark, sf)).select("id", "baseline_1.*")


@query("bsl2", (f"SELECT id, intent AS predicted_intent, 'AUTO_HANDLE' AS action, "
                 f"{sql.reply_case('lc')} AS response, CAST(NULL AS VARCHAR) AS escalation_reason "
                 "FROM t_classified"))
def bsl2(spark, sf):
    return with_baselines(messages(spark, sf)).select("id", "baseline_2.*")
