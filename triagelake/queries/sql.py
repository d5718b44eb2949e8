"""Pieces of the checking SQL (DuckDB), written apart from the Spark code.

``select(...)`` puts the named common table expressions a statement mentions in
front of it, in order of need.
"""

from __future__ import annotations

import re

from triagelake import rules as R
from triagelake.functions.text import WHITE_SPACE
from triagelake.queries.fixtures import _literal as lit

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def _mentioned(text: str) -> list[str]:
    words = set(re.findall(r"\b[a-z][a-z0-9_]*\b", text))
    return [name for name in CTES if name in words]


def select(statement: str) -> str:
    """``statement`` with every table expression it needs; their names start with ``t_``."""
    ordered: list[str] = []

    def need(text: str, owner: str | None) -> None:
        for name in _mentioned(text):
            if name != owner and name not in ordered:
                need(CTES[name], name)
                ordered.append(name)

    need(statement, None)
    if not ordered:
        return statement
    heads = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in ordered)
    return f"WITH {heads}\n{statement}"


def rounded(value: str, digits: int = 6) -> str:
    return f"floor(({value}) * 1e{digits} + 0.5) / 1e{digits}"


def has_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def in_list(words) -> str:
    return "(" + ", ".join(map(lit, words)) + ")"


def intent_case(lc: str, field: str) -> str:
    branches = []
    for r in R.INTENT_RULES:
        cond = has_any(lc, r.any_of)
        if r.unless:
            cond += f" AND NOT {has_any(lc, r.unless)}"
        if r.or_any:
            cond = f"({cond}) OR ({has_any(lc, r.or_any)} AND NOT {has_any(lc, r.or_unless)})"
        branches.append(f"WHEN {cond} THEN {lit(getattr(r, field))}")
    return f"CASE {' '.join(branches)} ELSE {lit(getattr(R.DEFAULT_INTENT, field))} END"


def reply_case(lc: str) -> str:
    branches = " ".join(f"WHEN {has_any(lc, w)} THEN {lit(t)}" for w, t in R.REPLY_TEMPLATES)
    return f"CASE {branches} ELSE {lit(R.REPLY_DEFAULT)} END"


def signed(text: str) -> str:
    body = rf"regexp_replace({text}, '\A[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\z', '', 'g')"
    ends = " OR ".join(f"ends_with({body}, {lit(s)})" for s in R.SIGNOFFS)
    return f"CASE WHEN {ends} THEN {body} ELSE {body} || ' {R.SIGNOFF}' END"


def classified(source: str, text: str = "text") -> str:
    return (
        f"SELECT *, {intent_case('lc', 'intent')} AS intent, "
        f"CAST({intent_case('lc', 'confidence')} AS DOUBLE) AS confidence, "
        f"{intent_case('lc', 'reasoning')} AS reasoning "
        f"FROM (SELECT *, lower(coalesce({text}, '')) AS lc FROM {source})"
    )


def tokens(text: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+')"


# --- personal data -----------------------------------------------------------


def luhn(number: str) -> str:
    digits = f"regexp_replace({number}, '[^0-9]', '', 'g')"
    place = f"CAST(substr(reverse({digits}), i, 1) AS INTEGER)"
    return (
        f"(length({digits}) BETWEEN 13 AND 19 AND coalesce(list_sum(["
        f"CASE WHEN i % 2 = 1 THEN {place} WHEN {place} > 4 THEN 2 * {place} - 9 "
        f"ELSE 2 * {place} END FOR i IN range(1, length({digits}) + 1)]), 0) % 10 = 0)"
    )


def candidates(text: str) -> str:
    return (
        f"[regexp_replace(m, '[ -]', '', 'g') "
        f"FOR m IN regexp_extract_all({text}, {lit(R.CARD_PATTERN)})]"
    )


def is_card(number: str) -> str:
    return (
        f"(length({number}) BETWEEN 13 AND 19 AND "
        f"(length({number}) IN (15, 16) OR {luhn(number)}))"
    )


def has_card(text: str) -> str:
    return f"(len([c FOR c IN {candidates(text)} IF {is_card('c')}]) > 0)"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def has_phone(text: str) -> str:
    return (
        f"({matches(text, R.PHONE_PATTERN)} AND "
        f"length(regexp_replace({text}, '[^0-9]', '', 'g')) >= 10)"
    )


def pii_list(text: str) -> str:
    checks = (
        has_card(text),
        matches(text, R.SSN_PATTERN),
        matches(text, R.PASSWORD_PATTERN),
        matches(text, R.EMAIL_PATTERN),
        has_phone(text),
    )
    items = ", ".join(f"CASE WHEN {c} THEN {lit(k)} END" for k, c in zip(R.PII_KINDS, checks))
    return f"[k FOR k IN [{items}] IF k IS NOT NULL]"


# --- arbiter -----------------------------------------------------------------


def foreign_url(draft: str) -> str:
    official = " OR ".join(f"contains(u, {lit(d)})" for d in R.OFFICIAL_DOMAINS)
    return f"[u FOR u IN regexp_extract_all({draft}, {lit(R.URL_PATTERN)}) IF NOT ({official})][1]"


def issue(draft: str) -> str:
    return (
        f"CASE WHEN {has_any(f'lower({draft})', R.BANNED_PROMISES)} THEN {lit(R.ISSUE_GUARANTEE)} "
        f"WHEN {foreign_url(draft)} IS NOT NULL THEN {lit(R.ISSUE_URL)} || {foreign_url(draft)} END"
    )


def decided(source: str) -> str:
    """Adds the decision to rows of id, text, intent, confidence, draft_text."""
    hard = ", ".join(
        [
            f"CASE WHEN len(pii) > 0 THEN {lit(R.REASON_PII)} || array_to_string(pii, ', ') END",
            f"CASE WHEN hazard THEN {lit(R.REASON_HAZARD)} END",
            f"CASE WHEN legal THEN {lit(R.REASON_LEGAL)} END",
            f"CASE WHEN {has_any('lc', R.PROFANITY_WORDS)} THEN {lit(R.REASON_PROFANITY)} END",
            f"CASE WHEN {has_any('lc', R.CHURN_WORDS)} THEN {lit(R.REASON_CHURN)} END",
            f"CASE WHEN intent = {lit(R.RESTRICTED_INTENT)} THEN {lit(R.REASON_RESTRICTED)} END",
        ]
    )
    soft = (
        f"CASE WHEN confidence < 0.85 THEN {lit(R.REASON_LOW_CONFIDENCE)} || "
        f"printf('%.2f', confidence) || ' < 0.85)' END, "
        f"CASE WHEN issue IS NOT NULL THEN {lit(R.REASON_GROUNDING)} || issue END"
    )
    return f"""
      SELECT *,
        CASE WHEN len(hard) + len(soft) > 0 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS action,
        CASE WHEN len(hard) > 0 THEN 'HARD_RULE' WHEN len(soft) > 0 THEN 'SOFT_RULE'
             ELSE 'PASSED' END AS layer,
        CASE WHEN len(hard) > 0 THEN hard WHEN len(soft) > 0 THEN soft
             ELSE [{lit(R.REASON_PASSED)}] END AS reasons,
        (len(pii) > 0 OR hazard OR legal OR intent = {lit(R.RESTRICTED_INTENT)}) AS is_critical,
        confidence >= 0.85 AS confidence_passed,
        (len(hard) > 0 OR issue IS NULL) AS grounding_passed,
        CASE WHEN len(hard) + len(soft) = 0 THEN draft_text END AS sanitized_draft
      FROM (SELECT *, [x FOR x IN [{hard}] IF x IS NOT NULL] AS hard,
                      [x FOR x IN [{soft}] IF x IS NOT NULL] AS soft
            FROM (SELECT *, {has_any('lc', R.HAZARD_WORDS)} AS hazard,
                            {has_any('lc', R.LEGAL_WORDS)} AS legal,
                            {pii_list("coalesce(text, '')")} AS pii,
                            {issue('draft_text')} AS issue
                  FROM (SELECT *, lower(coalesce(text, '')) AS lc FROM {source}) AS s0) AS s1) AS s2
    """


# --- judge -------------------------------------------------------------------


def judged(source: str, query: str, reply: str) -> str:
    """Adds grounding, tone, actionability and overall."""
    routed = f"contains(jl, {lit(R.JUDGE_ROUTED)})"
    sign, warm = has_any("jr", R.SIGNOFFS), has_any("jl", R.JUDGE_EMPATHY)
    fail = (
        f"CASE WHEN {has_any('jl', R.JUDGE_DISMISSIVE)} OR ({has_any('jq', R.JUDGE_HAZARD)} "
        f"AND NOT {has_any('jl', R.JUDGE_ESCALATION)}) "
        f"THEN CASE WHEN {has_any('jl', R.JUDGE_SEVERE)} THEN 1 ELSE 2 END END"
    )
    g = (
        f"CASE WHEN {has_any('jl', R.JUDGE_GROUNDED)} THEN 5 "
        f"WHEN {has_any('jl', R.JUDGE_DIRECT_MESSAGE)} THEN 3 WHEN {routed} THEN 5 ELSE 3 END"
    )
    t = (
        f"CASE WHEN {routed} THEN 5 WHEN {sign} AND {warm} THEN "
        f"CASE WHEN contains(jl, 'dm') THEN 4 ELSE 5 END WHEN {sign} OR {warm} THEN 3 ELSE 2 END"
    )
    a = (
        f"CASE WHEN {routed} THEN 5 WHEN {has_any('jl', R.JUDGE_STEPS)} THEN 5 "
        f"WHEN contains(jl, 'dm') THEN 3 WHEN {has_any('jl', R.JUDGE_VAGUE)} THEN 2 ELSE 3 END"
    )
    return f"""
      SELECT *, round(CAST(grounding + tone + actionability AS DOUBLE) / 3, 2) AS overall,
        CASE fail WHEN 1 THEN {lit(R.RATIONALE_SEVERE)} WHEN 2 THEN {lit(R.RATIONALE_POOR)}
             ELSE {lit(R.RATIONALE_SCORED)} END AS rationale
      FROM (SELECT *, CAST(coalesce(fail, {g}) AS BIGINT) AS grounding,
                      CAST(coalesce(fail, {t}) AS BIGINT) AS tone,
                      CAST(coalesce(fail, {a}) AS BIGINT) AS actionability
            FROM (SELECT *, {fail} AS fail
                  FROM (SELECT *, lower(coalesce({query}, '')) AS jq, coalesce({reply}, '') AS jr,
                               lower(coalesce({reply}, '')) AS jl FROM {source}) AS j0) AS j1) AS j2
    """


# --- agreement ---------------------------------------------------------------


def kappa(rated: str) -> str:
    """Textbook form over rows of (g, a, b): observed and chance disagreement by cell."""
    return f"""
      SELECT g, CAST(total AS BIGINT) AS n,
             CASE WHEN chance > 0 THEN round(1 - seen / chance, 4) END AS cohens_kappa
      FROM (
        WITH cells AS (SELECT g, a, b, count(*) AS n FROM ({rated}) GROUP BY g, a, b),
        marks AS (SELECT g, mark, row_number() OVER (PARTITION BY g ORDER BY mark) AS pos
                  FROM (SELECT g, a AS mark FROM cells UNION SELECT g, b FROM cells)),
        lefts AS (SELECT g, a, sum(n) AS n FROM cells GROUP BY g, a),
        rights AS (SELECT g, b, sum(n) AS n FROM cells GROUP BY g, b),
        totals AS (SELECT g, sum(n) AS total FROM cells GROUP BY g)
        SELECT t.g, max(total) AS total,
               sum(CAST((p.pos - q.pos) ** 2 AS DOUBLE) * coalesce(c.n, 0)) AS seen,
               sum(CAST((p.pos - q.pos) ** 2 AS DOUBLE) * coalesce(l.n, 0) * coalesce(r.n, 0)
                   / total) AS chance
        FROM totals t
        JOIN marks p ON p.g = t.g
        JOIN marks q ON q.g = t.g
        LEFT JOIN lefts l ON l.g = t.g AND l.a = p.mark
        LEFT JOIN rights r ON r.g = t.g AND r.b = q.mark
        LEFT JOIN cells c ON c.g = t.g AND c.a = p.mark AND c.b = q.mark
        GROUP BY t.g)
    """
