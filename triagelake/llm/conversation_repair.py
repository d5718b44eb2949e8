"""Repair of conversations: the cheapest edits that make the roles alternate.

A conversation's rows, by turn, are kept (0), re-roled to user or assistant (1)
or deleted (2), and empty turns are inserted (5), so that the role initials read
``(s?(ua)+)?``.  Blank rows and repeats of an earlier row must go; a truncated row
that stays costs 5 more.  Of equal costs the ASCII-least audit (the initials of
the edits: K, R, D, I) is taken.

The state of the pattern (start, after s, after u, after a) fixes the role of a
re-roled or inserted turn, so the audit says everything.  Rows stream past four
states; a state's best audit is a node of a shared tree (``audit_trail``), ties
are settled by the longest common prefix.  Each state also carries the SHA-256 of
the text it has repaired so far.  So one pass over the sorted rows does, and the
texts of a conversation are never held together: the memory is one byte per row
for the audit, and a node per edit in which the states still differ (in most
conversations the last few, at most two or three per row).

Rows are shuffled once, by conversation: a digest of a conversation's whole text,
and its one audit string, are sequential by nature.  The shuffle and the sorts
spill; rows pass the Python worker batch by batch.

Defined results: a null role or text is one space; turns are ordered null first,
equal turns by role and text, so repeated rows are neighbours and all but the
first are duplicates; a role that does not start with s, u or a cannot be kept as
it is; a null ``conv_id`` is one conversation; a conversation that has lost all
rows costs nothing; very long texts are hashed as they pass; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.llm.audit_trail import Audits
from triagelake.llm.span_crc import crc32_sql
from triagelake.llm.workers import prepare

KEEP, REROLE, DELETE, INSERT, STAYS_TRUNCATED = 0, 1, 2, 5, 5
SOUND, BLANK, DUPLICATE, TRUNCATED, LOST = range(5)
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: Of a state: the state a kept row with this initial leads to; and a new turn's.
KEPT = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER,
    (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
FLUSH_AT = 4096  # nodes of a tree
SPACES = " \t\n\x0b\f\r"
RESULTS = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, cost bigint, audit string, repaired_sha256 string"
)


class _Path:
    """The cheapest way to a state: cost, audit, digest of what is repaired."""

    __slots__ = ("cost", "node", "digest")

    def __init__(self, cost: int, node: int, digest):
        self.cost, self.node, self.digest = cost, node, digest


def _extended(digest, first: bool, role: str, text: str):
    out = digest.copy()
    out.update(("" if first else "\n").encode() + role.encode() + b":")
    out.update(text.encode())
    return out


class Repair:
    """One conversation, row by row."""

    def __init__(self) -> None:
        self.audits = Audits()
        self.flush_at = FLUSH_AT
        self.paths: dict[int, _Path] = {START: _Path(0, Audits.ROOT, hashlib.sha256())}
        self._insert()
        self.counts = [0] * 5
        self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def _better(self, best: dict, state: int, cost: int, from_: int, edit: str, make) -> None:
        """Take a way to ``state`` if it is cheaper than, or equal and smaller than, the best."""
        old = best.get(state)
        if old is not None and old[0] < cost:
            return
        node = self.audits.append(self.paths[from_].node, edit)
        if old is None or cost < old[0] or self.audits.before(node, old[1]):
            best[state] = (cost, node, make)

    def _insert(self) -> None:
        """Empty turns where the row stands: two at most are of use."""
        for targets in ((USER,), (ASSISTANT,)):
            best = {s: (p.cost, p.node, None) for s, p in self.paths.items()}
            for from_ in STATES:
                if from_ in self.paths and NEXT[from_] in targets:
                    to = NEXT[from_]
                    make = (from_, ROLE[to], "")
                    self._better(best, to, self.paths[from_].cost + INSERT, from_, "I", make)
            self._move(best)

    def _move(self, best: dict) -> None:
        new = {}
        for state, (cost, node, make) in best.items():
            if make is None:
                new[state] = self.paths[state]
            elif len(make) == 1:  # deleted
                new[state] = _Path(cost, node, self.paths[make[0]].digest)
            else:
                from_, role, text = make
                digest = _extended(self.paths[from_].digest, from_ == START, role, text)
                new[state] = _Path(cost, node, digest)
        self.paths = new

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None:
            if self.high is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        more = STAYS_TRUNCATED if fault == TRUNCATED else 0
        best: dict = {}
        for from_ in STATES:
            path = self.paths.get(from_)
            if path is None:
                continue
            self._better(best, from_, path.cost + DELETE, from_, "D", (from_,))
            if fault in (BLANK, DUPLICATE):
                continue
            to = KEPT.get((from_, initial))
            if to is not None:
                self._better(best, to, path.cost + KEEP + more, from_, "K", (from_, role, text))
            to = NEXT[from_]
            make = (from_, ROLE[to], text)
            self._better(best, to, path.cost + REROLE + more, from_, "R", make)
        self._move(best)
        self._insert()
        self._drop_beaten()
        if len(self.audits) > self.flush_at:
            held = list(self.paths.values())
            for path, node in zip(held, self.audits.flush([p.node for p in held]), strict=True):
                path.node = node
            self.flush_at = max(FLUSH_AT, 2 * len(self.audits))

    def _drop_beaten(self) -> None:
        """Leave out states that cannot win any more.

        Whatever follows from the start also follows after an assistant turn, but
        for a kept system row, which can be deleted there for 2; what follows a
        leading system row follows after an assistant turn as it is.
        """
        least = self.paths[ASSISTANT].cost
        for state, margin in ((START, DELETE), (SYSTEM, 0)):
            if state in self.paths and self.paths[state].cost > least + margin:
                del self.paths[state]

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
        ends = [self.paths[s] for s in (START, ASSISTANT) if s in self.paths]
        end = ends[0]
        for other in ends[1:]:
            if other.cost < end.cost or (
                other.cost == end.cost and self.audits.before(other.node, end.node)
            ):
                end = other
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return (
            gaps, *self.counts[BLANK:LOST], self.illegal, end.cost,
            self.audits.text(end.node), end.digest.hexdigest(),
        )


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` after the test's damage; ``lost`` marks those it drops.

    Nulls of role and text become one space; the CRC-32 of ``conv_id:turn`` modulo
    20 decides: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3
    repeats it, 4 makes its role user.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" "))
                              for c in ("conv_id", "turn")])
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(name.cast("binary")) % 20).cast("int").alias("_kind"),
    )
    kind, text = F.col("_kind"), F.col("text")
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind <= 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", ""))
        .otherwise(text).alias("text"),
        (kind == 0).alias("lost"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` shuffled by conversation, in order, each with its first ``fault``.

    ``rows``: conv_id, turn, role, text, none of the last two null, and ``lost``.
    The place among equal rows needs a sort within the same partitions, no shuffle.
    """
    dealt = rows.repartition("conv_id")
    alike = Window.partitionBy("conv_id", "lost", "role", "text").orderBy("turn")
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    last: Column = F.substring(bare, -1, 1)
    fault = (
        F.when(F.col("lost"), LOST)
        .when(F.length(bare) == 0, BLANK)
        .when(F.row_number().over(alike) > 1, DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED)
        .otherwise(SOUND)
    )
    judged = dealt.select("conv_id", "turn", "role", "text", fault.cast("int").alias("fault"))
    return judged.sortWithinPartitions(  # of equal rows the first stands before its repeats
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RESULTS.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    done: list[tuple] = []
    current, repair = None, None

    def batch() -> pa.RecordBatch:
        columns = zip(*done, strict=True)
        out = pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
        )
        done.clear()
        return out

    for rows in batches:
        # row by row: a batch's texts are read one at a time
        for k, (conv, turn, fault) in enumerate(
            zip(*(rows.column(c).to_pylist() for c in ("conv_id", "turn", "fault")), strict=True)
        ):
            if repair is None or conv != current:
                if repair is not None:
                    done.append((current, *repair.result()))
                    if len(done) >= 1000:
                        yield batch()
                current, repair = conv, Repair()
            if fault == LOST:
                continue
            role, text = rows.column("role")[k].as_py(), rows.column("text")[k].as_py()
            repair.row(turn, role, text, fault)
    if repair is not None:
        done.append((current, *repair.result()))
        yield batch()


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, cost, audit, repaired_sha256.

    ``rows``: conv_id, turn, role, text and, if wanted, ``lost`` (rows that only
    name their conversation).
    """
    prepare(rows.sparkSession)
    lost = F.col("lost") if "lost" in rows.columns else F.lit(False)
    plain = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        F.coalesce(lost, F.lit(False)).alias("lost"),
    )
    return faults(plain).mapInArrow(_stream, RESULTS)


def apply_audits(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id, place, role, text, edit`` (K, R or I).

    ``rows`` as given to ``repair_conversations``, ``repaired`` as it returned.
    Places count from 0; deleted rows are gone.
    """
    lost = F.coalesce(F.col("lost"), F.lit(False)) if "lost" in rows.columns else F.lit(False)
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    given = (
        rows.filter(~lost)
        .select(F.col("conv_id").cast("bigint").alias("conv_id"),
                F.col("turn").cast("bigint").alias("turn"), *texts)
        .select("conv_id", "role", "text", F.row_number().over(order).alias("row"))
    )
    upto = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    edits = (
        repaired.filter(F.length("audit") > 0)
        .select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit"))
        .filter(F.length("edit") > 0)
        .select(
            "conv_id", "edit",
            F.when(F.col("edit") != "I", F.sum((F.col("edit") != "I").cast("int")).over(upto))
            .alias("row"),
            (F.sum((F.col("edit") != "D").cast("int")).over(upto) - 1).alias("place"),
        )
        .filter(F.col("edit") != "D")
    )
    e, g = edits.alias("e"), given.alias("g")
    met = e.join(
        g, F.col("e.conv_id").eqNullSafe(F.col("g.conv_id")) & (F.col("e.row") == F.col("g.row")),
        "left",
    )
    # the pattern alternates, from the user on: a leading system turn shifts it by one
    leads = F.max(
        F.when((F.col("e.place") == 0) & (F.col("e.edit") == "K"), F.col("g.role").startswith("s"))
    ).over(Window.partitionBy("e.conv_id"))
    shift = F.when(leads, 1).otherwise(0)
    role = F.when((F.col("e.place") - shift) % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
    return met.select(
        F.col("e.conv_id").alias("conv_id"),
        F.col("e.place").cast("bigint").alias("place"),
        F.when(F.col("e.edit") == "K", F.col("g.role")).otherwise(role).alias("role"),
        F.coalesce("g.text", F.lit("")).alias("text"),
        F.col("e.edit").alias("edit"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit and digest of every conversation of ``conversations``, damaged first."""
    turns = spark.read.parquet(os.path.join(sf_dir, "conversations.parquet"))
    return repair_conversations(damaged(turns.select("conv_id", "turn", "role", "text")))


_MOVES_SQL = """
e(p, q, n, a, x) AS (VALUES (0, 0, 0, '', NULL), (1, 1, 0, '', NULL), (2, 2, 0, '', NULL),
  (3, 3, 0, '', NULL), (0, 2, 1, 'I', 'user:'), (1, 2, 1, 'I', 'user:'), (3, 2, 1, 'I', 'user:'),
  (2, 3, 1, 'I', 'assistant:'), (0, 3, 2, 'II', 'user:' || chr(10) || 'assistant:'),
  (1, 3, 2, 'II', 'user:' || chr(10) || 'assistant:')),
v(p, q, a, m, w) AS (VALUES (0, 0, 'D', NULL, NULL), (1, 1, 'D', NULL, NULL), (2, 2, 'D', NULL, NULL),
  (3, 3, 'D', NULL, NULL), (0, 1, 'K', 's', NULL), (0, 2, 'K', 'u', NULL), (1, 2, 'K', 'u', NULL),
  (3, 2, 'K', 'u', NULL), (2, 3, 'K', 'a', NULL), (0, 2, 'R', NULL, 'user'), (1, 2, 'R', NULL, 'user'),
  (3, 2, 'R', NULL, 'user'), (2, 3, 'R', NULL, 'assistant'))"""
_BARE_SQL = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"
OP11_SQL = f"""
WITH RECURSIVE k AS MATERIALIZED (
  SELECT row_number() OVER () AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
h AS MATERIALIZED (
  SELECT c, row_number() OVER () AS u, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("(coalesce(t.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS z
  FROM conversations t JOIN k ON k.conv_id IS NOT DISTINCT FROM t.conv_id),
d AS (
  SELECT c, u, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN z = 1 THEN '' WHEN z = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN z = 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE z <> 0),
r AS MATERIALIZED (
  SELECT c, turn, role, text, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before,
         CASE WHEN {_BARE_SQL} = '' THEN 1
              WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, u, copy) > 1 THEN 2
              WHEN right({_BARE_SQL}, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM d WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, u, copy)),
g AS MATERIALIZED (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM r GROUP BY c),
{_MOVES_SQL},
s AS (
  SELECT c, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, NULL::VARCHAR AS body FROM k
  UNION ALL
  SELECT s.c, r.i, v.q,
         s.cost + {INSERT} * e.n + CASE v.a WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} ELSE {KEEP} END
           + CASE WHEN r.fault = 3 AND v.a <> 'D' THEN {STAYS_TRUNCATED} ELSE 0 END AS cost,
         s.audit || e.a || v.a AS audit,
         nullif(concat_ws(chr(10), s.body, e.x,
                          CASE WHEN v.a <> 'D' THEN coalesce(v.w, r.role) || ':' || r.text END), '') AS body
  FROM s JOIN e ON e.p = s.q JOIN v ON v.p = e.q JOIN r ON r.c = s.c AND r.i = s.i + 1
  WHERE (v.a = 'D' OR r.fault NOT IN (1, 2)) AND (v.m IS NULL OR v.m = left(r.role, 1))
  QUALIFY row_number() OVER (PARTITION BY s.c, v.q ORDER BY
    s.cost + {INSERT} * e.n + CASE v.a WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} ELSE {KEEP} END
      + CASE WHEN r.fault = 3 AND v.a <> 'D' THEN {STAYS_TRUNCATED} ELSE 0 END, s.audit || e.a || v.a) = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       s.cost + {INSERT} * e.n AS cost, s.audit || e.a AS audit,
       sha256(concat_ws(chr(10), s.body, e.x)) AS repaired_sha256
FROM s JOIN e ON e.p = s.q JOIN k ON k.c = s.c LEFT JOIN g ON g.c = s.c
WHERE s.i = coalesce(g.n, 0) AND e.q IN (0, 3)
QUALIFY row_number() OVER (PARTITION BY s.c ORDER BY s.cost + {INSERT} * e.n, s.audit || e.a) = 1
"""
