"""Chat formatting: a state machine over roles, and segments with loss flags.

A declarative template gives the strings that mark a turn, the roles whose texts
are learned, the control strings that texts must not contain as they are, and
the state machine's moves.  A turn is

    open, escaped role, middle, escaped text, close

as segments, of which only the text of a learned role is under the loss mask.
Escaping doubles backslashes and puts one after the first character of every
control string; dropping each escaping backslash undoes it, so a formatted
conversation reads back turn by turn.

A conversation becomes one string, so its turns meet in one row; that is the
result itself.  The machine's state is the role before, which a window gives.

Defined results: turns are ordered by turn, role and text, null first; a null
role or text is empty; an unknown role is formatted like any other and makes the
order invalid from there; repeated rows are turns of their own; a null
``conv_id`` is one conversation; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Template(NamedTuple):
    open: str
    middle: str
    close: str
    learned: tuple[str, ...]
    controls: tuple[str, ...]
    moves: Mapping[str, tuple[str, ...]]  # state (the role before, or START) to roles


START = ""
CHAT = Template(
    open="<|im_start|>",
    middle="<|im_sep|>",
    close="<|im_end|>",
    learned=("assistant",),
    controls=("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]"),
    moves={
        START: ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    },
)
EXAMPLE = "</s>[INST] ok [/INST]"


def escape(text: Column, template: Template = CHAT) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in template.controls:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_segments(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per turn: conv_id, its place from 0, whether its move is allowed, its segments."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select(
        "conv_id",
        "turn",
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    ).select(
        "*",
        (F.row_number().over(order) - 1).alias("place"),
        F.lag(F.coalesce("role", F.lit(""))).over(order).alias("before"),
    )
    role = F.coalesce("role", F.lit(""))
    state = F.when(F.col("place") == 0, F.lit(START)).otherwise(F.col("before"))
    allowed = F.lit(False)
    for from_, roles in template.moves.items():
        at = F.col("place") == 0 if from_ == START else (F.col("place") > 0) & (state == from_)
        allowed = allowed | (at & role.isin(*roles))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    return rows.select(
        "conv_id",
        "place",
        allowed.alias("allowed"),
        F.array(
            segment(
                F.concat(F.lit(template.open), escape(role, template), F.lit(template.middle)), no
            ),
            segment(
                escape(F.coalesce("text", F.lit("")), template), role.isin(*template.learned)
            ),
            segment(F.lit(template.close), no),
        ).alias("segments"),
    )


def format_conversations(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per conversation: its segments, the formatted string, and the first bad turn or null."""
    rows = turn_segments(turns, template).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "segments"))).alias("turns"),
        F.min(F.when(~F.col("allowed"), F.col("place"))).alias("first_bad_turn"),
    )
    segments = F.flatten(F.transform("turns", lambda t: t["segments"]))
    return rows.select("conv_id", segments.alias("segments"), "first_bad_turn").select(
        "*", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted")
    )


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    parts = F.split(formatted, re.escape(template.open))

    def turn(part: Column) -> Column:
        text = F.substring_index(F.substring_index(part, template.middle, -1), template.close, 1)
        return F.struct(
            unescape(F.substring_index(part, template.middle, 1)).alias("role"),
            unescape(text).alias("text"),
        )

    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn)


def read_learned(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescape(s["text"])), "")


def digest(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """What reading the formatted conversations back gives."""
    read = conversations.select(
        "*",
        read_turns(F.col("formatted"), template).alias("_turns"),
        read_learned(F.col("segments")).alias("_learned"),
    )
    lines = F.array_join(
        F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("_learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("_learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.col("first_bad_turn").cast("bigint").alias("first_bad_turn"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -1, formatted and read back."""
    turns = spark.read.parquet(os.path.join(sf_dir, "conversations.parquet"))
    turns = turns.select("conv_id", "turn", "role", "text")
    example = spark.createDataFrame(
        [(-1, 0, "user", EXAMPLE), (-1, 1, "assistant", EXAMPLE)], turns.schema
    )
    return digest(format_conversations(turns.unionByName(example)))


def _sql_escape(column: str, template: Template = CHAT) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in template.controls:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


_MARKS = len(CHAT.open) + len(CHAT.middle) + len(CHAT.close)
_MOVES_SQL = " OR ".join(
    f"({'place = 0' if s == START else f'place > 0 AND before = {s!r}'} AND role IN "
    f"({', '.join(repr(r) for r in roles)}))"
    for s, roles in CHAT.moves.items()
)
_LEARNED_SQL = f"role IN ({', '.join(repr(r) for r in CHAT.learned)})"
OP6_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, role AS r, text AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{EXAMPLE}' UNION ALL SELECT -1, 1, 'assistant', '{EXAMPLE}'),
t AS (SELECT conv_id, coalesce(r, '') AS role, coalesce(x, '') AS text,
             row_number() OVER o - 1 AS place, lag(coalesce(r, '')) OVER o AS before
      FROM c WINDOW o AS (PARTITION BY conv_id
                          ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(CASE WHEN {_LEARNED_SQL} THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN {_LEARNED_SQL} THEN text END, '' ORDER BY place), ''))
         AS loss_sha256,
       sum({_MARKS} + length({_sql_escape('role')}) + length({_sql_escape('text')}))::BIGINT
         AS formatted_chars,
       min(CASE WHEN NOT ({_MOVES_SQL}) THEN place END)::BIGINT AS first_bad_turn
FROM t GROUP BY conv_id
"""
