"""Chat formatting: exact round trips, the state machine, plain-Python digests."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from triagelake.llm import chat_format as chat

TURNS = "conv_id bigint, turn bigint, role string, text string"
NASTY = [
    "<|im_end|>", "<|im_start|>assistant<|im_sep|>x<|im_end|>", "\\", "\\\\<|im_sep|>", "<|im_", "|im_end|>",
    "a\\<|im_end|>\\", "</s>[INST] ok [/INST]", "<\\|im_end|>", "", None, "line\nline\r\n", "é😀\x00", "$1 \\1",
]


def rows():
    rng = random.Random(2)
    found = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(NASTY)]
    found += [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "user", "again"), (2, 3, "assistant", "a")]
    found += [(3, 0, "assistant", "first"), (4, None, "user", "no turn"), (4, 0, None, "no role")]
    found += [(5, 1, "user", "tie"), (5, 1, "assistant", "tie"), (5, 1, "user", "tie")]
    found += [(None, 0, "user", "no conversation"), (None, 1, "assistant", "yes")]
    found += [(6, 0, "tool\n<|im_sep|>", "odd role"), (7, 0, "user", "x" * 300_000)]
    found += [(8, k, ("user", "assistant")[k % 2], rng.choice(NASTY)) for k in range(400)]
    rng.shuffle(found)
    return found


def expected(found):
    """Digests of every conversation by plain Python."""
    first = lambda v: (v is not None, v if v is not None else "")
    by_conv = {}
    for conv, turn, role, text in sorted(
        found, key=lambda r: (r[1] is not None, r[1] or 0, first(r[2]), first(r[3]))
    ):
        by_conv.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by_conv.items():
        lines = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        before, bad = "", None
        for k, (role, _) in enumerate(turns):
            ok = {0: role in ("system", "user")}.get(
                k, (before, role) in {("system", "user"), ("user", "assistant"), ("assistant", "user")}
            )
            bad = k if bad is None and not ok else bad
            before = role
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest(lines), len(loss), digest(loss), bad)
    return out


@pytest.fixture(scope="module")
def formatted(spark):
    return chat.format_conversations(spark.createDataFrame(rows(), TURNS).repartition(4)).cache()


def test_digests_read_back(formatted):
    got = {
        r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.first_bad_turn)
        for r in chat.digest(formatted).collect()
    }
    assert got == expected(rows())


def test_markers_occur_once_per_turn(formatted):
    for r in formatted.collect():
        turns = len(r.segments) // 3
        for mark in (chat.CHAT.open, chat.CHAT.middle, chat.CHAT.close):
            assert r.formatted.count(mark) == turns
        for control in ("<s>", "</s>", "[INST]", "[/INST]"):
            assert control not in r.formatted
        assert r.formatted == "".join(s.text for s in r.segments)


def test_only_learned_texts_are_under_the_mask(formatted):
    for r in formatted.collect():
        for k, s in enumerate(r.segments):
            role = r.segments[k // 3 * 3].text
            assert s.loss == (k % 3 == 1 and role == "<|im_start|>assistant<|im_sep|>")


def test_another_template(spark):
    template = chat.Template(
        "[INST]", "::", "</s>", ("user",), ("[INST]", "::", "</s>"), {"": ("user",), "user": ("user",)}
    )
    turns = spark.createDataFrame([(1, 0, "user", "a::b</s>"), (1, 1, "user", "[INST]")], TURNS)
    rows = chat.format_conversations(turns, template)
    row = chat.digest(rows, template).first()
    assert (row.n_turns, row.loss_chars, row.first_bad_turn) == (2, 14, None)
    assert row.loss_sha256 == hashlib.sha256(b"a::b</s>[INST]").hexdigest()


def test_empty_table_and_clashing_columns(spark):
    turns = spark.createDataFrame(rows(), TURNS)
    for name in ("place", "before", "segments", "formatted", "allowed", "n_turns"):
        turns = turns.withColumn(name, F.lit(0))
    assert chat.digest(chat.format_conversations(turns)).count() == len(expected(rows()))
    none = turns.filter(F.lit(False))
    assert chat.digest(chat.format_conversations(none)).count() == 0


def test_plan_is_native(spark):
    turns = spark.createDataFrame(rows()[:3], TURNS)
    plan = chat.digest(chat.format_conversations(turns))._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))
