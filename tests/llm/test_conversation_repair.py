"""Conversation repair against a search over all edit strings, and the tree of audits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from triagelake.llm import conversation_repair as repair
from triagelake.llm.audit_trail import Audits

PATTERN = re.compile(r"(s?(ua)+)?\Z")
PREFIX = re.compile(r"s?(ua)*u?\Z")


def search(rows):
    """(cost, audit, repaired turns) by best-first search over whole edit strings."""
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, roles, turns = heapq.heappop(heap)
        if i == len(rows) and PATTERN.match(roles):
            return cost, audit, turns  # least cost first, then the least audit
        if not PREFIX.match(roles) or len(roles) > 2 * len(rows) + 3:
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, roles + role[0], turns + ((role, ""),)))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, turns))
        if fault in (repair.BLANK, repair.DUPLICATE):
            continue
        more = cost + 5 * (fault == repair.TRUNCATED)
        if role[:1] in ("s", "u", "a"):
            heapq.heappush(heap, (more, audit + "K", i + 1, roles + role[0], turns + ((role, text),)))
        for new in ("user", "assistant"):
            heapq.heappush(
                heap, (more + 1, audit + "R", i + 1, roles + new[0], turns + ((new, text),))
            )
    raise AssertionError


@pytest.mark.parametrize("modulus", [None, 5])
@pytest.mark.parametrize("flush_at", [3, 4096])
def test_cheapest_and_least(monkeypatch, modulus, flush_at):
    """Also with hashes that collide all the time, and with a tree cut all the time."""
    monkeypatch.setattr(repair, "FLUSH_AT", flush_at)
    rng = random.Random(5)
    for _ in range(120):
        rows = [
            (rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice("abc"),
             rng.choice([0, 0, 0, 0, 1, 2, 3]))
            for _ in range(rng.randint(0, 6))
        ]
        one = repair.Repair()
        if modulus:
            one.audits.modulus = modulus
        for k, row in enumerate(rows):
            one.row(k, *row)
        got = one.result()
        cost, audit, turns = search(rows)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        assert got[5:] == (cost, audit, digest), rows


@pytest.mark.parametrize("roles", ["user assistant", "user assistant tool", "tool"])
def test_long_conversations(roles):
    one, roles = repair.Repair(), roles.split()
    for k in range(20_000):
        one.row(k, roles[k % len(roles)], str(k), repair.SOUND)
    assert one.paths.keys() == {repair.USER, repair.ASSISTANT}
    assert len(one.audits) <= 2 * repair.FLUSH_AT or roles != ["user", "assistant"]
    assert len(one.result()[6]) >= 20_000


def test_order_of_audits():
    rng = random.Random(2)
    for modulus in (7, (1 << 61) - 1):
        trail = Audits(modulus)
        texts = {0: ""}
        for _ in range(300):
            from_ = rng.randrange(len(trail))
            edit = rng.choice("DIKR")
            texts[trail.append(from_, edit)] = texts[from_] + edit
        for _ in range(3000):
            x, y = rng.randrange(301), rng.randrange(301)
            assert trail.before(x, y) == (texts[x] < texts[y])
        live = rng.sample(range(301), 4)
        renewed = trail.flush(live)
        assert [trail.text(n) for n in renewed] == [texts[x] for x in live]


ROWS = [
    # conv, turn, role, text
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes?"),
    (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 1, "assistant", "no end"),
    (3, None, None, None), (3, 5, "user", " \n\t"), (3, 9, "tool", "Out!"),
    (None, 1, "user", "Who."), (None, None, "assistant", "Me."), (None, 1, "user", "Who."),
    (4, 7, "user", "x" * 200_000 + "."), (4, 9, "assistant", "y. " * 50_000 + "z"),
    (5, 2, "assistant", "Late."), (5, 1, "user", "Early."),
    (-6, 3, "", ""), *[(7, k, "user", f"Turn {k}.") for k in range(50)],
]
COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows, original):
    """What the query must return, from the contract, in plain Python."""
    out = {}
    for conv in {r[0] for r in original}:
        mine = sorted(
            (r[1:] for r in rows if r[0] == conv),
            key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]),
        )
        seen, judged, counts = set(), [], [0] * 4
        for _, role, text in mine:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role, text, fault))
        turns = {r[0] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(
            a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])
        )
        cost, audit, kept = search(judged) if len(judged) < 6 else (None, None, ())
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *counts[1:], illegal, cost, audit, digest)
    return out


def test_query_rows(spark):
    turns = spark.createDataFrame(ROWS, COLUMNS).repartition(3)
    for name in ("lost", "fault", "_kind", "cost"):
        if name != "lost":
            turns = turns.withColumn(name, F.lit("x"))
    rows = repair.repair_conversations(repair.damaged(turns)).collect()
    want = expected(damaged(ROWS), ROWS)
    assert len(rows) == len(want)
    for r in rows:
        got = tuple(r)[1:]
        if want[r.conv_id][5] is None:
            assert got[:5] == want[r.conv_id][:5]
        else:
            assert got == want[r.conv_id], r.conv_id


def test_undamaged_ties_and_repaired_turns(spark):
    turns = spark.createDataFrame(ROWS, COLUMNS).repartition(4)
    repaired = repair.repair_conversations(turns).cache()
    want = expected([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ROWS], ROWS)
    out = {}
    for r in repair.apply_audits(turns, repaired).orderBy("conv_id", "place").collect():
        out.setdefault(r.conv_id, []).append(r)
    for row in repaired.collect():
        kept = out.get(row.conv_id, [])
        assert [k.place for k in kept] == list(range(len(kept)))
        assert PATTERN.match("".join(k.role[0] for k in kept))
        assert "".join(k.edit for k in kept) == row.audit.replace("D", "")
        text = "\n".join(f"{k.role}:{k.text}" for k in kept)
        assert hashlib.sha256(text.encode()).hexdigest() == row.repaired_sha256
        if want[row.conv_id][5] is not None:
            assert tuple(row)[1:] == want[row.conv_id]


def test_empty_table_and_lost_conversations(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert repair.repair_conversations(repair.damaged(none)).count() == 0
    gone = spark.createDataFrame([(8, 0, "user", "Hi.", True)], COLUMNS + ", lost boolean")
    row = repair.repair_conversations(gone).first()
    assert tuple(row) == (8, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_shuffle(spark):
    turns = spark.createDataFrame(ROWS, COLUMNS)
    plan = repair.repair_conversations(repair.damaged(turns))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
