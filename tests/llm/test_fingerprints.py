"""Fingerprints: syncmers by definition, context freedom, the whole table by brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from odd_tables import ROWS, empty, odd, prose

from triagelake.llm import fingerprints as fp
from triagelake.llm import ordered_texts


def points(text):
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def plain_syncmers(text):
    p = points(text)
    inner = fp._substring_hashes(p, fp.S) if len(p) >= fp.S else []
    out = []
    for i in range(len(p) - fp.K + 1):
        window = inner[i : i + fp.K - fp.S + 1]
        if min(window) in (window[0], window[-1]):
            out.append(i)
    return out


@pytest.mark.parametrize("size", [0, 5, 11, 12, 13, 40, 700])
def test_syncmers_by_definition(size):
    text = "".join(random.Random(size).choices("abcdé 中", k=size))
    assert fp.syncmers(points(text))[0].tolist() == plain_syncmers(text)


def test_pieces_change_nothing(monkeypatch):
    text = prose(400, 3)
    whole = [x.tolist() for x in fp.syncmers(points(text))]
    monkeypatch.setattr(fp, "PIECE", 100)
    assert [x.tolist() for x in fp.syncmers(points(text))] == whole


def test_choice_is_free_of_context():
    text = prose(60, 5)
    inside = set(zip(*map(np.ndarray.tolist, fp.syncmers(points(text))), strict=True))
    around = fp.syncmers(points("xyz, " + text + " and more"))
    moved = {(a - 5, h) for a, h in zip(*map(np.ndarray.tolist, around), strict=True)}
    assert inside <= moved


def test_text_round_trip_and_likeness():
    texts = [prose(n, n) for n in (1, 3, 40, 400, 5000)] + ["", "a", "Of Of Of Of Of Of Of"]
    for t in texts:
        s = fp.sketch(t)
        back = fp.from_text(fp.as_text(s))
        assert (back[0] == s[0]).all() and (back[1] == s[1]).all()
        assert fp.likeness(s, s) == 1.0
    assert fp.likeness(fp.sketch(""), fp.sketch("a")) == 0.0
    long = prose(800, 1)
    assert fp.likeness(fp.sketch(long), fp.sketch("Preface. " + long)) > 0.9
    assert fp.likeness(fp.sketch(long), fp.sketch(prose(800, 2))) < 0.1
    halves = long[len(long) // 2 :] + long[: len(long) // 2]  # same anchors, other places
    assert fp.likeness(fp.sketch(long), fp.sketch(halves)) < 0.7


def test_any_edit_shows_and_costs_no_more_than_itself():
    rng = random.Random(1)
    for size in (400, 3000, 20_000):
        text = prose(size, size)
        own = fp.sketch(text)
        assert len(fp.as_text(own)) < len(text)
        for _ in range(30):
            at = rng.randrange(len(text) - 10)
            one = text[:at] + chr(ord(text[at]) + 1) + text[at + 1 :]
            ten = text[:at] + "QWERTYUIOP" + text[at + 10 :]
            more = text[:at] + prose(9, at)[:40] + text[at:]
            less = text[:at] + text[at + 40 :]
            for edited in (one, ten, more, less):
                assert fp.as_text(fp.sketch(edited)) != fp.as_text(own)
                assert fp.likeness(own, fp.sketch(edited)) > 0.95
        both = text[:50] + "inserted here " + text[50:900] + text[950:]
        assert fp.likeness(own, fp.sketch(both)) > 0.9


def test_gaps_are_bounded():
    """Also in texts that repeat themselves."""
    for text in (prose(2000, 4), "a" * 500, "ab" * 300, "abc " * 200, "x" * 40 + prose(30, 1)):
        places = fp.syncmers(points(text))[0]
        assert places[0] <= fp.K - fp.S and np.diff(places).max() <= fp.K - fp.S


def test_chain_against_all_chains():
    rng = random.Random(6)
    for _ in range(300):
        a, b = (np.array(rng.choices(range(9), k=rng.randint(1, 9)), np.uint32) for _ in "ab")
        at = [np.sort(rng.sample(range(60), len(x))) for x in (a, b)]

        def turns(x):
            return [(h, list(x[:k]).count(h)) for k, h in enumerate(x)]

        pairs = [(i, j) for i, p in enumerate(turns(a)) for j, q in enumerate(turns(b)) if p == q]
        runs, k = [], 0
        while k < len(pairs):  # neighbouring matches with one shift
            m = k
            while m + 1 < len(pairs) and pairs[m + 1][1] > pairs[m][1] and (
                at[0][pairs[m + 1][0]] - at[1][pairs[m + 1][1]] == at[0][pairs[m][0]] - at[1][pairs[m][1]]
            ):
                m += 1
            runs.append((pairs[k][1], pairs[m][1], m - k + 1))
            k = m + 1
        best = 0
        for mask in range(1 << len(runs)):
            some = [r for k, r in enumerate(runs) if mask >> k & 1]
            if all(x[1] < y[0] for x, y in zip(some, some[1:])):
                best = max(best, sum(r[2] for r in some))
        assert fp.likeness((a, at[0]), (b, at[1])) == pytest.approx(2 * best / (len(a) + len(b)))


def expected(rows, ties):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]))
    out = Counter()
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own = fp.sketch(text)
        out[
            i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.as_text(own),
            fp.as_text(fp.sketch(edited)), fp.likeness(own, fp.sketch(edited)),
            fp.likeness(own, fp.sketch(after)),
        ] += 1
    return out


def text_ties(spark, texts):
    docs = spark.createDataFrame([(t,) for t in set(texts)], "text string")
    return {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}


@pytest.mark.parametrize("ranges", [1, 4, 16])
def test_every_document_and_its_successor(spark, monkeypatch, ranges):
    monkeypatch.setattr(ordered_texts, "RANGES_PER_PARTITION", ranges)
    rows = [(r[0], r[1]) for r in ROWS] + [(100 + 7 * k, prose(5 + k % 90, k)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = Counter(map(tuple, fp.fingerprint_documents(docs).collect()))
    assert got == expected(rows, text_ties(spark, [t for _, t in rows]))


def test_odd_tables(spark):
    got = Counter(map(tuple, fp.fingerprint_documents(odd(spark)).collect()))
    rows = [(r[0], r[1]) for r in ROWS]
    assert got == expected(rows, text_ties(spark, [t for _, t in rows]))
    assert fp.fingerprint_documents(empty(spark)).count() == 0


def test_a_single_document_follows_itself(spark):
    docs = spark.createDataFrame([(3, "abcdefgh")], "doc_id bigint, text string")
    row = fp.fingerprint_documents(docs).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
