"""Importance resampling against plain Python, and the CRC of spans against zlib."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_tables import ROWS, empty, odd, prose

from triagelake.llm import resampling, span_crc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_span_crc(monkeypatch):
    rng = np.random.default_rng(0)
    data = np.frombuffer(random.Random(1).randbytes(30_000), np.uint8)
    starts = rng.integers(0, len(data), 3000)
    ends = np.minimum(starts + rng.integers(0, 900, 3000), len(data))
    starts, ends = np.append(starts, [0, 5, 9]), np.append(ends, [len(data), 5, 9 + span_crc.WIDTH])
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert span_crc.span_crc32(data, starts, ends).tolist() == want
    monkeypatch.setattr(span_crc, "AT_ONCE", 100)  # slices of fewer bytes than a span
    assert span_crc.span_crc32(data, starts, ends).tolist() == want
    assert len(span_crc.span_crc32(data, starts[:0], ends[:0])) == 0


def buckets(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(low)
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(f.encode()) % resampling.BUCKETS for f in runs]


def expected(rows, targets, share=5, least=20):
    seen = [(i, *buckets(t)) for i, t in rows]
    raw = Counter(b for _, _, found in seen for b in found)
    target = Counter(b for t in targets for b in buckets(t)[1])
    s, t, n = sum(raw.values()), sum(target.values()), resampling.BUCKETS
    gain = {
        b: math.floor(1000 * math.log((target[b] + 1) * (s + n) / ((raw[b] + 1) * (t + n))))
        for b in raw
    }
    out = []
    for i, words, found in seen:
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, words >= least])
    ranked = sorted((-r[3], r[0] is None, r[0] or 0) for r in out if r[4])
    drawn = ranked[: share * len(ranked) // 100]
    return Counter(tuple(r[:4]) for r in out), drawn


def check(docs, target, rows, targets, **options):
    got = resampling.draw(docs, target, **options).collect()
    want, drawn = expected(rows, targets, **options)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == want
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked] == drawn


@pytest.mark.parametrize("share", [5, 60, 100])
def test_odd_rows(spark, share):
    targets = [prose(40, 90), None, "", "ÀÉ and Ünder ascii_Words 12", "w" * 1000 + " " + "é" * 700]
    rows = [(r[0], r[1]) for r in ROWS] + [(20, "w" * 1000), (21, "é" * 900 + " b " + "x" * 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    check(docs, target, rows, targets, share=share)


def test_clashing_names_and_empty_tables(spark):
    target = spark.createDataFrame([("a b c",)], "text string")
    got = resampling.draw(odd(spark), target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert got.count() == len(ROWS)
    assert resampling.draw(empty(spark), target).count() == 0
    rows = [(r[0], r[1]) for r in ROWS]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(docs, target.filter("text = 'z'"), rows, [], share=50)


def test_repeated_rows_and_reruns(spark):
    text = prose(30, 5)
    rows = [(1, text)] * 40 + [(k % 7, prose(25, k)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    target = spark.createDataFrame([(prose(200, 8),)], "text string")
    check(docs.repartition(5), target, rows, [prose(200, 8)], share=30)
    runs = [
        Counter(map(tuple, resampling.draw(docs.repartition(n), target, share=30).collect()))
        for n in (1, 6)
    ]
    assert runs[0] == runs[1]
