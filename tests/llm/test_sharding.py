"""Sharding: balance, gapless places, whole groups, split of a group beyond a shard."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from odd_tables import ROWS, empty, odd, prose
from pyspark.sql import functions as F

from triagelake.llm import sharding


def check(rows, texts, shards):
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for slots in places.values():
        assert sorted(slots) == list(range(len(slots)))
    got = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    want = Counter(
        (i, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode()))
        for i, t in texts
    )
    assert got == want


def test_odd_rows(spark):
    rows = sharding.shard_documents(odd(spark), 3).collect()
    check(rows, [(r[0], r[1]) for r in ROWS], 3)


def test_empty(spark):
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_balance_whole_groups_and_a_hot_group(spark):
    rng = random.Random(3)
    texts = [(i, prose(rng.randint(5, 300), i)) for i in range(1500)]
    texts += [(2000 + i, "hot " * 200) for i in range(700)]  # a third of all rows
    texts += [(4000 + i, prose(100, 9000 + i % 20)) for i in range(200)]  # copies by ten
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    rows = sharding.shard_documents(docs, 8).collect()
    check(rows, texts, 8)
    size, count = Counter(), Counter()
    of_group = defaultdict(set)
    for r in rows:
        size[r.shard] += r.size
        count[r.shard] += 1
        of_group[r.text_crc32, r.size].add(r.shard)
    assert max(size.values()) / min(size.values()) < 1.04
    assert max(count.values()) / min(count.values()) < 1.5  # its words and rows weigh otherwise
    split = [g for g, s in of_group.items() if len(s) > 1]
    assert split == [(zlib.crc32(("hot " * 200).encode()), 808)]
    again = sharding.shard_documents(docs.repartition(2), 8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_cells_balance_together(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_GROUPS", 200)
    texts = [(i, prose(20 + i % 100, i)) for i in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    size, count = Counter(), Counter()
    for r in sharding.shard_documents(docs, 6).collect():
        size[r.shard] += r.size
        count[r.shard] += 1
    assert max(size.values()) / min(size.values()) < 1.03
    assert max(count.values()) / min(count.values()) < 1.05


def test_each_group_goes_where_the_dot_product_is_highest():
    loads = np.array([[0.4, 0.1], [0.3, 0.3], [0.1, 0.4], [0.2, 0.2]])
    capacity = np.array([[0.6, 0.4], [0.4, 0.6]])
    left, got = capacity.copy(), sharding.dot_product_packing(loads, capacity, np.arange(4))
    for load, shard in zip(loads, got, strict=True):
        dots = [c @ load if (c >= load).all() else -1 for c in left]
        if max(dots) >= 0:
            assert dots[shard] == max(dots)
        else:
            assert (left[shard] >= load)[0] or left[shard][0] == left[:, 0].max()
        left[shard] -= load


def test_null_and_empty_texts_are_groups_of_their_own(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, None)], "doc_id bigint, text string")
    facts = sharding.facts(rows).groupBy("_hash", "_crc", "_bytes").agg(F.count("*").alias("n"))
    assert sorted(r.n for r in facts.collect()) == [1, 2]
