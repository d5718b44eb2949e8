"""The Jaccard join against all pairs by brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_tables import ROWS, empty, odd, prose
from pyspark.sql import functions as F

from triagelake.llm import jaccard_join as join
from triagelake.llm.components import connected_components


def shingles(text):
    words = (text or "").encode().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(texts):
    """Per row (id, links, group), of texts with words; ids are unique."""
    sets = {i: shingles(t) for i, t in texts}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter()
    for ids in holders.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common[a, b] += 1
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in sets}


def corpus(seed=1):
    rng = random.Random(seed)
    texts = []
    for k in range(60):  # texts with a trail of edits, about the threshold and beyond
        words = prose(rng.choice([4, 8, 30, 120, 400]), 100 + k).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["alpha", "beta", "gamma"])
            texts.append(" ".join(words))
    hub = prose(300, 7).split()
    for k in range(150):  # one large group of near copies
        words = list(hub)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"v{k}"
        texts.append(" ".join(words))
    passage = prose(60, 9)  # shared by many texts that are not alike
    texts += [f"{prose(200, 500 + k)} {passage} {prose(150, 700 + k)}" for k in range(80)]
    texts += ["same words  here\n"] * 40 + ["same words here"] * 2
    rng.shuffle(texts)
    return list(enumerate(texts))


def check(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    rows, want = join.jaccard_join(docs).collect(), brute(texts)
    assert {r.doc_id: (r.n_links, r.class_id) for r in rows} == want
    first = {}
    for i, t in texts:
        first.setdefault(tuple(t.split()), i)
    assert all(r.copy_id == first[tuple(dict(texts)[r.doc_id].split())] for r in rows)


def test_all_links(spark):
    check(spark, corpus())


def test_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(join, "NODE_BLOCK", 16)
    monkeypatch.setattr(join, "CELL_BLOCK", 8)
    monkeypatch.setattr(join, "CELL_SHINGLES", 2000)
    check(spark, corpus(2))


def test_depths_reach_the_recall():
    found = join.depths(0.8, 0.9999, 40, 10)
    missed = float(np.prod([1 - 0.8**d for d in found]))
    assert missed <= 1e-4 and max(found) - min(found) <= 1
    least, *others = sorted(found)  # one step less would not have been enough
    assert float(np.prod([1 - 0.8**d for d in [least + 1, *others]])) > 1e-4
    assert join.depths(0.8, 0.1, 40, 10) == [10] * 40


def test_hash_functions_estimate_the_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**32, 2000, dtype=np.uint32)
    flips, factors = join._hash_functions(280)
    other = np.concatenate((base[:1778], rng.integers(0, 2**32, 222, dtype=np.uint32)))
    same = sum(
        int(((base ^ x) * f).min() == ((other ^ x) * f).min())
        for x, f in zip(flips, factors, strict=True)
    )
    assert same / 280 == pytest.approx(0.8, abs=0.07)


def test_odd_rows(spark):
    rows = join.jaccard_join(odd(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.copy_id, r.n_links, r.class_id))
    assert by_id[1] == {(1, 3, 1)}  # its own repeat, the copy, the near copy
    assert by_id[6] == {(1, 3, 1)} and by_id[7] == {(7, 3, 1)}
    assert by_id[2] == {(2, 0, 2)}
    assert by_id[3] == by_id[4] == {(3, 1, 3)}  # without words
    assert by_id[None] == {(None, 0, None)}
    assert len(rows) == len(ROWS)


def test_one_of_each_group_stays(spark):
    docs = odd(spark)
    kept = join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter([1, 2, 3, None, None, 5, 8, 8, 9, 10, 11, -5])
    assert join.one_of_each_group(empty(spark)).count() == 0
    assert join.jaccard_join(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)]
    edges += [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)] + [(-3, 500), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in linked}
    assert len(got) == len(linked)


def test_rows_without_an_id_meet_their_own_text_only(spark):
    """Near copies without ids: linked as with ids, and no product of rows and texts."""
    texts = [prose(40, k // 4) + f" end {k % 4}" for k in range(80)] * 2
    plain = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(plain, "doc_id bigint, text string").repartition(4)
    none = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    with_ids = Counter(r.n_links for r in join.jaccard_join(docs).collect())
    without = Counter(r.n_links for r in join.jaccard_join(none).collect())
    assert with_ids == without == {7: 160}
    kept = join.one_of_each_group(none).collect()
    assert len({r.text for r in kept}) == 20
