"""Retrieval against a plain brute-force ranking."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from triagelake.functions import scoring
from triagelake.operators import retrieval as rt

RNG = random.Random(7)
WORDS = [f"w{i}" for i in range(30)]
DOCS = [(i, " ".join(RNG.choices(WORDS, k=RNG.randint(1, 25)))) for i in range(150)]
DOCS += [(200 + i, "common common twin") for i in range(40)]  # exact score ties
DOCS += [(300, ""), (301, None), (302, "w1 w1 w1 Common")]
QUERIES = [(0, "w1 w2 w2 common"), (1, "unseen words only"), (2, "twin"), (3, ""), (4, "W5, w6!")]


def vector(seed: int):
    rng = random.Random(seed)
    return [rng.uniform(-1, 1) for _ in range(8)] if seed % 3 else None


def frames(spark, partitions=5):
    docs = spark.createDataFrame([(i, t, vector(i)) for i, t in DOCS], "id bigint, text string, e array<double>")
    queries = spark.createDataFrame(
        [(i, t, vector(i + 1)) for i, t in QUERIES], "id bigint, text string, e array<double>"
    )
    return (
        rt.searchable(queries, "id", "text", "e"),
        rt.searchable(docs.repartition(partitions), "id", "text", "e"),
    )


def brute(k, k1=1.5, b=0.75, c=60):
    def words(t):
        return re.findall(r"\w+", (t or "").lower())

    corpus = {i: words(t) for i, t in DOCS}
    n, avgdl = len(corpus), sum(map(len, corpus.values())) / len(corpus)
    df = Counter(w for ws in corpus.values() for w in set(ws))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else floor for w, v in idf.items()}

    def unit(v):
        v = [float(x) for x in map(lambda y: __import__("numpy").float32(y), v)] if v else None
        size = math.sqrt(sum(x * x for x in v)) if v else 0
        return [x / size for x in v] if v else None

    out = []
    for q, t in QUERIES:
        lexical, dense = {}, {}
        u = unit(vector(q + 1))
        for i, ws in corpus.items():
            tf = Counter(ws)
            norm = k1 * (1 - b + b * len(ws) / avgdl)
            lexical[i] = round(
                sum(idf[w] * tf[w] * (k1 + 1) / (tf[w] + norm) for w in words(t) if w in tf), 9
            )
            v = unit(vector(i))
            dense[i] = round(sum(x * y for x, y in zip(u, v)), 9) if u and v else 0.0

        def place(scores):
            order = sorted(scores, key=lambda i: (scores[i], i), reverse=True)
            return {i: r for r, i in enumerate(order, 1)}

        a, d = place(lexical), place(dense)
        fused = {i: 1 / (c + a[i]) + 1 / (c + d[i]) for i in corpus}
        top = sorted(corpus, key=lambda i: (-fused[i], i))[:k]
        out += [(q, r, i, a[i], d[i], round(lexical[i], 6), round(dense[i], 6)) for r, i in enumerate(top, 1)]
    return sorted(out)


def rows(found):
    return sorted(
        (r.query_id, r["rank"], r.doc_id, r.bm25_rank, r.dense_rank,
         round(r.bm25_score, 6), round(r.dense_score, 6))
        for r in found.collect()
    )


@pytest.mark.parametrize("resident", ["corpus", "queries"])
@pytest.mark.parametrize("k", [3, 10])
def test_exact_for_either_resident_side(spark, resident, k):
    queries, docs = frames(spark)
    assert rows(rt.retrieve(queries, docs, k, resident=resident)) == brute(k)


SMALL = {"MAX_RESIDENT_DOCS": 5, "MAX_RESIDENT_QUERIES": 2, "MAX_SHARD_DOCS": 60, "MERGE_PIECES": 2}


@pytest.fixture
def small(monkeypatch):
    """Bounds so small that neither side fits a task."""
    for name, bound in SMALL.items():
        monkeypatch.setattr(rt, name, bound)


@pytest.mark.parametrize("k", [3, 10])
@pytest.mark.parametrize("resident", [None, "corpus", "queries"])
def test_grid_of_buckets_and_shards(spark, small, resident, k):
    queries, docs = frames(spark)
    assert rows(rt.retrieve(queries, docs, k, resident=resident)) == brute(k)


def test_grid_of_one_bucket_and_small_batches(spark, small, monkeypatch):
    monkeypatch.setattr(rt, "MAX_RESIDENT_QUERIES", 100)
    monkeypatch.setattr(rt, "BATCH_CELLS", 50)
    queries, docs = frames(spark)
    assert rows(rt.retrieve(queries, docs, 3)) == brute(3)


ODD_IDS = ["a", "b", None, "a", None]  # strings, null, repeated


def odd_messages(spark):
    return spark.createDataFrame(
        [(ODD_IDS[n], i, t, vector(i + 1)) for n, (i, t) in enumerate(QUERIES)],
        "id string, n int, text string, e array<double>",
    )


def found_hits(messages, docs, **options):
    hits = rt.with_hits(messages, docs, embedding="e", **options).collect()
    return sorted((r.n, str(r.id), [tuple(h) for h in r.hits]) for r in hits)


def test_any_key_on_either_side_of_the_bounds(spark, monkeypatch):
    _, docs = frames(spark)
    messages = odd_messages(spark)
    whole = found_hits(messages, docs)
    assert [[h[0] for h in hits] for *_, hits in whole] == [
        [d for q, _, d, *_ in brute(3) if q == i] for i, _ in QUERIES
    ]
    assert found_hits(messages, docs, resident="queries") == whole
    for name, bound in SMALL.items():
        monkeypatch.setattr(rt, name, bound)
    assert found_hits(messages, docs) == whole


def test_vector_bytes_are_a_bound(spark, monkeypatch):
    _, docs = frames(spark)
    index = rt.build_index(docs)
    assert index.vector_bytes == 8 * 8 * sum(vector(i) is not None for i, _ in DOCS)
    monkeypatch.setattr(rt, "MAX_RESIDENT_VECTOR_BYTES", index.vector_bytes - 1)
    assert not rt.corpus_fits(index)


def test_number_of_jobs_does_not_grow_with_the_messages(spark, small):
    _, docs = frames(spark)
    index = rt.build_index(docs)
    tracker = spark.sparkContext.statusTracker()

    def jobs(copies):
        group = f"messages-{copies}"
        spark.sparkContext.setJobGroup(group, group)
        messages = odd_messages(spark).crossJoin(spark.range(copies)).drop("id")
        assert rt.with_hits(messages, index, embedding="e").count() == copies * len(QUERIES)
        found = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    assert abs(jobs(20) - jobs(2)) <= 4  # adaptive plans may split a job, no more


def test_repeated_corpus_keys_are_refused(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b")], "id bigint, t string")
    with pytest.raises(ValueError):
        rt.build_index(rt.searchable(docs, "id", "t"))


def test_index_holds_what_its_rankings_need(spark):
    _, docs = frames(spark)
    lexical = rt.build_index(docs, legs=(rt.LEXICAL,))
    dense = rt.build_index(docs, legs=(rt.DENSE,))
    assert lexical.vector_bytes == 0 and lexical.n_postings > 0
    assert dense.n_postings == 0 and dense.vector_bytes > 0


def test_totals_are_over_the_whole_corpus(spark, small):
    queries, docs = frames(spark)
    every = brute(len(DOCS))
    for r in rt.rank_legs(queries, rt.build_index(docs), 2).collect():
        scores = [x[5 if r.leg == "lexical" else 6] for x in every if x[0] == r.query_id]
        assert (r.ranked, r.matches) == (len(DOCS), sum(s != 0 for s in scores))
        assert r.score_sum == pytest.approx(1e6 * sum(scores), abs=len(DOCS))
        assert len(r.leading) == 2


def test_both_ranks_of_all_candidates(spark, small):
    queries, docs = frames(spark)
    found = rt.ranked_candidates(queries, rt.build_index(docs), 7).collect()
    want = {(q, d, a, b) for q, _, d, a, b, *_ in brute(len(DOCS)) if a <= 7 or b <= 7}
    assert {(r.query_id, r.doc_id, r.bm25_rank, r.dense_rank) for r in found} == want
    assert len(found) == len(want)


def test_small_batches_and_other_partitions(spark, monkeypatch):
    monkeypatch.setattr(rt, "BATCH_CELLS", 50)
    queries, docs = frames(spark, partitions=2)
    assert rows(rt.retrieve(queries, docs, 3, resident="queries")) == brute(3)
    assert rows(rt.retrieve(queries, docs, 3, resident="corpus")) == brute(3)


def test_leaders_are_the_full_ranking(spark):
    queries, docs = frames(spark)
    every = rt.leading_documents(queries, rt.build_index(docs), len(DOCS))
    assert every.groupBy("leg", "query_id").count().filter(F.col("count") != len(DOCS)).count() == 0
    best = {(r.query_id, r["rank"]): r.doc_id for r in every.filter("leg = 'lexical'").collect()}
    # without any match: by key, descending
    assert [best[1, r] for r in (1, 2, 3)] == [302, 301, 300]


def test_idf_floor_is_used(spark):
    docs = rt.searchable(
        spark.createDataFrame([(i, f"the word{i}") for i in range(9)], "id bigint, t string"), "id", "t"
    )
    terms = {r.term: r.idf for r in rt.build_index(docs).terms.collect()}
    raw_the = math.log(0.5) - math.log(9.5)
    mean = (raw_the + 9 * (math.log(8.5) - math.log(1.5))) / 10
    assert terms["the"] == pytest.approx(0.25 * mean)


def test_empty_corpus(spark):
    queries, docs = frames(spark)
    none = docs.filter(F.lit(False))
    assert rt.retrieve(queries, none).count() == 0
    messages = spark.createDataFrame([(1, "x")], "id bigint, text string")
    assert rt.with_hits(messages, none).first().hits == []


def test_messages_with_queries_resident(spark):
    _, docs = frames(spark)
    messages = spark.createDataFrame(
        [(i, t, vector(i + 1)) for i, t in QUERIES], "id bigint, text string, e array<double>"
    )
    sides = [
        {r.id: [h.doc_id for h in r.hits] for r in rt.with_hits(
            messages, docs, embedding="e", resident=side).collect()}
        for side in ("corpus", "queries")
    ]
    assert sides[0] == sides[1]
    expected = {}
    for q, _, doc, *_ in brute(3):
        expected.setdefault(q, []).append(doc)
    assert sides[0] == expected


def test_hits_need_no_shuffle_of_messages(spark):
    _, docs = frames(spark)
    messages = spark.range(20).selectExpr("id", "concat('w', id) as text")
    plan = rt.with_hits(messages, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_stored_index(spark, tmp_path):
    queries, docs = frames(spark)
    rt.build_index(docs, str(tmp_path / "index"))
    index = rt.read_index(spark, str(tmp_path / "index"))
    assert (index.n_docs, index.n_postings) == (len(DOCS), rt.postings(index.docs).count())
    assert rows(rt.retrieve(queries, index, 3)) == brute(3)
    assert rows(rt.retrieve(queries, index, 3, resident="corpus")) == brute(3)


def test_places_of_many_rows_are_those_of_each():
    rng = np.random.default_rng(1)
    scores, names = scoring.rounded(rng.integers(-3, 4, (5, 32)) / 4), np.arange(0, 64, 2)
    wanted, wanted_names = scoring.rounded(rng.integers(-3, 4, (5, 9)) / 4), rng.integers(-1, 66, (5, 9))
    for factor in (1, 1e9):  # the second does not fit a key
        each = [
            scoring.places_before(s * factor, names, w * factor, n)
            for s, w, n in zip(scores, wanted, wanted_names)
        ]
        assert (scoring.rows_before(scores * factor, names, wanted * factor, wanted_names) == each).all()


def test_a_task_works_on_a_bounded_number_of_words(monkeypatch):
    """A batch is bounded by its rows; texts of any length must not add up in a task."""
    monkeypatch.setattr(rt, "BATCH_TERMS", 60)
    words = [["a", "b", "a"] * n for n in (5, 0, 7, 40, 1, 1, 0, 19)]  # one is beyond the bound
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": list(range(8)), "tokens": words, "embedding": [[1.0]] * 8}
    )
    found = list(rt._count_terms([batch]))
    assert all(b.num_rows == 1 or sum(b.column("dl").to_pylist()) <= 60 for b in found)
    rows = [r for b in found for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(8))
    assert [dict(zip(r["terms"], r["tfs"])) for r in rows] == [dict(Counter(w)) for w in words]


@pytest.mark.parametrize("width", [1, 5, 900, 5000])
def test_fused_heads_are_those_of_all_places(width):
    rng = np.random.default_rng(width)
    k, rrf_k = 3, 60
    for levels in (1, 2, 7, 10**6):  # from all equal to hardly any
        legs = [scoring.rounded(rng.integers(0, levels, width) / 8 - 3) for _ in range(2)]
        legs[1] = None if levels == 7 else legs[1]
        whole = [np.zeros(width) if x is None else x for x in legs]
        ranks = [np.argsort(np.lexsort((np.arange(width), x))[::-1]) + 1 for x in whole]
        fused = 1.0 / (rrf_k + ranks[0]) + 1.0 / (rrf_k + ranks[1])
        best = np.lexsort((np.arange(width), -fused))[:k]
        top, places, scores = scoring.fused_top([scoring.Places(x, width) for x in legs], k, rrf_k)
        assert top.tolist() == best.tolist()
        assert [p.tolist() for p in places] == [r[best].tolist() for r in ranks]
        assert scores.tolist() == fused[best].tolist()


def test_a_block_of_messages_takes_one_pass_over_the_shards(monkeypatch):
    words = [f"w{i}" for i in range(300)]
    rng = np.random.default_rng(3)

    def shard(ids):
        n = len(ids)
        rows = pa.table({
            "doc_id": pa.array(ids), "dl": pa.array(np.full(n, 4)),
            "terms": pa.array([rng.choice(words, 4, replace=False).tolist() for _ in ids]),
            "tfs": pa.array([[1, 2, 1, 1]] * n, pa.list_(pa.int32())),
            "embedding": pa.array([[1.0, float(i % 5)] for i in ids], pa.list_(pa.float32())),
        })
        known = pa.table({"term": words, "idf": rng.random(len(words))})
        return rt._corpus_of(rows, known, 4.0, 1.5, 0.75)

    parts, read = [shard(np.arange(i, 600, 2)) for i in (0, 1)], []
    monkeypatch.setattr(rt, "_read_again", lambda i: read.append(i) or parts[i])
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(range(40)), pa.array([rng.choice(words, 9).tolist() for _ in range(40)]),
            pa.array([[1.0, 2.0] if i % 2 else None for i in range(40)], pa.list_(pa.float32())),
        ],
        ["id", "_tokens", "_embedding"],
    )
    (found,) = rt._rank_against([0, 1], 3, 60, ["id"])(iter([batch]))
    assert read == [0, 1] * 2  # the keys, then the scores
    assert found.num_rows == 40
    hits = found.column("hits").to_pylist()
    assert all(h["dense_score"] == 0 and h["dense_rank"] == 600 - h["doc_id"] for h in sum(hits[::2], []))
    assert all(h["dense_score"] > 0 for h in sum(hits[1::2], []))


@pytest.mark.parametrize("fits", [True, False])
def test_what_is_sent_is_smaller_than_what_it_holds(spark, monkeypatch, fits):
    """The driver and every executor keep a copy of it on disk."""
    if not fits:
        for name in ("MAX_RESIDENT_DOCS", "MAX_SHARD_DOCS"):
            monkeypatch.setattr(rt, name, 500)
    corpus = spark.range(2000).selectExpr(
        "id AS doc_id", "concat_ws(' ', transform(sequence(1, 30), i -> concat('w', (id * i + i) % 97))) AS text",
        "CAST(transform(sequence(1, 8), i -> (id % 300 * i) % 7 + 1) AS array<float>) AS embedding",
    )
    index = rt.build_index(rt.searchable(corpus, "doc_id", "text", "embedding"))
    messages = spark.range(5).selectExpr("id", "concat('w', id, ' w', id + 9) AS text")
    found = rt.attach_attributes(rt.with_hits(messages, index), corpus, ["text"], index=index)
    texts = {r.doc_id: r.text for r in corpus.collect()}
    hits = {r.id: [h.doc_id for h in r.hits] for r in rt.with_hits(messages, index).collect()}
    assert {r.id: [t.text for t in r.retrieved] for r in found.collect()} == {
        i: [texts[d] for d in ids] for i, ids in hits.items()
    }

    def held(sent):
        return sum(os.path.getsize(x._path) for x in sent)

    sent = index.sent[rt.rules.BM25_K1, rt.rules.BM25_B]
    assert len(sent) == (1 if fits else 4)
    assert held(sent) < (16 * index.n_postings + index.vector_bytes) / 2
    if not fits:
        assert held(index.sent["rows", "text"]) < sum(map(len, texts.values())) / 2
