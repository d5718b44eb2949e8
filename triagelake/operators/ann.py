"""Approximate vector search: cells, product-quantised residuals, exact re-ranking.

* **cells** -- centroids from k-means over a sample of at most ``SAMPLE`` vectors
  (lowest hash of the key); every vector of the corpus is put into its best cell;
* **codes** -- what a vector differs from its centroid by is cut into ``parts``
  pieces, each replaced by the number of the nearest of ``CODES`` code words (k-means
  over the same sample); a vector is then ``parts`` bytes;
* **search** -- a query looks into its ``probes`` best cells, scores codes there by
  looking up inner products with code words, and the leading ``rerank`` documents
  are scored exactly.

Each round of k-means is a job that sums within tasks; centroids and code words,
whose number does not depend on the corpus beyond its square root, are all that
reaches the driver.  Queries meet codes by an equi-join on the cell; cells of more
than ``PIECE_ROWS`` vectors and more than ``PIECE_QUERIES`` queries are met in
pieces, so no task holds more, whatever the skew.  With ``rerank=None`` every vector
of the probed cells is scored exactly; probing all cells is then the full ranking.

A missing vector is the zero vector and scores 0, as in ``retrieval``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions import scoring
from triagelake.operators.ranking import top_per_group
from triagelake.session import cut_lineage, scratch_path, ship_package
from triagelake.sources import files

SAMPLE = 100_000
CODES = 256
ROUNDS = 8
PIECE_ROWS = 50_000
PIECE_QUERIES = 1_000
SEED = 17


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: cell, slice, doc_id, codes, embedding; centroids; code words per part."""

    rows: DataFrame
    sizes: DataFrame  # cell, pieces
    centroids: np.ndarray
    words: np.ndarray  # parts x CODES x width

    @property
    def cells(self) -> int:
        return len(self.centroids)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def _parts(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, width) pieces of vectors, padded with zeros."""
    width = -(-vectors.shape[1] // parts)
    padded = np.zeros((len(vectors), parts * width))
    padded[:, : vectors.shape[1]] = vectors
    return padded.reshape(len(vectors), parts, width).transpose(1, 0, 2)


def _k_means(sample: DataFrame, centres: np.ndarray, points, size: int) -> np.ndarray:
    """``ROUNDS`` of k-means of all groups at once; ``centres`` is groups x k x width.

    ``points`` gives the groups' points of a matrix of unit vectors.  A centre
    that loses all its points stays where it is.
    """
    groups, k, width = centres.shape
    for _ in range(ROUNDS):
        now = centres

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(now.shape), np.zeros(now.shape[:2], np.int64)
            for batch in batches:
                for g, own in enumerate(points(scoring.unit_rows(batch.column(0), size))):
                    at = _nearest(own, now[g])
                    count[g] += np.bincount(at, minlength=k)
                    for d in range(width):
                        total[g, :, d] += np.bincount(at, own[:, d], minlength=k)
            used = np.flatnonzero(count.ravel())
            flat = total.reshape(groups * k, width)[used]
            offsets = pa.array(np.arange(len(used) + 1, dtype=np.int32) * width)
            yield pa.record_batch(
                [pa.array(used.astype(np.int32)), pa.array(count.ravel()[used]),
                 pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))],
                names=["at", "n", "total"],
            )

        found = sample.mapInArrow(sums, "at int, n bigint, total array<double>").groupBy("at").agg(
            F.sum("n").alias("n"),
            *[F.sum(F.col("total")[d]).alias(f"d{d}") for d in range(width)],
        ).toArrow()
        moved = centres.reshape(groups * k, width).copy()
        means = np.stack([found.column(f"d{d}").to_numpy() for d in range(width)], axis=1)
        moved[found.column("at").to_numpy()] = means / found.column("n").to_numpy()[:, None]
        centres = moved.reshape(centres.shape)
    return centres


def build_vector_index(
    vectors: DataFrame, path: str | None = None, cells: int | None = None, parts: int = 16
) -> VectorIndex:
    """Index all rows of ``doc_id, embedding``; ``cells`` is the root of their number by default."""
    spark = vectors.sparkSession
    ship_package(spark)
    path = path or scratch_path(spark, "vectors")
    rows = vectors.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding")
    )
    present = rows.filter(F.size("embedding") > 0)
    count, size = present.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    cells = max(1, min(cells or math.isqrt(count), count, SAMPLE))
    hashed = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    sample = cut_lineage(present.orderBy(hashed, "doc_id").limit(SAMPLE).select("embedding"))
    # the first of the sample, one of equal vectors, are where k-means starts
    starts = sample.distinct().orderBy(F.xxhash64("embedding")).limit(max(cells, CODES)).toArrow()
    first = scoring.unit_rows(starts.column("embedding").combine_chunks(), size)
    first = first[np.lexsort(first.T)] if len(first) else np.zeros((1, size))
    pick = np.random.default_rng(SEED).permutation(len(first))
    centroids = _k_means(sample, first[pick[:cells]][None], lambda v: v[None], size)[0] if count else first

    def residuals(v: np.ndarray) -> np.ndarray:
        return _parts(v - centroids[_nearest(v, centroids)], parts)

    words = residuals(first[pick[:CODES]])
    if count:
        words = _k_means(sample, words, residuals, size)
    _write(rows, path, centroids, words, size)
    files.write_text(
        spark, f"{path}/model.json", json.dumps({"centroids": centroids.tolist(), "words": words.tolist()})
    )
    return read_vector_index(spark, path)


def _write(rows: DataFrame, path: str, centroids: np.ndarray, words: np.ndarray, size: int) -> None:
    parts = len(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = scoring.unit_rows(batch.column(1), size)
            cell = _nearest(unit, centroids)
            own = _parts(unit - centroids[cell], parts)
            codes = np.stack([_nearest(p, w) for p, w in zip(own, words, strict=True)], axis=1)
            packed = codes.astype(np.uint8)
            yield pa.record_batch(
                [pa.array(cell.astype(np.int32)), batch.column(0),
                 pa.array([r.tobytes() for r in packed], pa.binary()), batch.column(1)],
                names=["cell", "doc_id", "codes", "embedding"],
            )

    coded = rows.mapInArrow(encode, "cell int, doc_id bigint, codes binary, embedding array<float>")
    # a cell's rows lie together, cut into pieces by a hash of the key
    spread = coded.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).cast("int"))
    spread.repartitionByRange("cell", "slice").sortWithinPartitions("cell", "slice").write.parquet(f"{path}/rows")


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    model = json.loads(files.read_text(spark, f"{path}/model.json"))
    rows = spark.read.parquet(f"{path}/rows")
    sizes = rows.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / PIECE_ROWS).cast("int").alias("pieces")
    )
    return VectorIndex(
        rows, cut_lineage(sizes), np.array(model["centroids"]), np.array(model["words"])
    )


def _probes(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """``query_id, cell, place, vector``: the best cells of each query, by inner product."""
    centroids, size = index.centroids, index.centroids.shape[1]
    count = min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = scoring.unit_rows(batch.column(1), size)
            best = np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :count]
            at = np.repeat(np.arange(len(unit)), count)
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * size)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(at)), pa.array(best.ravel().astype(np.int32)),
                 pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(unit))),
                 pa.ListArray.from_arrays(offsets, pa.array(unit[at].ravel()))],
                names=["query_id", "cell", "place", "vector"],
            )

    return queries.select(
        F.col("doc_id").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")
    ).mapInArrow(run, "query_id bigint, cell int, place int, vector array<double>")


def probes_for(queries: DataFrame, index: VectorIndex, k: int = 10, recall: float = 0.95) -> int:
    """How many cells hold this share of the ``k`` nearest documents of a few queries.

    The queries are held against the whole corpus, so give a bounded sample.
    """
    wanted = nearest_documents(queries, index, k, index.cells).select("query_id", "doc_id")
    cells = _probes(queries, index, index.cells).select("query_id", "cell", "place")
    placed = wanted.join(index.rows.select("doc_id", "cell"), "doc_id").join(cells, ["query_id", "cell"])
    counts = {r["place"]: r["count"] for r in placed.groupBy("place").count().collect()}  # a row per cell
    missing = (1 - recall) * sum(counts.values())
    for place in sorted(counts, reverse=True):
        missing -= counts[place]
        if missing < 0:
            return place
    return 1


def _found(index: VectorIndex, keep: int, exact: bool):
    """Task of a (cell, piece, bucket): each query's ``keep`` best rows."""
    centroids, words = index.centroids, index.words
    size, none = centroids.shape[1], pa.table({
        "query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()),
        "score": pa.array([], pa.float64()),
    })

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return none
        vectors = asked.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, size)
        ids = rows.column("doc_id").to_numpy()
        if exact:
            unit = scoring.unit_rows(rows.column("embedding").combine_chunks(), size)
            scores = scoring.rounded(vectors @ unit.T)
        else:
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8)
            codes = codes.reshape(len(ids), len(words))
            cell = rows.column("cell")[0].as_py()
            scores = np.repeat((vectors @ centroids[cell])[:, None], len(ids), axis=1)
            for part, own in enumerate(_parts(vectors, len(words))):
                scores += (own @ words[part].T)[:, codes[:, part]]
        count = min(keep, len(ids))
        order = np.lexsort((np.broadcast_to(-ids, scores.shape), -scores), axis=1)[:, :count]
        return pa.table({
            "query_id": np.repeat(asked.column("query_id").to_numpy(), count),
            "doc_id": ids[order].ravel(),
            "score": np.take_along_axis(scores, order, axis=1).ravel(),
        })

    return run


def nearest_documents(
    queries: DataFrame, index: VectorIndex, k: int, probes: int, rerank: int | None = None
) -> DataFrame:
    """``query_id, doc_id, score, rank``: the first ``k`` of what the probed cells hold.

    ``queries``: ``doc_id, embedding``, keys unique.  ``rerank`` documents per query are scored
    exactly after their codes; None scores all of the probed cells exactly.
    """
    ship_package(queries.sparkSession)
    exact, keep = rerank is None, k if rerank is None else max(rerank, k)
    asked = cut_lineage(_probes(queries, index, probes))
    met = asked.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / PIECE_QUERIES).cast("int").alias("buckets")
    ).join(index.sizes, "cell")
    keys = ["cell", "piece", "bucket"]

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (
        asked.join(met, "cell")
        .withColumn("bucket", F.pmod(F.xxhash64("query_id"), F.col("buckets")).cast("int"))
        .withColumn("piece", every("pieces"))
        .select(*keys, "query_id", "vector")
    )
    right = (
        index.rows.select("cell", "slice", "doc_id", "embedding" if exact else "codes")
        .join(met, "cell")
        .withColumn("piece", F.pmod(F.col("slice"), F.col("pieces")).cast("int"))
        .withColumn("bucket", every("buckets"))
        .drop("slice", "buckets", "pieces")
    )
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _found(index, keep, exact), "query_id bigint, doc_id bigint, score double"
    )
    by_score = [F.col("score").desc(), F.col("doc_id").desc()]
    best = top_per_group(found, ["query_id"], by_score, keep)
    if exact:
        return best
    size = index.centroids.shape[1]

    @F.arrow_udf("double")
    def inner(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right = (scoring.unit_rows(x, size) for x in (a, b))
        return pa.array(scoring.rounded((left * right).sum(axis=1)))

    vectors = queries.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("_q"))
    scored = (
        best.select("query_id", "doc_id")
        .join(index.rows.select("doc_id", "embedding"), "doc_id")
        .join(vectors, "query_id")
        .select("query_id", "doc_id", inner(F.col("_q").cast("array<float>"), F.col("embedding")).alias("score"))
    )
    return top_per_group(scored, ["query_id"], by_score, k)
