"""Importance resampling towards a target, by hashed runs of one to three words.

Words are runs of ASCII letters and digits and of any character beyond ASCII, the
letters A-Z lowered.  Features are all runs of one to three consecutive words of
a text, joined by one space, repeats counted; a feature's bucket is the CRC-32 of
its bytes modulo ``BUCKETS``, worked out by position tables (``span_crc``).

Buckets are counted over all documents and all target texts; a bucket's gain is
``floor(1000 ln((t+1)(S+BUCKETS) / ((s+1)(T+BUCKETS))))``, whole thousandths, so a
document's weight is an exact sum whatever the order.  Its score adds Gumbel
noise that depends on its id alone; of the ``N`` documents with ``MIN_WORDS``
words at least the ``floor(SHARE N / 100)`` highest scores are drawn.

What reaches the driver is one count per bucket, ``BUCKETS`` at most, and N.
Documents are numbered by score in range-sorted pieces (``number_within``), so
neither the draw nor its order meets in one task.

Defined results: a null, empty or wordless text has no features and weight 0;
repeated rows score alike and are drawn one by one; ties go to the smaller
``doc_id``, null ids last, then to the smaller text hash; a null ``doc_id`` draws
its noise as an empty string; very long texts are read whole, feature by feature
in bounded slices; without target texts the gains come from the documents alone;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.span_crc import crc32_sql, span_crc32
from triagelake.llm.text_arrays import chunks, row_sums, utf8
from triagelake.llm.workers import prepare
from triagelake.operators.ranking import number_within
from triagelake.session import cut_lineage

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
SHARE = 5  # percent
SEED = "42"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class Words(NamedTuple):
    """Words of some rows laid out with one space behind each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # per row the number of its first word, and the total


def laid_out(raw: np.ndarray, offsets: np.ndarray) -> Words:
    base = int(offsets[0])
    low = _LOWER[raw[base : int(offsets[-1])]]
    rows = offsets - base
    inside = _WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[rows] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    lengths = stop - begin
    ends = np.cumsum(lengths + 1) - 1
    data = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    kept = np.flatnonzero(inside)
    data[np.arange(len(kept)) + np.repeat(np.arange(len(begin)), lengths)] = low[kept]
    return Words(data, ends - lengths, ends, np.searchsorted(begin, rows).astype(np.int64))


def feature_buckets(words: Words, size: int, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of ``size`` words that lies in one row, and per row the first."""
    counts = np.maximum(np.diff(words.first) - size + 1, 0)
    first = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(int(first[-1])) + np.repeat(words.first[:-1] - first[:-1], counts)
    crc = span_crc32(words.data, words.starts[at], words.ends[at + size - 1])
    return (crc % np.uint32(buckets)).astype(np.int64), first


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``text`` values lie in each bucket."""
    prepare(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            for a, b in chunks(offsets):
                words = laid_out(raw, offsets[a : b + 1])
                for size in range(1, LONGEST + 1):
                    total += np.bincount(feature_buckets(words, size, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch(
            [pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"]
        )

    table = (
        texts.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(count, "bucket int, n bigint")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    out = np.zeros(buckets, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio target / raw per bucket, each smoothed by one."""
    size = float(len(raw))
    above = (target + 1.0) * (raw.sum() + size)
    below = (raw + 1.0) * (target.sum() + size)
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight, tie`` of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            found = np.zeros((3, batch.num_rows), np.int64)
            for a, b in chunks(offsets):
                words = laid_out(raw, offsets[a : b + 1])
                found[0, a:b] = np.diff(words.first)
                for size in range(1, LONGEST + 1):
                    bucket, first = feature_buckets(words, size, len(gains))
                    found[1, a:b] += np.diff(first)
                    found[2, a:b] += row_sums(gains[bucket], first)
            yield pa.record_batch(
                [batch.column(0), *map(pa.array, found), batch.column(2)],
                names=["doc_id", "n_words", "n_features", "weight", "tie"],
            )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("tie"),
    ).mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, tie bigint")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Whole thousandths of Gumbel noise by the id's SHA-256."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    head = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((head + 0.5) / 4294967296.0)))


def draw(
    docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``.

    ``docs`` has ``doc_id`` and ``text``, ``target`` has ``text``; ``rank`` is
    1, 2, 3, ... for the documents drawn, else null.
    """
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    rows = weigh(docs, gains).select(
        "doc_id", "n_features", "weight", "tie",
        (F.col("weight") + noise(F.col("doc_id"))).alias("score"),
        (F.col("n_words") >= min_words).alias("eligible"),
    )
    rows = cut_lineage(rows)  # the texts are weighed once
    k = share * rows.filter("eligible").count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    place = F.when(F.col("eligible") & (F.col("place") <= k), F.col("place"))
    return number_within(rows, ["eligible"], order, "place").select(
        "doc_id", "n_features", "weight", "score", place.cast("bigint").alias("rank")
    )


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and draw of every document, towards the texts of ``benchmark``."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    target = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    return draw(docs.select("doc_id", "text"), target.select("text"))


_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
_RUNS_SQL = " UNION ALL ".join(
    f"SELECT d, r, array_to_string(w[i : i + {n - 1}], ' ') AS f "
    f"FROM (SELECT d, r, w, unnest(range(1, len(w) - {n - 2})) AS i FROM t WHERE len(w) >= {n})"
    for n in range(1, LONGEST + 1)
)
OP12_SQL = f"""
WITH t AS MATERIALIZED (
  SELECT true AS d, row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents UNION ALL
  SELECT false, row_number() OVER (), NULL, {_WORDS_SQL} FROM benchmark),
n AS (SELECT r, doc_id, len(w) AS words FROM t WHERE d),
f AS MATERIALIZED (SELECT d, r, f, count(*) AS c FROM ({_RUNS_SQL}) GROUP BY d, r, f),
h AS MATERIALIZED (SELECT f, {crc32_sql('f')} % {BUCKETS} AS b FROM (SELECT DISTINCT f FROM f)),
p AS MATERIALIZED (SELECT d, r, b, sum(c)::BIGINT AS c FROM f JOIN h USING (f) GROUP BY d, r, b),
z AS (SELECT coalesce(sum(c) FILTER (d), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (NOT d), 0)::DOUBLE AS t FROM p),
g AS MATERIALIZED (
  SELECT b, CAST(floor(1000 * ln((q + 1) * (z.s + {BUCKETS}) / ((k + 1) * (z.t + {BUCKETS})))) AS BIGINT) AS gain
  FROM (SELECT b, coalesce(sum(c) FILTER (d), 0)::DOUBLE AS k, coalesce(sum(c) FILTER (NOT d), 0)::DOUBLE AS q
        FROM p GROUP BY b), z),
w AS (SELECT r, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM p JOIN g USING (b)
      WHERE d GROUP BY r),
x AS (
  SELECT r, doc_id, words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM n LEFT JOIN w USING (r)),
y AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
o AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM y WHERE words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score,
       CASE WHEN k <= {SHARE} * (SELECT count(*) FROM o) // 100 THEN k END AS rank
FROM y LEFT JOIN o USING (r)
"""
