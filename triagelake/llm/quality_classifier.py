"""Quality classifier: importance resampling by hashed n-grams.

Two bags of hashed words and word pairs are counted in one pass: all documents
(raw) and the documents labelled good (target).  A document's log weight is the
sum over its n-grams of log target / raw, the target smoothed towards raw; for a
document of more than ``TYPICAL`` n-grams it is brought down to that many, or its
length would decide.
Documents are then drawn without replacement in proportion to their weights:
log weight plus Gumbel noise, and the k highest are kept.

``k`` is the number of documents whose weight reaches a cut.  The cut is set by
cross-fitting: target documents are weighed by a model that has not seen them,
and all but ``LOSS`` of them must pass it with ``MARGIN`` to spare, so that the
noise decides between doubtful documents only.

A few bad words in a clean text do not move that sum, so a document is also judged
by its worst ``WORST`` stems (first ``STEM`` bytes of a word, which the forms of a
word share), however long it is.  For either kind of bad label, toxic and junk
(quality 0), a stem's log ratio is that of the clean documents that have it to the
bad ones, smoothed by ``SMOOTH_SHARE`` of the bad documents.  A kind's cut is set
from held-out labels of both sides: of the cuts that lose at most ``LOSS`` of the
clean documents, the one that parts them best from the bad ones.  A document below
it has ``REJECTED`` off its log weight, so noise cannot bring it back.

Labels are a sample of at most ``LABEL_ROWS`` labelled documents (lowest hash of
the id), joined by broadcast; every count and weight covers all documents.  The
model is a table of ``BUCKETS`` numbers.

Defined results: a document without words (null, empty, white space) has log
weight 0 and is rejected; repeated rows share weight and noise and are kept or
rejected together, so ties at the cut may keep more than k; of repeated labels
the worst counts, null labels are ignored; without good labels every weight is 0
and all documents with words are kept; a kind without labels in both halves judges
nothing; an empty table gives no rows; other
columns are passed through, but for those with the name of a result, which
replaces them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.columns import passed, whole_row
from triagelake.llm.text_arrays import _SPACE, chunks, mix, row_sums, utf8, word_hashes
from triagelake.llm.workers import prepare
from triagelake.session import cut_lineage

BITS = 18
BUCKETS = 1 << BITS
SMOOTHING = 50.0
TYPICAL = 200
LABEL_ROWS = 100_000
LOSS = 0.002
MARGIN = 2.0
STEM = 6
WORST = 2
SMOOTH_SHARE = 0.002
REJECTED = 1e4  # more than TYPICAL log ratios come to
KINDS = ("toxic", "junk")
SEED = 9
RESULTS = ("log_weight", "sampling_key", "kept")
WEIGHT = (
    "struct<words:bigint,whole:double,first:double,second:double,"
    "toxic:struct<whole:double,first:double,second:double>,"
    "junk:struct<whole:double,first:double,second:double>>"
)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Model(NamedTuple):
    """Log ratios per bucket: of all labels, and of either half of them."""

    whole: np.ndarray
    first: np.ndarray
    second: np.ndarray
    stems: tuple[np.ndarray, ...] = ()  # per kind, three rows as above


class Cuts(NamedTuple):
    """The worst stems that pass, per kind, and the key that the draw's last document has."""

    toxic: float
    junk: float
    key: float = -np.inf


def _buckets(
    raw: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of it and the next, whether there is one, row offsets)."""
    low = _LOWER[raw[offsets[0] : offsets[-1]]]
    hashes, first = word_hashes(low, offsets - offsets[0])
    shift = np.uint64(64 - BITS)
    ends = np.zeros(len(hashes) + 1, bool)
    ends[first[1:]] = True
    following = ~ends[1:]
    after = np.concatenate((hashes[1:], hashes[:1]))
    pairs = mix(hashes * np.uint64(3) + after)
    return (hashes >> shift).astype(np.int64), (pairs >> shift).astype(np.int64), following, first


def _stems(raw: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bucket of the stem of each word."""
    low = _LOWER[raw[offsets[0] : offsets[-1]]]
    rows = offsets - offsets[0]
    starts = ~_SPACE[low]
    edges = np.zeros(len(low) + 1, bool)
    edges[rows] = True
    starts[1:] &= _SPACE[low[:-1]] | edges[1:-1]
    begins = np.flatnonzero(starts)
    padded = np.concatenate((low, np.full(STEM, 32, np.uint8)))
    value = np.zeros(len(begins), np.uint64)
    last = np.repeat(rows[1:], np.diff(first))  # a word ends with its row
    inside = np.ones(len(begins), bool)
    for k in range(STEM):
        byte = padded[begins + k]
        inside &= ~_SPACE[byte] & (begins + k < last)
        value = (value << np.uint64(8)) | np.where(inside, byte, 0).astype(np.uint64)
    return (mix(value) >> np.uint64(64 - BITS)).astype(np.int64)


def label_sample(labels: DataFrame, rows: int = LABEL_ROWS) -> DataFrame:
    """(doc_id, good, kind, half) of a bounded sample of labelled documents.

    ``kind`` is 0 for good ones, else 1 and the place in ``KINDS``.
    """
    known = labels.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("quality").cast("int").alias("quality"),
        F.col("toxic").cast("int").alias("toxic"),
    ).dropna()
    hashed = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    return (
        known.groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(hashed, "doc_id")
        .limit(rows)
        .select(
            "doc_id",
            ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"),
            F.when(F.col("toxic") != 0, 1).when(F.col("quality") != 1, 2).otherwise(0)
            .alias("kind"),
            F.pmod(hashed, F.lit(2)).cast("int").alias("half"),
        )
    )


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Count n-grams of all documents and stems of labelled ones; the ratios per bucket."""
    prepare(docs.sparkSession)
    sides = 2 * (1 + len(KINDS))
    names = ["raw", "first", "second", *(f"side{k}" for k in range(sides))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # raw, target by half; documents with a stem by kind and half, at last all of them
        counts = np.zeros((3 + sides, BUCKETS + 1), np.int64)
        size = BUCKETS + 1
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            side = batch.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                single, pair, following, first = _buckets(raw, offsets[a : b + 1])
                row = np.repeat(side[a:b], np.diff(first))
                counts[0] += np.bincount(single, minlength=size)
                counts[0] += np.bincount(pair[following], minlength=size)
                for k in (0, 1):
                    mine = row == k
                    counts[1 + k] += np.bincount(single[mine], minlength=size)
                    counts[1 + k] += np.bincount(pair[mine & following], minlength=size)
                stem = _stems(raw, offsets[a : b + 1], first)
                doc = np.repeat(np.arange(b - a), np.diff(first))
                labelled = row >= 0
                once = np.unique(doc[labelled] * BUCKETS + stem[labelled])
                found = side[a:b][once // BUCKETS]
                for k in range(sides):
                    counts[3 + k] += np.bincount(once[found == k] % BUCKETS, minlength=size)
                    counts[3 + k, BUCKETS] += np.count_nonzero(side[a:b] == k)
        used = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(used), 50_000):
            part = used[at : at + 50_000]
            yield pa.record_batch(
                [pa.array(part.astype(np.int32)), *(pa.array(c[part]) for c in counts)],
                names=["bucket", *names],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    known = label_sample(labels).select(
        "doc_id", (F.col("kind") * 2 + F.col("half")).alias("side")
    )
    table = (
        texts.join(F.broadcast(known), "doc_id", "left")
        .select("text", "side")
        .mapInArrow(count, ", ".join(["bucket int", *(f"{c} bigint" for c in names)]))
        .groupBy("bucket")
        .agg(*[F.sum(c).alias(c) for c in names])
        .toArrow()
    )
    bucket = table.column("bucket").to_numpy()
    counts = np.zeros((len(names), BUCKETS + 1))
    for k, name in enumerate(names):
        counts[k, bucket] = table.column(name).to_numpy()
    raw, first, second = counts[:3, :BUCKETS]
    stems = tuple(
        np.stack([
            _stem_ratio(c, b)
            for c, b in zip(_halves(counts[3:5]), _halves(counts[at : at + 2]), strict=True)
        ])
        for at in range(5, len(counts), 2)
    )
    return Model(*(_ratio(t, raw) for t in (first + second, first, second)), stems)


def _halves(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return counts[0] + counts[1], counts[0], counts[1]


def _stem_ratio(clean: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log of clean / bad documents that have a stem, 0 where it is above; all different."""
    if not clean[-1] or not bad[-1]:
        return np.zeros(BUCKETS)
    least = max(SMOOTH_SHARE * bad[-1], 0.5)
    expected = clean[:-1] * (bad[-1] / clean[-1])
    ratio = np.minimum(np.log((expected + least) / (bad[:-1] + least)), 0.0)
    return ratio - np.arange(BUCKETS) * 1e-12


def _ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target / raw), the target having seen ``SMOOTHING`` more n-grams as raw has."""
    if not target.sum():
        return np.zeros(BUCKETS)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + SMOOTHING) / (expected + SMOOTHING))


def _worst(ratio: np.ndarray, stem: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row the sum of the ``WORST`` lowest ratios of different stems."""
    sums = np.zeros(len(first) - 1)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return sums
    values, lengths = ratio[stem], np.diff(first)[full]
    for _ in range(WORST):
        least = np.minimum.reduceat(values, first[:-1][full])
        sums[full] += least
        values[values == np.repeat(least, lengths)] = 0.0
    return sums


def log_weight(text: Column, model: Model) -> Column:
    """A struct column: number of words, and log weight and worst stems by each of the three ratios.

    Declared non-deterministic for the optimizer's sake: a filter on the weight
    would otherwise weigh every text a second time, in workers of its own.
    """

    @F.arrow_udf(WEIGHT)
    def weigh(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            raw, offsets = utf8(column)
            words = np.zeros(len(column), np.int64)
            sums = np.zeros((3, len(column)))
            worst = np.zeros((len(KINDS), 3, len(column)))
            for a, b in chunks(offsets):
                single, pair, following, first = _buckets(raw, offsets[a : b + 1])
                words[a:b] = np.diff(first)
                for k, ratio in enumerate(model[:3]):
                    values = ratio[single] + np.where(following, ratio[pair], 0.0)
                    sums[k, a:b] = row_sums(values, first)
                stem = _stems(raw, offsets[a : b + 1], first)
                for kind, ratios in enumerate(model.stems):
                    for k, ratio in enumerate(ratios):
                        worst[kind, k, a:b] = _worst(ratio, stem, first)
            sums *= np.minimum(1.0, TYPICAL / np.maximum(2 * words - 1, 1))
            yield pa.StructArray.from_arrays(
                [
                    pa.array(words), *(pa.array(s) for s in sums),
                    *(pa.StructArray.from_arrays([pa.array(x) for x in kind],
                                                 names=["whole", "first", "second"])
                      for kind in worst),
                ],
                names=["words", "whole", "first", "second", *KINDS],
            )

    return weigh.asNondeterministic()(text.cast("string"))


def gumbel(*identity: Column) -> Column:
    """Standard Gumbel noise that depends on the columns alone."""
    low = F.lit(float(1 << 53))
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *identity), 11).cast("double")
    return -F.log(-F.log((spread + 0.5) / low))


def kth_largest(values: DataFrame, name: str, k: int) -> float:
    """The ``k``-th largest of a column of doubles, exactly, by narrowing a histogram.

    Only counts of ranges, and at last one range of few values, reach
    the driver; a range of one repeated value ends the search.
    """
    bins, few = 4096, 20_000
    column = F.col(name)
    low, high, count = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if not count or k >= count:
        return -np.inf if low is None else low
    above, inside = 0, values
    while count > few and low < high:
        place = F.least(
            F.floor((column - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1)
        )
        rows = sorted(
            inside.groupBy(place.alias("bin"))
            .agg(F.min(column).alias("low"), F.max(column).alias("high"),
                 F.count(column).alias("n"))
            .collect(),
            key=lambda r: -r["bin"],
        )
        for row in rows:
            if above + row["n"] >= k:
                low, high, count = row["low"], row["high"], row["n"]
                break
            above += row["n"]
        inside = values.filter(column.between(low, high))
    if low == high:
        return low
    kept = sorted((r[0] for r in inside.select(name).collect()), reverse=True)
    return kept[k - above - 1]


def _weighed(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` as struct ``_doc``, with judgements and noise."""
    rows = docs.select(
        whole_row(),
        log_weight(F.col("text"), model).alias("_w"),
        F.xxhash64("text").alias("_text"),
    )
    noise = gumbel(F.col("_doc.doc_id").cast("bigint"), F.col("_text"))
    return rows.select("_doc", "_w", noise.alias("_noise"))


def _rejected(cuts: Cuts) -> Column:
    return (F.col("_w.toxic.whole") < F.lit(float(cuts.toxic))) | (
        F.col("_w.junk.whole") < F.lit(float(cuts.junk))
    )


def _weight(cuts: Cuts) -> Column:
    return F.col("_w.whole") - F.when(_rejected(cuts), F.lit(REJECTED)).otherwise(F.lit(0.0))


def _unseen(name: str) -> Column:
    """A judgement of a labelled document by the labels of the other half."""
    held = F.col(f"_w.{name}" if name else "_w")
    return F.when(F.col("half") == 0, held["second"]).otherwise(held["first"])


def best_cut(clean: dict[int, int], bad: dict[int, int]) -> float:
    """The cut, between scores given with their counts, that parts clean from bad best.

    At most ``LOSS`` of the clean lie below it; it lies halfway to the next score.
    Without a cut that rejects a larger share of the bad it is minus infinity.
    """
    scores = np.array(sorted({*clean, *bad}))
    if not clean or not bad:
        return -np.inf
    lost = np.cumsum([clean.get(x, 0) for x in scores.tolist()]) / sum(clean.values())
    caught = np.cumsum([bad.get(x, 0) for x in scores.tolist()]) / sum(bad.values())
    gain = np.where(lost <= LOSS, caught - lost, 0.0)[:-1]
    if not len(gain) or gain.max() <= 0:
        return -np.inf
    at = int(gain.argmax())
    return float(scores[at] + scores[at + 1] + 1) / 2


def cut_points(docs: DataFrame, labels: DataFrame, model: Model) -> Cuts:
    """The cuts of either kind, and the key that the k-th document reaches."""
    rows = _weighed(docs.select("doc_id", "text"), model).select(
        F.col("_doc.doc_id").cast("bigint").alias("doc_id"), "_w", "_noise"
    ).filter(F.col("_w.words") > 0)
    rows = cut_lineage(rows)
    # at most LABEL_ROWS documents and their repeats
    known = rows.join(F.broadcast(label_sample(labels)), "doc_id")
    steps = 1000  # of a score's unit: the driver gets counts of steps
    held = F.explode(F.array(*[
        F.struct(F.lit(k + 1).alias("of"),
                 F.floor(_unseen(name) * steps).cast("int").alias("step"))
        for k, name in enumerate(KINDS)
    ]))
    seen: dict[tuple[int, bool], dict[int, int]] = {}
    counted = known.select("kind", held.alias("held")).filter(
        (F.col("kind") == 0) | (F.col("kind") == F.col("held.of"))
    )
    for row in counted.groupBy("held.of", "kind", "held.step").count().collect():
        seen.setdefault((row["of"], row["kind"] == 0), {})[row["step"]] = row["count"]
    cuts = Cuts(*(
        best_cut(seen.get((k, True), {}), seen.get((k, False), {})) / steps
        for k in range(1, len(KINDS) + 1)
    ))
    unseen = known.filter("good").select(_unseen("").alias("w"))
    lowest = unseen.agg(F.percentile_approx("w", F.lit(LOSS), F.lit(10_000))).first()[0]
    if lowest is None:
        return cuts
    k = rows.filter(_weight(cuts) >= F.lit(min(lowest, 0.0) - MARGIN)).count()
    keys = rows.select((_weight(cuts) + F.col("_noise")).alias("_key"))
    return cuts._replace(key=kth_largest(keys, "_key", k) if k else np.inf)


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its log_weight, and whether the draw keeps it."""
    model = fit(docs, labels)
    cuts = cut_points(docs, labels, model)
    return _weighed(docs, model).select(
        *passed(docs, RESULTS),
        _weight(cuts).alias("log_weight"),
        (_weight(cuts) + F.col("_noise")).alias("sampling_key"),
        _drawn(cuts).alias("kept"),
    )


def _drawn(cuts: Cuts) -> Column:
    key = _weight(cuts) + F.col("_noise")
    return (F.col("_w.words") > 0) & (key >= F.lit(float(cuts.key)))


def sampled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the draw keeps."""
    model = fit(docs, labels)
    cuts = cut_points(docs, labels, model)
    return _weighed(docs, model).filter(_drawn(cuts)).select(*passed(docs))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weight and draw of every document of ``documents``."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    return resample(docs.select("doc_id", "text"), labels).drop("text")
