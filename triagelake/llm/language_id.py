"""Language identification: spans of one language within a text.

Every letter gives a trigram with its neighbours (anything but a letter counts
as one boundary sign), and a word's score for a language is the sum of its
trigrams' log frequencies there.  Ranges of code points give each word a script,
and only languages written in that script are candidates for it.  A Viterbi pass
over a document's words, with a penalty for every switch, labels spans; the
document's language is the one whose spans hold the most letters, not counting
words in a script that no language uses.

The score is the share of all letters in that language's spans, less where they
fit it badly: the mean log frequency of the letters is held against what texts of
the language reach that the model has not seen.  For that the training texts are
cut in two halves by a hash of the text, so that copies stay together, and each
half is scored by a model of the other one; held-out rows have no part in it.  The
floor lies ``LOSS`` of those texts deep: their distances from the language's mean,
each measured by the spread that texts of its length have, are one distribution
over all languages and lengths, so there is a floor at any size of table.
``fit`` is the distance to it; a text below it is not taken for an identified one.

The model is counted over all labelled documents, pre-aggregated per task, and
has ``BUCKETS`` numbers per language.  Scoring is one narrow pass.  Viterbi runs
over the words of many documents side by side, one word of each at a time.

Defined results: a null text, or one without letters, is ``und`` with score 0
and no spans; words in a script that no language uses are neutral, and a text of such words alone
has the first language and score 0; a language without texts to set a floor takes
the mean of the others, and without any there is no floor; ties go to
the language first in code-point order; repeated rows get equal results; with no
labelled text everything is ``und``; an empty table gives no rows; ``identify``
is a column, so a table keeps the columns it has.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.columns import passed, whole_row
from triagelake.llm.text_arrays import row_sums
from triagelake.llm.workers import prepare

BITS = 16
BUCKETS = 1 << BITS
SMOOTHING = 0.5
SWITCH = 12.0  # nats
SCRIPT_SHARE = 0.01  # of a language's letters, to be a candidate in a script
GROUP_CHARS = 4_000_000
CHUNK_CHARS = 250_000
OUT_OF_SCRIPT = -1000.0
UNKNOWN = "und"
RESULT = (
    "struct<lang:string,score:double,fit:double,"
    "spans:array<struct<lang:string,first_word:int,words:int>>>"
)

#: First code points of script ranges and their script; 0 is any other.
SCRIPTS = (
    (0x0000, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6),
    (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 0), (0x0B80, 9), (0x0C00, 0), (0x0E00, 10),
    (0x0E80, 0), (0x10A0, 11), (0x1100, 12), (0x1200, 13), (0x1380, 0), (0x1E00, 1), (0x1F00, 2),
    (0x2000, 0), (0x3040, 14), (0x3100, 0), (0x3130, 12), (0x3190, 0), (0x31F0, 14), (0x3200, 0),
    (0x3400, 15), (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 15), (0xFB00, 1), (0xFB13, 0),
    (0xFB50, 6), (0xFE00, 0), (0x20000, 15), (0x30000, 0),
)
SCRIPT_COUNT = 16
LOSS = 0.005
DEEP = 2.576  # standard deviations at LOSS of a normal distribution
LENGTHS = 32  # powers of two of letters
STEP = 0.02  # nats per letter
LEAST_SCORE = 0.3  # of a document that the pipeline keeps


class Model(NamedTuple):
    languages: tuple[str, ...]
    scores: np.ndarray  # buckets x languages, log frequencies
    candidates: np.ndarray  # scripts x languages, whether a language uses a script
    floors: np.ndarray | None = None  # lengths x languages, mean log frequency that fits


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter, its lower case, its script."""
    letter = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        character = chr(point)
        if unicodedata.category(character)[0] == "L":
            letter[point] = True
            small = character.lower()
            if len(small) == 1:
                lower[point] = ord(small)
    starts = np.array([s for s, _ in SCRIPTS])
    scripts = np.array([k for _, k in SCRIPTS], np.uint8)
    script = scripts[np.searchsorted(starts, np.arange(0x110000), "right") - 1]
    return letter, lower, script


class _Letters(NamedTuple):
    """All letters of some texts, with their trigram bucket, script, word and text."""

    bucket: np.ndarray
    script: np.ndarray
    word: np.ndarray  # number of the letter's word among all words with a letter
    words: np.ndarray  # offset of each text's first such word
    place: np.ndarray  # of each such word among all words of its text


def _letters(texts: list[str]) -> _Letters:
    letter, lower, scripts = _tables()
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4")
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    rows = np.concatenate(([0], np.cumsum(lengths)))
    is_letter = letter[points]
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    signs = np.where(is_letter, lower[points], 0).astype(np.uint64)
    before = np.concatenate((np.zeros(1, np.uint64), signs[:-1]))
    after = np.concatenate((signs[1:], np.zeros(1, np.uint64)))
    at = np.flatnonzero(is_letter)
    mixed = (before[at] * np.uint64(0x9E3779B1) + signs[at]) * np.uint64(0x85EBCA6B) + after[at]
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(64 - BITS)).astype(np.int64)
    starts = ~space
    starts[1:] &= space[:-1]  # texts are parted by a line break
    number = np.cumsum(starts) - 1  # of the word a point lies in
    with_letter = np.unique(number[at])
    word = np.searchsorted(with_letter, number[at])
    first_word = np.concatenate(([0], np.cumsum(starts)))[rows]
    words = np.searchsorted(with_letter, first_word)
    text = np.repeat(np.arange(len(texts)), np.diff(words))
    return _Letters(bucket, scripts[points[at]], word, words, with_letter - first_word[:-1][text])


def _groups(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` characters; a longer text is a range of its own."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > limit:
            yield first, k
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def _counted(docs: DataFrame) -> tuple[tuple[str, ...], np.ndarray]:
    """Languages, and counts (halves x trigrams and scripts x languages) over all rows.

    ``docs``: text, lang and ``half`` (0 or 1).  The driver gets ``BUCKETS`` counts
    per language and half.
    """
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sides = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for a, b in _groups(texts, CHUNK_CHARS):
                found = _letters(texts[a:b])
                text = np.repeat(np.arange(b - a), np.diff(found.words))[found.word]
                kinds = sorted(set(sides[a:b]))
                number = {x: k for k, x in enumerate(kinds)}
                of = np.array([number[x] for x in sides[a:b]], np.int64)[text]
                for k, kind in enumerate(kinds):
                    mine = of == k
                    if kind not in counts:
                        counts[kind] = np.zeros(BUCKETS + SCRIPT_COUNT, np.int64)
                    counts[kind][:BUCKETS] += np.bincount(found.bucket[mine], minlength=BUCKETS)
                    counts[kind][BUCKETS:] += np.bincount(
                        found.script[mine], minlength=SCRIPT_COUNT
                    )
        for (lang, half), table in counts.items():
            used = np.flatnonzero(table)
            yield pa.record_batch(
                [pa.array([lang] * len(used), pa.string()), pa.array([half] * len(used), pa.int32()),
                 pa.array(used.astype(np.int32)), pa.array(table[used])],
                names=["lang", "half", "bucket", "n"],
            )

    table = (
        docs.select(F.col("text").cast("string").alias("text"),
                    F.col("lang").cast("string").alias("lang"), F.col("half").cast("int").alias("half"))
        .dropna()
        .mapInArrow(count, "lang string, half int, bucket int, n bigint")
        .groupBy("lang", "half", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = table.column("lang").to_pylist()
    languages = tuple(sorted(set(names)))
    place = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((2, BUCKETS + SCRIPT_COUNT, len(languages)))
    columns = np.array([place[x] for x in names], np.int64)
    at = (table.column("half").to_numpy(), table.column("bucket").to_numpy(), columns)
    counts[at] = table.column("n").to_numpy()
    return languages, counts


def _model(languages: tuple[str, ...], counts: np.ndarray) -> Model:
    seen = counts[:BUCKETS]
    total = np.maximum(seen.sum(axis=0), 1.0)
    scores = np.log((seen + SMOOTHING) / (total + SMOOTHING * BUCKETS)).astype(np.float32)
    return Model(languages, scores, counts[BUCKETS:] >= SCRIPT_SHARE * total)


def train(docs: DataFrame) -> Model:
    """Count trigrams and scripts per language over all rows of (text, lang); no floors."""
    languages, counts = _counted(docs.select("text", "lang", F.lit(0).alias("half")))
    return _model(languages, counts.sum(axis=0))


def _viterbi(scores: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The best label of every word, with ``SWITCH`` off for each change within a text."""
    lengths = np.diff(words)
    order = np.argsort(-lengths, kind="stable")
    firsts, lengths = words[:-1][order], lengths[order]
    labels = np.zeros(len(scores), np.int32)
    if not len(scores):
        return labels
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # texts longer than each step
    best_before = np.zeros(len(scores), np.int32)
    switched = np.zeros(scores.shape, bool)
    total = scores[firsts[: active[0]]].copy() if steps else scores[:0]
    ends = np.zeros(len(lengths), np.int32)
    for step in range(1, steps):
        live = active[step]
        if live < len(total):
            ends[live : len(total)] = total[live:].argmax(axis=1)
            total = total[:live]
        at = firsts[:live] + step
        top = total.argmax(axis=1)
        high = total[np.arange(live), top] - np.float32(SWITCH)
        change = total < high[:, None]
        total = np.where(change, high[:, None], total)
        total -= total.max(axis=1, keepdims=True)
        total += scores[at]
        switched[at] = change
        best_before[at] = top
    ends[: len(total)] = total.argmax(axis=1)
    state = ends.copy()
    for step in range(steps - 1, 0, -1):
        live = active[step]
        at = firsts[:live] + step
        now = state[:live]
        labels[at] = now
        state[:live] = np.where(switched[at, now], best_before[at], now)
    present = active[0] if steps else 0
    labels[firsts[:present]] = state[:present]
    return labels


def _identify(texts: list[str], model: Model) -> pa.StructArray:
    """Language, score, fit and spans of each text; without floors, fit is the mean itself."""
    kinds = len(model.languages)
    scores, words, sizes, places, offset = [], [np.zeros(1, np.int64)], [], [], 0
    neutral = [np.zeros(0, bool)]
    for a, b in _groups(texts, CHUNK_CHARS):
        found = _letters(texts[a:b])
        count = int(found.words[-1])
        table = np.zeros((count, kinds), np.float32)
        if count:
            starts = np.searchsorted(found.word, np.arange(count))
            table = np.add.reduceat(model.scores[found.bucket], starts, axis=0)
            usable = model.candidates[found.script[starts]]
            table = np.where(usable, table, np.float32(OUT_OF_SCRIPT))
            neutral.append(~usable.any(axis=1))
            table[neutral[-1]] = 0
            sizes.append(np.diff(np.append(starts, len(found.word))))
        scores.append(table)
        words.append(found.words[1:] + offset)
        places.append(found.place)
        offset += count
    rows = np.concatenate(words)
    every = np.concatenate(scores) if scores else np.zeros((0, kinds), np.float32)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    labels = _viterbi(every, rows)
    counted = np.where(np.concatenate(neutral), 0, size)
    held = np.stack(
        [row_sums(np.where(labels == k, counted, 0).astype(np.int64), rows) for k in range(kinds)],
        axis=1,
    )
    letters = row_sums(size.astype(np.int64), rows)
    chosen = held.argmax(axis=1)
    most = held[np.arange(len(texts)), chosen]
    share = most / np.maximum(letters, 1)
    winner = np.repeat(chosen, np.diff(rows))
    own = every[np.arange(len(labels)), winner].astype(np.float64)
    fit = row_sums(np.where(labels == winner, own, 0.0), rows) / np.maximum(most, 1)
    if model.floors is not None:
        fit = fit - model.floors[_length(most), chosen]
        share = share * np.exp(np.minimum(fit, 0.0))
    names = np.array([*model.languages, UNKNOWN], object)
    # spans: runs of one label within a text
    start = np.ones(len(labels), bool)
    start[1:] = labels[1:] != labels[:-1]
    start[rows[:-1][np.diff(rows) > 0]] = True
    begins = np.flatnonzero(start)
    of_text = np.searchsorted(begins, rows)
    lasts = np.append(begins, len(labels))[1:] - 1
    spans = pa.StructArray.from_arrays(
        [
            pa.array(names[labels[begins]], pa.string()),
            pa.array(place[begins].astype(np.int32)),
            pa.array((place[lasts] - place[begins] + 1).astype(np.int32)),
        ],
        names=["lang", "first_word", "words"],
    )
    return pa.StructArray.from_arrays(
        [
            pa.array(names[np.where(letters > 0, chosen, kinds)], pa.string()),
            pa.array(share.astype(np.float64)),
            pa.array(fit, mask=(most == 0) | ~np.isfinite(fit)),
            pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), spans),
        ],
        names=["lang", "score", "fit", "spans"],
    )


def _length(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), LENGTHS - 1)


def identify(text: Column, model: Model) -> Column:
    """A struct column: lang, score (share of letters in its spans, by fit), fit and spans."""

    @F.arrow_udf(RESULT)
    def label(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = [t or "" for t in column.to_pylist()]
            parts = [_identify(texts[a:b], model) for a, b in _groups(texts, GROUP_CHARS)]
            yield pa.concat_arrays(parts) if parts else _identify([], model)

    if not model.languages:
        return F.struct(
            F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("fit"),
            F.array().cast("array<struct<lang:string,first_word:int,words:int>>").alias("spans"),
        )
    return label(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id leaves 2 by 4."""
    remainder = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
    return F.coalesce(remainder == 2, F.lit(False))


def train_on(docs: DataFrame) -> Model:
    """The model of all labelled documents that are not held out; nothing else is read."""
    rows = docs.filter(~held_out(F.col("doc_id"))).select(
        "text", "lang", F.pmod(F.xxhash64(F.lit(7), F.col("text")), F.lit(2)).cast("int").alias("half")
    )
    languages, counts = _counted(rows)
    model = _model(languages, counts.sum(axis=0))
    if not languages:
        return model
    return model._replace(floors=_floors(rows, [_model(languages, c) for c in counts]))


def _floors(rows: DataFrame, halves: list[Model]) -> np.ndarray:
    """Floors (lengths x languages) from texts scored by the model of the other half.

    The driver gets counts by language, length and step of the mean.
    """
    place = {x: k for k, x in enumerate(halves[0].languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            half = batch.column(2).to_numpy(zero_copy_only=False)
            for k, other in enumerate(reversed(halves)):
                mine = batch.filter(pa.array(half == k))
                texts, langs = mine.column(0).to_pylist(), mine.column(1).to_pylist()
                for a, b in _groups(texts, GROUP_CHARS):
                    found = _identify(texts[a:b], other)
                    got = zip(
                        langs[a:b], found.field("lang").to_pylist(),
                        found.field("fit").to_pylist(), _held(texts[a:b], found), strict=True,
                    )
                    for lang, best, mean, length in got:
                        if lang == best and mean is not None:
                            key = (place[lang], length, int(np.floor(mean / STEP)))
                            counts[key] = counts.get(key, 0) + 1
        if counts:
            columns = [*zip(*counts, strict=True), tuple(counts.values())]
            yield pa.record_batch(
                [pa.array(c, pa.int64()) for c in columns], names=["lang", "length", "step", "n"]
            )

    table = (
        rows.select(F.col("text").cast("string").alias("text"),
                    F.col("lang").cast("string").alias("lang"), "half")
        .dropna()
        .mapInArrow(count, "lang bigint, length bigint, step bigint, n bigint")
        .groupBy("lang", "length", "step")
        .agg(F.sum("n").alias("n"))
        .orderBy("lang", "length", "step")
        .toArrow()
    )
    return fitted_floors(*(table.column(c).to_numpy() for c in ("lang", "length", "step", "n")), len(place))


def fitted_floors(
    lang: np.ndarray, length: np.ndarray, step: np.ndarray, n: np.ndarray, kinds: int
) -> np.ndarray:
    """Floors (lengths x languages) from counts of means by language, length and step.

    The spread of a mean over ``x`` letters is taken as ``a + b / x``.  The depth is
    that of ``LOSS`` of the distances, and no less than a normal distribution has it,
    a little more for few texts.
    """
    if not len(n):
        return np.full((LENGTHS, kinds), -np.inf)
    value, weight = (step + 0.5) * STEP, n.astype(np.float64)
    total = np.bincount(lang, weight, minlength=kinds)
    means = np.bincount(lang, weight * value, minlength=kinds) / np.maximum(total, 1)
    means[total == 0] = means[total > 0].mean()
    away = value - means[lang]
    letters = 1.5 * 2.0 ** np.arange(LENGTHS)
    held = np.bincount(length, weight, minlength=LENGTHS)
    variance = np.bincount(length, weight * away**2, minlength=LENGTHS) / np.maximum(held, 1)
    # weighted least squares of the variance by length, neither part below 0
    design = np.stack([np.ones(LENGTHS), 1 / letters], axis=1)
    scale = np.sqrt(held) * np.sqrt(letters)
    parts = np.linalg.lstsq(design * scale[:, None], variance * scale, rcond=None)[0]
    if parts.min() < 0:
        keep = int(np.argmax(parts))
        own = design[:, keep] * scale
        parts = np.zeros(2)
        parts[keep] = (own @ (variance * scale)) / max(own @ own, 1e-300)
    spread = np.sqrt(np.maximum(design @ np.maximum(parts, 0), STEP**2))
    apart = away / spread[length]
    order = np.argsort(apart, kind="stable")
    reached = np.cumsum(weight[order])
    seen = apart[order][int(np.searchsorted(reached, LOSS * reached[-1], "right"))]
    depth = min(seen, -DEEP * (1 + 2 / np.sqrt(reached[-1])))
    return means[None, :] + depth * spread[:, None]


def _held(texts: list[str], found: pa.StructArray) -> list[int]:
    """The length class of each text's letters in its language."""
    letter = _tables()[0]
    sizes = np.array([
        np.count_nonzero(letter[np.frombuffer(t.encode("utf-32-le"), "<u4")]) for t in texts
    ], np.float64)
    share = found.field("score").to_numpy(zero_copy_only=False)
    return _length(np.rint(sizes * share)).tolist()


def identified_documents(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that fit a learned language, which holds ``least`` of their letters."""
    prepare(docs.sparkSession)
    found = docs.select(whole_row(), identify(F.col("text"), train_on(docs)).alias("_found"))
    fits = F.coalesce(F.col("_found.fit") >= 0, F.lit(True))
    known = (F.col("_found.lang") != UNKNOWN) & (F.col("_found.score") >= least) & fits
    return found.filter(known).select(*passed(docs))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document of ``documents``."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    prepare(spark)
    model = train_on(docs)
    rows = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        identify(F.col("text"), model).alias("_found"),
    )
    return rows.select(
        "doc_id", "held_out", F.col("_found.lang").alias("lang_pred"),
        F.col("_found.score").alias("score"), F.col("_found.spans").alias("spans"),
    )
