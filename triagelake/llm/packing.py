"""Best-fit packing: a configuration linear program over the histogram of lengths.

Only the histogram, at most one count per possible length, reaches the driver.
There, fractional numbers of configurations (which lengths share a sequence)
come from multiplicative weights: a knapsack dynamic program prices the best
configuration through every length, the configurations gain mass, and lengths
that are covered beyond their count lose weight.  Rounding takes configurations
by mass while pieces are left for them; what remains goes best-fit, longest
first, into sequences counted by their free space.

Each piece then finds its place from its number among the pieces of its length,
so placing is one range sort of small rows and a lookup.

Defined results: a null or empty text is the end id alone, one piece of length
1; repeated rows are packed each by itself; a null ``doc_id`` stays null; an
empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.text_arrays import chunks, utf8
from triagelake.llm.word_tokens import default_path, encoder
from triagelake.operators.ranking import number_within
from triagelake.llm.workers import prepare
from triagelake.session import cut_lineage

CAPACITY = 4096
ROUNDS = 16
RATE = 0.5
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = PIECES + ", sequence_id bigint, offset bigint"
Config = tuple[tuple[int, int], ...]  # (length, how many), longest first


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None
) -> DataFrame:
    """Tokens of every text, cut into pieces of ``capacity``; lengths and checksums only."""
    path = tokenizer_path or default_path()
    prepare(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, offsets = utf8(batch.column(1))
            for first, last in chunks(offsets):
                texts = [raw[offsets[k] : offsets[k + 1]].tobytes() for k in range(first, last)]
                rows = []
                for k, tokens in enumerate(encode(texts), first):
                    view = memoryview(tokens)
                    for piece, at in enumerate(range(0, len(tokens), 4 * capacity)):
                        part = view[at : at + 4 * capacity]
                        rows.append((ids[k], piece, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(cut, PIECES)


def _knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int):
    """Best value within every space, and the length (by index) that reaches it last."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for space in range(1, capacity + 1):
        best[space] = best[space - 1]
        if fits[space]:
            options = value[: fits[space]] + best[space - lengths[: fits[space]]]
            k = int(options.argmax())
            if options[k] > best[space]:
                best[space], choice[space] = options[k], k
    return best, choice


def _configuration(first: int, lengths: list[int], choice: list[int], capacity: int) -> Config:
    """The best configuration through length ``first``."""
    counts = {lengths[first]: 1}
    space = capacity - lengths[first]
    while space > 0:
        k = choice[space]
        if k < 0:
            space -= 1
        else:
            counts[lengths[k]] = counts.get(lengths[k], 0) + 1
            space -= lengths[k]
    return tuple(sorted(counts.items(), reverse=True))


def fractional(histogram: dict[int, int], capacity: int) -> dict[Config, float]:
    """Configurations with the mass that multiplicative weights give them."""
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(x)] for x in lengths], np.float64)
    place = {int(x): k for k, x in enumerate(lengths)}
    weight, covered = np.ones(len(lengths)), np.zeros(len(lengths))
    mass: dict[Config, float] = {}
    for step in range(1, ROUNDS + 1):
        _, choice = _knapsack(lengths, weight * lengths / capacity, capacity)
        known, chosen = lengths.tolist(), choice.tolist()
        for k in range(len(lengths)):
            short = need[k] * step / ROUNDS - covered[k]
            if short <= 0:
                continue
            config = _configuration(k, known, chosen, capacity)
            amount = short / dict(config)[known[k]]
            mass[config] = mass.get(config, 0.0) + amount
            for length, count in config:
                covered[place[length]] += amount * count
        weight *= np.exp(-RATE * np.clip(covered * ROUNDS / (need * step) - 1, -1, 1))
        weight /= weight.mean()
    return mass


def _round(
    histogram: dict[int, int], mass: dict[Config, float], capacity: int
) -> list[tuple[Config, int]]:
    """Whole numbers of configurations; takes their pieces out of ``histogram``."""
    taken = []
    by_mass = sorted(mass, key=lambda c: (-mass[c], c))
    for most in (False, True):
        for config in by_mass:
            fits = min(histogram[length] // count for length, count in config)
            number = fits if most else min(fits, int(mass[config]))
            if number > 0 and (not most or sum(a * b for a, b in config) == capacity):
                taken.append((config, number))
                for length, count in config:
                    histogram[length] -= number * count
    return taken


def _best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Best fit, longest first, on counts: equal sequences are handled as one."""
    open_: dict[int, dict[Config, int]] = {capacity: {(): sum(histogram.values())}}
    spaces = np.zeros(capacity + 1, bool)
    spaces[capacity] = True
    for length in sorted(histogram, key=lambda x: -x):
        left = histogram[length]
        while left > 0:
            space = length + int(spaces[length:].argmax())
            group = open_[space]
            config, number = next(iter(group.items()))
            each = min(space // length, left)
            used = min(number, left // each)
            group[config] -= used
            if not group[config]:
                del group[config]
                if not group:
                    spaces[space] = False
            rest = space - each * length
            target = open_.setdefault(rest, {})
            spaces[rest] = True
            key = (*config, (length, each))
            target[key] = target.get(key, 0) + used
            left -= used * each
    found: dict[Config, int] = {}
    for group in open_.values():
        for config, number in group.items():
            if config and number:
                merged: dict[int, int] = {}
                for length, count in config:
                    merged[length] = merged.get(length, 0) + count
                key = tuple(sorted(merged.items(), reverse=True))
                found[key] = found.get(key, 0) + number
    return sorted(found.items())


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    """(configuration, number of sequences) that hold exactly the pieces counted."""
    left = dict(histogram)
    taken = [(((capacity, 1),), left.pop(capacity))] if left.get(capacity) else []
    if left:
        rounded = _round(left, fractional(left, capacity), capacity)
        taken += rounded + _best_fit({k: v for k, v in left.items() if v}, capacity)
    return taken


def _runs(plan: list[tuple[Config, int]], histogram: dict[int, int]):
    """Arrays over runs of pieces that fill the same place of equal sequences.

    ``first`` counts all pieces, sorted by length; a run of ``number * count``
    pieces from there goes to ``number`` sequences from ``base``, ``count`` each,
    from ``offset`` on.
    """
    lengths = sorted(histogram)
    starts = dict(zip(lengths, np.cumsum([0] + [histogram[x] for x in lengths]), strict=False))
    next_, rows, base = {k: int(v) for k, v in starts.items()}, [], 0
    for config, number in plan:
        offset = 0
        for length, count in config:
            rows.append((next_[length], base, count, offset))
            next_[length] += number * count
            offset += length * count
        base += number
    rows.sort()
    runs = np.array(rows, np.int64).reshape(-1, 4).T
    table = np.zeros(max(lengths, default=0) + 1, np.int64)
    table[lengths] = [starts[x] for x in lengths]
    return table, runs


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece its sequence and its offset there."""
    pieces = cut_lineage(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    starts, runs = _runs(pack_histogram(histogram, capacity), histogram)
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32", "start")]
    numbered = number_within(pieces, ["length"], order, "_number")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, base, count, offset = runs
        for batch in batches:
            length = batch.column(3).to_numpy()
            at = starts[length] + batch.column(5).to_numpy() - 1
            run = np.searchsorted(first, at, "right") - 1
            within = at - first[run]
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(base[run] + within // count[run]),
                 pa.array(offset[run] + within % count[run] * length)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    prepare(pieces.sparkSession)
    return numbered.mapInArrow(look_up, PLACED)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in sequences of 4096 tokens."""
    return place(token_pieces(spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))))
