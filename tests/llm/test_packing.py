"""Packing: pieces tile documents, sequences are tiled, near the least number of them."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_tables import ROWS, empty, odd
from tokenizers import Tokenizer

from triagelake.llm import packing
from triagelake.llm.word_tokens import default_path


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_holds_every_piece_once(histogram):
    held = Counter()
    for config, number in packing.pack_histogram(histogram, 64):
        assert number > 0 and sum(a * b for a, b in config) <= 64
        for length, count in config:
            held[length] += count * number
    assert held == Counter(histogram)


@pytest.mark.parametrize("pieces", [2_000, 100_000])
def test_near_the_lower_bound(pieces):
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6.4, 1.1, pieces).astype(int) + 1, 4096)
    histogram = dict(Counter(lengths.tolist()))
    used = sum(n for _, n in packing.pack_histogram(histogram))
    assert used <= 1.002 * -(-int(lengths.sum()) // 4096) + 1


def test_thirds_need_whole_configurations():
    # best fit alone would pair 33 with 33 and strand the 34s
    used = sum(n for _, n in packing.pack_histogram({34: 300, 33: 600}, 100))
    assert used == 300


def test_input_histogram_is_left_alone():
    histogram = {10: 3, 100: 2}
    packing.pack_histogram(histogram, 100)
    assert histogram == {10: 3, 100: 2}


def check(rows, texts, capacity):
    whole = Tokenizer.from_file(default_path())
    want = Counter()
    for i, text in texts:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_odd_rows(spark):
    rows = packing.place(packing.token_pieces(odd(spark))).collect()
    check(rows, [(r[0], r[1]) for r in ROWS], packing.CAPACITY)


def test_small_capacity(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices(["a", "of", "the", "word"], k=rng.randint(0, 60)))) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    rows = packing.place(packing.token_pieces(docs, 32), 32).collect()
    used = check(rows, texts, 32)
    assert used <= 1.02 * sum(r.length for r in rows) / 32 + 1


def test_empty(spark):
    assert packing.place(packing.token_pieces(empty(spark))).count() == 0
