"""Token files: exact round trips, random access, the whole query."""

from __future__ import annotations

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_tables import ROWS, empty, odd
from tokenizers import Tokenizer

from triagelake.llm import token_output as out
from triagelake.llm import word_tokens
from triagelake.session import scratch_path

ENCODER = word_tokens.WordEncoder(word_tokens.default_path())
WHOLE = Tokenizer.from_file(word_tokens.default_path())


def plain(text):
    return np.array(WHOLE.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


@given(st.integers(1, 31), st.lists(st.integers(0, 2**31 - 1), max_size=300))
@settings(max_examples=100, deadline=None)
def test_bits_round_trip(bits, values):
    ids = np.array([v & ((1 << bits) - 1) for v in values], np.uint32)
    words = out.pack_bits(ids, bits)
    assert len(words) == -(-len(ids) // 64) * bits
    assert (out.unpack_bits(words, bits, len(ids)) == ids).all()


ALPHABET = "aAbBsStTéÉßñç÷×ÿİıſKΣς'.,!?;:<|>0129 \t\n\x0b\x1c\x85\xa0　́中文あ한😀-_#​"


@given(st.text(ALPHABET, max_size=60))
@settings(max_examples=400, deadline=None)
def test_words_give_the_ids_of_the_whole_text(text):
    assert ENCODER.encode([text.encode()])[0] == plain(text).tobytes()


@pytest.mark.parametrize("text", ["<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "it's I'LL we're,ok...", ""])
def test_special_strings(text):
    assert ENCODER.encode([text.encode()])[0] == plain(text).tobytes()


def test_random_access(monkeypatch):
    monkeypatch.setattr(out, "BLOCK_IDS", 128)
    rng, file = np.random.default_rng(1), io.BytesIO()
    writer = out.TokenWriter(file, 1000)
    docs = [rng.integers(0, 1000, n).astype(np.uint32) for n in (0, 5, 400, 1, 0, 9000, 128)]
    for k, ids in enumerate(docs):
        writer.add(k or None, ids)
    assert writer.close() == sum(map(len, docs))
    reader = out.TokenReader(file)
    assert reader.bits == 10 and reader.null.tolist() == [True] + [False] * 6
    for k in (5, 2, 6, 0, 1):
        assert (reader.document(k) == docs[k]).all()
    whole = np.concatenate(docs)
    for a, b in ((0, 1), (127, 129), (500, 5000), (9533, 9534)):
        assert (reader.ids(a, b) == whole[a:b]).all()


def test_ids_beyond_the_vocabulary_are_refused():
    with pytest.raises(ValueError):
        out.TokenWriter(io.BytesIO(), 100).add(1, np.array([100], np.uint32))


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_documents(spark, scheme):
    folder = scheme + scratch_path(spark, "tokens").removeprefix("file:")
    files = out.write_token_files(odd(spark), folder)
    rows = sorted(out.read_token_files(spark, files).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = {}
    for i, text, *_ in ROWS:
        tokens = plain(text)
        want.setdefault(i, []).append((len(tokens), zlib.crc32(tokens.tobytes())))
    start, got = 0, {}
    for r in rows:
        assert r.start == start
        start += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty(spark):
    files = out.write_token_files(empty(spark), scratch_path(spark, "tokens"))
    assert files == [] and out.read_token_files(spark, files).count() == 0
