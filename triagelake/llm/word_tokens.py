"""Token ids of texts by a public tokenizer file, word by word with a cache.

The vocabulary drops white space and never joins characters across it, so a
text's ids are its words' ids in a row; texts repeat their words, and each
distinct word is encoded once per worker.  Words end at space and 0x09-0x0D
only; other white space stays inside a word for the tokenizer to drop.

The vocabulary also lowers letters and splits a run of letters from the
punctuation after it.  Words of Latin letters, with or without such an end, are
therefore two lookups, and the letters go to the library's model directly.
Every other word goes through the whole tokenizer.
"""

from __future__ import annotations

import os
import re

import public_tokenizers
from tokenizers import Tokenizer

TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 1
CACHE_WORDS = 250_000
_LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
_encoders: dict[str, WordEncoder] = {}


def default_path() -> str:
    return public_tokenizers.path(TOKENIZER_FILE)


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class _Words(dict):
    """Ids of words as bytes; a word met for the first time is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self.encode(word)
        return found


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.characters = _byte_characters()
        self.packed = [
            i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(True))
        ]
        self.words = _Words(self._word)
        self.letters = _Words(self._letters)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([self.packed[i] for i in ids])

    def _letters(self, letters: str) -> bytes:
        if not letters.isascii():
            letters = "".join(map(self.characters.__getitem__, letters.encode("utf-8")))
        return b"".join([self.packed[t.id] for t in self.model.tokenize(letters)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        latin = _LATIN.fullmatch(text)
        if latin is None:
            return self._whole(text)
        letters = self.letters[latin[1].lower()]
        return letters + self.words[latin[2].encode()] if latin[2] else letters

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text, with the end id."""
        for cache in (self.words, self.letters):
            if len(cache) > CACHE_WORDS:
                cache.clear()
        get, end = self.words.__getitem__, END_ID.to_bytes(4, "little")
        return [b"".join(map(get, t.split())) + end for t in texts]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
