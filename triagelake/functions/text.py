"""Column expressions over message text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Does ``text`` hold any of ``words`` as a substring (not as a word)?

    Case-sensitive; pass a lower-cased column for the usual rules.  Long lists
    are a search over a constant array: the generated code stays small however
    many words there are, and ``text`` is evaluated once per list.
    """
    words = list(words)
    if len(words) <= 3:
        return any_of(text.contains(w) for w in words)
    listed = F.array(*[F.lit(w) for w in words])
    return F.exists(F.array(text), lambda t: F.exists(listed, lambda w: t.contains(w)))


def ends_with_any(text: Column, endings: Iterable[str]) -> Column:
    return any_of(text.endswith(e) for e in endings)


#: All characters that count as white space in Unicode text, for a character class.
WHITE_SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Drop white space of every kind at both ends (``trim`` drops blanks only)."""
    return F.regexp_replace(text, rf"\A[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\z", "")


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def message_id(key: Column, text: Column) -> Column:
    """The given key, else ``twt_`` and 8 hex digits of the text's hash.

    The hash keeps retries stable; equal texts share an id, so pass a real key
    where there is one.
    """
    return F.coalesce(
        key.cast("string"), F.concat(F.lit("twt_"), F.substring(F.sha2(text, 256), 1, 8))
    )
