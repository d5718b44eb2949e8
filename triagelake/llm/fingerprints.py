"""Document fingerprints from closed syncmers.

A window of ``K`` code points is an anchor when the smallest hash of its
substrings of ``S`` code points is the first or the last of them.  Whether it is
one depends on the window alone, so an edit moves no anchor outside it, and of any
``K - S + 1`` windows in a row one is an anchor: about two in as many are, whatever
the length of the text.  The first and the last window are anchors always, so an
edit anywhere touches one at least.

A fingerprint lists all anchors in the order of the text, each as how far it lies
behind the one before (a byte, as the gaps are bounded) and 24 bits of its hash, in
base 64: about half the length of the text.  Two fingerprints are compared by place.
The occurrences of a hash are matched in turn; neighbouring matches with the same
shift are a run; and the runs that follow each other in both texts with most anchors
are chained.  The likeness is the share of both texts' anchors in the chain, so what
is moved, inserted or cut out costs no more than itself.

Defined results: a null text is empty; an empty text has the empty fingerprint,
likeness 1 to another empty one and 0 to any other; a text without a whole
window has one anchor, its hash.  Equal texts have equal fingerprints.  Very long texts
are hashed in pieces, and only their anchors are held.  Rows with equal ids follow each
other by a hash of their text.  After the last document comes the first, so a single
document follows itself.  Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from triagelake.llm.ordered_texts import in_order, unpack
from triagelake.llm.text_arrays import _BASE, _BASE_INVERSE, _power_table, mix

K, S = 24, 4  # a gap of at most K - S, which a byte holds
HASH_BITS = 24
PIECE = 1 << 17
SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _substring_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` code points."""
    sums = np.zeros(len(points) + 1, np.uint64)
    powers = _power_table(_BASE, len(points))
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    count = len(points) - size + 1
    return mix((sums[size:] - sums[:-size]) * _power_table(_BASE_INVERSE, len(points))[:count])


def syncmers(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all closed syncmers of a text's code points.

    Long texts are taken in overlapping pieces: the choice needs one window only.
    """
    places, hashes = [], []
    for start in range(0, max(1, len(points) - K + 1), PIECE):
        part = points[start : start + PIECE + K - 1]
        if len(part) < K:
            break
        inner = _substring_hashes(part, S)
        window = K - S + 1
        least, span = inner, 1
        while span < window:  # minima over windows that double, then overlap
            step = min(span, window - span)
            least, span = np.minimum(least[:-step], least[step:]), span + step
        count = len(part) - K + 1
        chosen = np.flatnonzero(
            (inner[:count] == least) | (inner[window - 1 : window - 1 + count] == least)
        )
        places.append(chosen + start)
        hashes.append(_substring_hashes(part, K)[chosen])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


Sketch = tuple[np.ndarray, np.ndarray]


def sketch(text: str) -> Sketch:
    """(hashes, places) of all anchors, in the order of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    places, hashes = syncmers(points)
    if len(places) == 0:
        whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=3).digest()
        return np.array([int.from_bytes(whole)], np.uint32), np.zeros(1, np.int64)
    # an edit near an end may lie in few windows: the outermost are always anchors
    if places[0] != 0:
        places = np.append(0, places)
        hashes = np.append(_substring_hashes(points[:K], K), hashes)
    if places[-1] != len(points) - K:
        places = np.append(places, len(points) - K)
        hashes = np.append(hashes, _substring_hashes(points[-K:], K))
    return (hashes >> np.uint64(64 - HASH_BITS)).astype(np.uint32), places.astype(np.int64)


def as_text(found: Sketch) -> str:
    """Anchors as four bytes, the gap to the one before and the hash, in base 64."""
    hashes, places = found
    rows = np.empty((len(hashes), 4), np.uint8)
    rows[:, 0] = np.diff(places, prepend=0)
    for k in range(3):
        rows[:, 1 + k] = (hashes >> np.uint32(16 - 8 * k)) & np.uint32(255)
    return base64.b64encode(rows.tobytes()).decode("ascii")


def from_text(fingerprint: str) -> Sketch:
    """The sketch a fingerprint was written from."""
    rows = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 4)
    hashes = np.zeros(len(rows), np.uint32)
    for k in range(3):
        hashes = hashes << np.uint32(8) | rows[:, 1 + k]
    return hashes, np.cumsum(rows[:, 0], dtype=np.int64)


def _occurrences(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of occurrence as one key, ascending, and where each stands."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.searchsorted(ordered, ordered, "left")
    turn = np.arange(len(ordered)) - first
    return (ordered.astype(np.int64) << 32) | turn, order


def _longest_chain(start: np.ndarray, size: np.ndarray, end: np.ndarray) -> int:
    """Most anchors in runs, given in the order of one text, that ascend in the other.

    ``start`` and ``end`` are the first and last place of each run in the other
    text.  A staircase of (end, most anchors so far) is kept, ascending in both.
    """
    ends, best = [-1], [0]
    for a, n, b in zip(start.tolist(), size.tolist(), end.tolist(), strict=True):
        reach = best[bisect_left(ends, a) - 1] + n
        at = bisect_left(ends, b)
        if at and best[at - 1] >= reach:
            continue
        stop = at
        while stop < len(ends) and best[stop] <= reach:
            stop += 1
        ends[at:stop], best[at:stop] = [b], [reach]
    return best[-1]


def likeness(a: Sketch, b: Sketch) -> float:
    """Share of the anchors of both texts in their longest chain of runs; 0 to 1."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    left, at_left = _occurrences(a[0])
    right, at_right = _occurrences(b[0])
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    i, j = at_left[i], at_right[j]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if not len(i):
        return 0.0
    if (np.diff(j) > 0).all():
        chain = len(i)
    else:
        shift = a[1][i] - b[1][j]
        cuts = np.flatnonzero((np.diff(shift) != 0) | (np.diff(j) <= 0)) + 1
        first, last = np.append(0, cuts), np.append(cuts, len(i)) - 1
        chain = _longest_chain(j[first], last - first + 1, j[last])
    return 2.0 * chain / (len(a[0]) + len(b[0]))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The edited text is the document with its last quarter (rounded down) replaced
    by as many first code points of the next document in ascending ``doc_id``.
    Texts are shuffled once, compressed, into ranges; a task streams its ranges
    and holds two documents at a time.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # last: the document that waits for its successor: part, id, text, sketch
        last, rows = None, []

        def finish(part: int, text: str, found: Sketch) -> None:
            if last is None or last[0] != part:
                return
            cut = len(last[2]) // 4
            edited = last[2][: len(last[2]) - cut] + text[:cut]
            again = sketch(edited)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append(
                (last[1], len(last[2]), digest, as_text(last[3]), as_text(again),
                 likeness(last[3], again), likeness(last[3], found))
            )

        for batch in batches:
            parts, guests, ids, _, packed = batch.columns
            for part, guest, doc_id, raw in zip(parts, guests, ids, packed, strict=True):
                part, guest, text = part.as_py(), guest.as_py(), unpack(raw.as_py())
                if guest and (last is None or last[0] != part):
                    continue  # the successor has been met already
                found = sketch(text)
                finish(part, text, found)
                last = None if guest else (part, doc_id.as_py(), text, found)
                if len(rows) >= 1000:
                    yield _rows(rows)
                    rows.clear()
        yield _rows(rows)

    return in_order(docs, with_next=True).mapInArrow(compare, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    kinds += [pa.float64(), pa.float64()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return pa.record_batch(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` against its edited text and its successor."""
    return fingerprint_documents(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))
