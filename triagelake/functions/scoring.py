"""Arrow-batch helpers: term counts, unit vectors and ranks of one batch.

They see one batch and one resident side at a time; Spark decides which rows
meet where.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Scores are ranked after rounding, so that equal scores tie whatever the order
# in which their parts were added.
SCORE_DIGITS = 9


def rounded(scores: np.ndarray) -> np.ndarray:
    return np.round(scores, SCORE_DIGITS) + 0.0


def unit_rows(vectors: pa.Array, size: int) -> np.ndarray:
    """List column to an (n, size) matrix of unit rows; missing vectors are zero."""
    out = np.zeros((len(vectors), size))
    if size == 0:
        return out
    have = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    if len(have):
        flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False)
        out[have] = flat.astype(np.float64).reshape(len(have), size)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        np.divide(out, norm, out=out, where=norm > 0)
    return out


def known_terms(
    terms: pa.Array, counts: pa.Array | None, vocabulary: pa.Array
) -> tuple[np.ndarray, ...]:
    """Term lists to (row, code, count) triples of the terms in ``vocabulary``.

    With ``counts`` the lists hold distinct terms; without, they are raw tokens.
    """
    lengths = np.asarray(pc.fill_null(pc.list_value_length(terms), 0), dtype=np.int64)
    codes = pc.fill_null(pc.index_in(terms.flatten(), vocabulary), -1).to_numpy()
    rows = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    known = codes >= 0
    if counts is not None:
        return rows[known], codes[known], counts.flatten().to_numpy()[known]
    width = max(len(vocabulary), 1)
    pairs, found = np.unique(rows[known] * width + codes[known], return_counts=True)
    return pairs // width, pairs % width, found


def pieces(lists: pa.Array, elements: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows with a bounded number of list elements, a row at least.

    What is worked out from a batch is a multiple of its elements; a batch counts rows.
    """
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + elements, "right")))
        stop = min(stop, start + rows) if rows else stop
        yield start, stop - start
        start = stop


def count_terms(tokens: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Token lists to lists of distinct terms and lists of their counts."""
    coded = tokens.flatten().dictionary_encode()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), dtype=np.int64)
    rows = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    width = max(len(coded.dictionary), 1)
    pairs, counts = np.unique(
        rows * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True
    )
    ends = np.cumsum(np.bincount(pairs // width, minlength=len(lengths)))
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    terms = coded.dictionary.take(pa.array(pairs % width)).cast(pa.string())
    return (
        pa.ListArray.from_arrays(offsets, terms),
        pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
    )


def saturated(tf: np.ndarray, dl: np.ndarray, avgdl: float, k1: float, b: float) -> np.ndarray:
    """The term-frequency part of BM25."""
    return tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl / max(avgdl, 1e-300)))


def order_keys(scores: np.ndarray, bits: int) -> np.ndarray:
    """Distinct integers that sort like (score, column); the low bits are the column.

    Rounded scores are whole numbers of the last digit kept.  Where they are too
    large to share an integer with the column, their order takes their place.
    """
    whole = np.rint(scores * 10.0**SCORE_DIGITS)
    if np.abs(whole).max(initial=0) < 2.0 ** (62 - bits):
        whole = whole.astype(np.int64)
    else:
        whole = np.argsort(np.argsort(scores, axis=1, kind="stable"), axis=1, kind="stable")
    return (whole << bits) + np.arange(scores.shape[1])


def leading(scores: np.ndarray, keep: int) -> np.ndarray:
    """The columns of the ``keep`` first places of each row, in no order."""
    width = scores.shape[1]
    if width <= keep:
        return np.broadcast_to(np.arange(width), scores.shape)
    bits = (width - 1).bit_length()
    keys = np.partition(order_keys(scores, bits), width - keep, axis=1)
    return keys[:, width - keep :] & ((1 << bits) - 1)


def places_before(
    scores: np.ndarray, names: np.ndarray, wanted: np.ndarray, wanted_names: np.ndarray
) -> np.ndarray:
    """How many of ``scores`` come before each wanted score.

    Order is score, then name, both descending; ``names`` is sorted ascending.
    """
    ordered = np.sort(scores)
    below, upto = (np.searchsorted(ordered, wanted, side) for side in ("left", "right"))
    before = len(scores) - upto
    tied = upto > below
    for score in np.unique(wanted[tied]):
        equal = names[scores == score]
        same = tied & (wanted == score)
        before[same] += len(equal) - np.searchsorted(equal, wanted_names[same], "right")
    return before


def rows_before(
    scores: np.ndarray, names: np.ndarray, wanted: np.ndarray, wanted_names: np.ndarray
) -> np.ndarray:
    """``places_before`` for each row of a matrix, by sorted keys (see ``order_keys``)."""
    width = scores.shape[1]
    bits = width.bit_length()
    whole, asked = (np.rint(x * 10.0**SCORE_DIGITS) for x in (scores, wanted))
    if max(np.abs(x).max(initial=0) for x in (whole, asked)) >= 2.0 ** (62 - bits):
        each = zip(scores, wanted, wanted_names, strict=True)
        found = [places_before(row, names, own, own_names) for row, own, own_names in each]
    else:
        ordered = np.sort((whole.astype(np.int64) << bits) + np.arange(width), axis=1)
        after = np.searchsorted(names, wanted_names, "right")
        keys = (asked.astype(np.int64) << bits) + after
        found = [width - np.searchsorted(p, x) for p, x in zip(ordered, keys, strict=True)]
    return np.stack(found) if found else np.zeros(wanted.shape, dtype=np.int64)


def weighted_sums(
    rows: np.ndarray, codes: np.ndarray, parts: np.ndarray, weights: np.ndarray, n: int, cells: int
) -> np.ndarray:
    """Sum of ``parts * weights[codes]`` per row, as a matrix product.

    ``rows`` is sorted; ``n`` is the number of rows.  A bounded number of cells
    at a time; the product beats adding term by term until the terms outnumber
    those of a row by hundreds.
    """
    out = np.zeros((n, weights.shape[1]))
    step = max(1, cells // max(len(weights), 1))
    for start in range(0, n, step):
        lo, hi = np.searchsorted(rows, [start, start + step])
        counts = np.zeros((min(step, n - start), len(weights)))
        counts[rows[lo:hi] - start, codes[lo:hi]] = parts[lo:hi]
        out[start : start + step] = counts @ weights
    return out


def heads(scores: np.ndarray, keep: int) -> np.ndarray:
    """The columns of the ``keep`` first places of one row, best first (score, column descending).

    The row is cut into more chunks than that: as many scores reach the ``keep``-th of
    their greatest, so the rest is left out by one comparison.
    """
    width, chunks = len(scores), 4 * keep
    found = np.arange(width)
    if width > 2 * chunks:
        most = scores[: width - width % chunks].reshape(chunks, -1).max(axis=1)
        least = np.partition(most, -keep)[-keep]
        found = np.flatnonzero(scores >= least)
        if len(found) > 2 * chunks:  # many are equal: of those the last columns do
            equal = found[scores[found] == least][-keep:]
            found = np.concatenate((found[scores[found] > least], equal))
    return found[np.lexsort((found, scores[found]))[::-1][:keep]]


class Places:
    """The places of one row's ``width`` scores (score, column descending).

    Bounds of them come from counts of scores in many bins.  Without ``scores`` all are equal.
    """

    BINS = 4096

    def __init__(self, scores: np.ndarray | None, width: int):
        self.scores, self.width = scores, width
        least, most = (0.0, 0.0) if scores is None else (scores.min(), scores.max())
        self.equal = most <= least
        if not self.equal:
            # grows with the score, so a higher bin lies before a lower one
            self.bins = ((scores - least) * ((self.BINS - 1) / (most - least))).astype(np.int64)
            self.counts = np.bincount(self.bins, minlength=self.BINS)
            self.before = _sums_after(self.counts)

    def head(self, keep: int) -> np.ndarray:
        """The first ``keep`` columns, best first."""
        return self.width - 1 - np.arange(keep) if self.equal else heads(self.scores, keep)

    def bounds(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest place each column may have, from 1."""
        if self.equal:
            return (self.width - columns,) * 2
        own = self.bins[columns]
        return self.before[own] + 1, self.before[own] + self.counts[own]

    def exact(self, columns: np.ndarray) -> np.ndarray:
        """The places of some columns: only the scores in their bins are compared."""
        if self.equal:
            return self.width - columns
        own = self.bins[columns]
        wanted = np.zeros(self.BINS, dtype=bool)
        wanted[own] = True
        near = np.flatnonzero(wanted[self.bins])
        found = rows_before(self.scores[near][None], near, self.scores[columns][None], columns[None])[0]
        # of those compared, the ones in higher bins are counted already
        return 1 + self.before[own] + found - _sums_after(np.where(wanted, self.counts, 0))[own]


def _sums_after(counts: np.ndarray) -> np.ndarray:
    """The sum of what comes after each value."""
    return counts.sum() - np.cumsum(counts)


def fused_top(
    legs: list[Places], k: int, rrf_k: int
) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Columns, ranks and fused scores of the first ``k`` columns of one row.

    Only columns among the first rrf_k + 2k of a ranking can be in the result (see
    ``retrieval``).  The bounds of their places leave few of them, whose places are
    then found among all scores.
    """
    width = legs[0].width
    keep, k = min(width, rrf_k + 2 * k), min(width, k)
    first = [leg.head(keep) for leg in legs]
    found = np.unique(np.concatenate(first))
    low, high = (list(x) for x in zip(*(leg.bounds(found) for leg in legs), strict=True))
    for i, head in enumerate(first):
        at = np.searchsorted(found, head)
        for bound in (low, high):
            bound[i] = bound[i].copy()
            bound[i][at] = np.arange(1, len(head) + 1)

    def fused(ranks: list[np.ndarray]) -> np.ndarray:
        return 1.0 / (rrf_k + ranks[0]) + 1.0 / (rrf_k + ranks[1])

    kept = fused(low) >= np.partition(fused(high), -k)[-k]
    ranks = []
    for leg, least, most in zip(legs, low, high, strict=True):
        rank = least[kept]
        open_ = np.flatnonzero(rank < most[kept])
        if len(open_):
            rank[open_] = leg.exact(found[kept][open_])
        ranks.append(rank)
    top = np.lexsort((found[kept], -fused(ranks)))[:k]
    return found[kept][top], [r[top] for r in ranks], fused(ranks)[top]
