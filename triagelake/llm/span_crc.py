"""CRC-32 of many spans of a byte buffer at once, by position tables.

The CRC of a message is affine over GF(2): it is the XOR of one contribution per
byte, which depends on the byte and on its distance from the end of the message,
and of a constant that depends on the length alone.  ``_POSITIONS`` holds the
contributions for the distances 0 to ``WIDTH - 1``; the spans are laid end to
end, their contributions looked up and XORed span by span with
``bitwise_xor.reduceat``.  A span of more than ``WIDTH`` bytes is folded block by
block: what has been gathered is moved ``WIDTH`` bytes away from the end by a
linear step (``_FAR``), then the next block is XORed onto it.

Values equal ``zlib.crc32``.
"""

from __future__ import annotations

import zlib

import numpy as np

WIDTH = 256  # distances in the table, and bytes of a block
#: Bytes of spans laid end to end at a time: bounds the working memory.
AT_ONCE = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    zero = zlib.crc32(b"\0")
    # register after one byte, from a register of zero: no constant part
    single = np.array([zlib.crc32(bytes([b])) ^ zero for b in range(256)], np.uint32)
    positions = np.empty((WIDTH, 256), np.uint32)
    positions[0] = single
    for d in range(1, WIDTH):  # one more zero byte behind it
        before = positions[d - 1]
        positions[d] = (before >> np.uint32(8)) ^ single[before & np.uint32(255)]
    far = np.empty((4, 256), np.uint32)
    for k in range(4):  # a register's byte k, WIDTH zero bytes later
        value = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(WIDTH):
            value = (value >> np.uint32(8)) ^ single[value & np.uint32(255)]
        far[k] = value
    constants = np.array([zlib.crc32(bytes(n)) for n in range(WIDTH + 1)], np.uint32)
    return positions.ravel(), far, constants


_POSITIONS, _FAR, _CONSTANTS = _tables()


def _linear(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The linear part for spans of 1 to ``WIDTH`` bytes."""
    lengths = ends - starts
    offsets = np.cumsum(lengths) - lengths
    total = int(offsets[-1] + lengths[-1])
    at = np.arange(total, dtype=np.int32)
    at += np.repeat((starts - offsets).astype(np.int32), lengths)
    place = np.repeat((ends - 1).astype(np.int32), lengths)
    place -= at
    place <<= 8
    place += data[at]
    return np.bitwise_xor.reduceat(_POSITIONS[place], offsets)


def _moved(value: np.ndarray) -> np.ndarray:
    """Registers after ``WIDTH`` more zero bytes."""
    out = np.zeros_like(value)
    for k in range(4):
        out ^= _FAR[k][(value >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _short(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint32)
    upto = np.cumsum(ends - starts)
    first = 0
    while first < len(starts):
        done = int(upto[first - 1]) if first else 0
        last = max(int(np.searchsorted(upto, done + AT_ONCE, "right")), first + 1)
        part = slice(first, last)
        out[part] = _linear(data, starts[part], ends[part])
        first = last
    return out


def _long(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Blocks from the front, the first one shorter, so that the rest are whole."""
    blocks = -(-(ends - starts) // WIDTH)
    value = np.zeros(len(starts), np.uint32)
    for k in range(int(blocks.max()), 0, -1):  # k blocks to go
        here = np.flatnonzero(blocks >= k)
        stop = ends[here] - (k - 1) * WIDTH
        start = np.maximum(stop - WIDTH, starts[here])
        value[here] = _moved(value[here]) ^ _short(data, start, stop)
    return value


def span_crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``data[start:end]`` for each span; an empty span has 0.

    ``data`` is a buffer of bytes of less than 2 GB; spans may overlap.
    """
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint32)
    short = np.flatnonzero((lengths > 0) & (lengths <= WIDTH))
    if len(short):
        out[short] = _short(data, starts[short], ends[short]) ^ _CONSTANTS[lengths[short]]
    long = np.flatnonzero(lengths > WIDTH)
    if len(long):
        sizes, which = np.unique(lengths[long], return_inverse=True)
        zeros = np.array([zlib.crc32(bytes(int(n))) for n in sizes], np.uint32)
        out[long] = _long(data, starts[long], ends[long]) ^ zeros[which]
    return out


def crc32_sql(text: str) -> str:
    """The same of a string, in the checking SQL (DuckDB): byte by byte over its hex digits."""
    table = ", ".join(str(zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0")) for b in range(256))
    byte = (
        f"CAST(instr('0123456789ABCDEF', substr(hex({text}), 2 * i + 1, 1)) * 16 "
        f"+ instr('0123456789ABCDEF', substr(hex({text}), 2 * i + 2, 1)) - 17 AS BIGINT)"
    )
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295, "
        f"[{byte} FOR i IN range(strlen({text}))]), "
        f"lambda a, b: xor(a >> 8, CAST(([{table}])[(xor(a, b) & 255) + 1] AS BIGINT))))"
    )
