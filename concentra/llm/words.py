"""Words, shingles and code points of Arrow string batches, as numpy arrays.

The text operators share one way to look at a batch: the UTF-8 bytes of many
documents in one array, the word boundaries found by a byte table, and a
64-bit hash for each word. Batches are cut into pieces of a few MB of text
first, so that memory follows the piece and the longest document, not the
batch. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20

#: words are runs of bytes other than space, tab, LF, VT, FF and CR
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: bytes that are no letter, no digit and not part of a multi-byte character
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: A-Z to a-z, every other byte as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xBF58476D1CE4E5B9)
_C3 = np.uint64(0x94D049BB133111EB)
_LONG_WORD = 512


class Piece(NamedTuple):
    """Rows ``lo`` to ``hi`` of a batch; document i has bytes offsets[i]:offsets[i+1]."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Word spans in bytes, 64-bit hashes, and the first word of each document."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim  # glibc only
    except (AttributeError, OSError, TypeError):
        return lambda _: 0


_TRIM = _trimmer()


def give_back() -> None:
    """Return what a batch needed to the system: a worker lives on and serves the next stage,
    and freed arrays would else count against the executor until it ends."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def pieces(column, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a column into runs of rows of about ``limit`` bytes (one row at least)."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Piece(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
    give_back()


def mix(h: np.ndarray) -> np.ndarray:
    """Bit mixer (bijective on 64 bits)."""
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    buf = np.zeros(len(data) + 8, np.uint8)
    buf[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buf, strides=(1,))  # 8 bytes from any position
    length = ends - starts
    h = mix(length.astype(np.uint64) * _C1 + _C1)
    todo = np.flatnonzero(length <= _LONG_WORD)
    at = 0
    while len(todo):
        rest = length[todo] - at
        part = eight[starts[todo] + at] & _MASK[np.minimum(rest, 8)]
        h[todo] = mix((h[todo] ^ part) * _C1 + np.uint64(at + 1))
        at += 8
        todo = todo[rest > 8]
    for i in np.flatnonzero(length > _LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(digest, "<u8")[0]
    return h


def split_words(piece: Piece, separators: np.ndarray = BLANK, lower: bool = False) -> Words:
    """Words of every document of a piece."""
    data, offsets = piece.data, piece.offsets
    n = len(data)
    none = np.zeros(0, np.int64)
    if n == 0:
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(stop) + 1
    first = np.searchsorted(starts, offsets)
    return Words(starts, ends, hash_spans(data, starts, ends), first)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (also across documents; mask those
    with ``inside_windows``)."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = mix(hashes[:m] + _C1)
    for j in range(1, k):
        h = mix(h * _C1 + hashes[j : j + m])
    return h


def inside_windows(first: np.ndarray, k: int) -> np.ndarray:
    """Mask over window starts: the window lies within one document."""
    m = int(first[-1]) - k + 1
    if m <= 0:
        return np.zeros(0, bool)
    # windows that start at one of the last k - 1 words before a boundary reach over it
    cross = np.zeros(m + 1, np.int32)
    np.add.at(cross, np.clip(first[1:] - k + 1, 0, m), 1)
    np.add.at(cross, np.clip(first[1:], 0, m), -1)
    return np.cumsum(cross[:m]) == 0


def document_of(first: np.ndarray) -> np.ndarray:
    """Index of the document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def code_points(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a piece and the n + 1 offsets of its documents in them."""
    points = np.frombuffer(piece.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")
    lead = np.zeros(len(piece.data) + 1, np.int64)
    np.cumsum((piece.data & 0xC0) != 0x80, out=lead[1:])
    return points, lead[piece.offsets]
