"""Vectorised text primitives over Arrow string arrays.

Every Python stage of this subpackage works on the UTF-8 buffer of an Arrow
string column with numpy, never on one Python string per word.  Nulls count as
empty texts here; callers that must tell the two apart do so themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space; the only separators of `words`.
SPACE = b" \t\n\r\x0b\x0c"
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[list(SPACE)] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _STEP, np.uint64), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), _STEP, np.uint64), dtype=np.uint64)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """An ordered hash of two 64-bit values."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b + np.uint64(salt * 0x2545F4914F6CDD1D % 2**64)))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows joined, and the n + 1 offsets of rows in them."""
    column = strings(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Row ranges (i, j) of at most so many bytes; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def runs(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of maximal runs of bytes in `member`; runs end with their row."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = member[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    return start, np.flatnonzero(inside & (~after | edge[1:])) + 1


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte strings raw[start:end]; equal strings have equal hashes in any batch."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    total = int(size.sum())
    first = np.cumsum(size) - size
    at = np.arange(total) - np.repeat(first, size)
    value = _BYTE[raw[np.repeat(start, size) + at]] * _powers(int(size.max()))[at]
    value ^= value >> np.uint64(29)
    return mix(np.add.reduceat(value, first) + np.uint64((salt * 0x632BE59BD9B4E019 + 1) % 2**64) * size.astype(np.uint64))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets, and the start, end and row of each white-space word."""
    raw, offsets = buffers(column)
    start, end = runs(raw, offsets, _NOT_SPACE)
    return raw, offsets, start, end, np.searchsorted(offsets, start, "right") - 1


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `words`, of the lower-cased text and with ASCII punctuation as separators too."""
    raw, offsets = buffers(pc.utf8_lower(strings(column)))
    start, end = runs(raw, offsets, _ALNUM)
    return raw, offsets, start, end, np.searchsorted(offsets, start, "right") - 1
