"""Words of texts, found on the bytes of Arrow batches.

Java's regular expressions ask for every character a chain of as many tests as
the white-space class has ranges, and make an object of each match.  Here a
table tells of each byte whether it is blank; a batch is looked at CHUNK bytes
at a time, so that what is held besides it doesn't grow with its texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column

from newsloom.functions.arrays import _apply, flat, lists_of

CHUNK = 4 << 20

#: The white space of `text.WS`: of one byte, and the UTF-8 codes of two and three.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_TWO = np.array([0xC285, 0xC2A0])
_THREE = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Scanned:
    """data (bytes of all texts), at (offsets of the texts), starts and ends of the words in data, first (offsets of the texts' words)."""

    def __init__(self, texts: pa.Array):
        held = pc.fill_null(texts, "").cast(pa.large_binary())
        at = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
        whole = held.buffers()[2]
        self.data = np.frombuffer(whole, np.uint8)[at[0] : at[-1]] if whole is not None else np.zeros(0, np.uint8)
        self.at = at - at[0]
        blank = _BLANK[self.data]
        wide = np.flatnonzero(_WIDE[self.data])
        if len(wide):
            # a text is whole, so the bytes of a character don't come from two
            padded = np.append(self.data, [0, 0]).astype(np.int64)
            two = wide[np.isin(padded[wide] << 8 | padded[wide + 1], _TWO)]
            three = wide[np.isin(padded[wide] << 16 | padded[wide + 1] << 8 | padded[wide + 2], _THREE)]
            for places, size in ((two, 2), (three, 3)):
                for k in range(size):
                    blank[places + k] = True
        self.word = ~blank
        begin, end = self.word.copy(), self.word.copy()
        begin[1:] &= blank[:-1]
        end[:-1] &= blank[1:]
        head, tail = self.at[:-1][self.at[:-1] < len(self.data)], self.at[1:][self.at[1:] > 0] - 1
        begin[head], end[tail] = self.word[head], self.word[tail]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.at)
        self.count = np.diff(self.first)
        self._chars = None
        if (self.data >= 0x80).any():
            self._chars = np.append(0, np.cumsum((self.data & 0xC0) != 0x80))

    def chars(self, places: np.ndarray) -> np.ndarray:
        """How many characters begin before each of these bytes."""
        return places if self._chars is None else self._chars[places]

    def values(self) -> pa.Array:
        """The words."""
        own = np.append(0, np.cumsum(self.ends - self.starts)).astype(np.int32)
        return pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(own), pa.py_buffer(np.ascontiguousarray(self.data[self.word])))

    def word_row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def parts_of(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """First row and number of rows of parts of about so much in all; a row that has more is cut off from those after it."""
    turn = np.flatnonzero(np.diff((np.cumsum(size) - size) // most, prepend=-1))
    return list(zip(turn.tolist(), np.diff(np.append(turn, len(size))).tolist(), strict=True))


def scanned(kind: str, f, *columns: Column) -> Column:
    """A column of type `kind`: f(texts, scanned, other columns) of each part, the texts being the first column."""

    def whole(texts: pa.Array, *others: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [f(own := texts.slice(a, n), Scanned(own), *[x.slice(a, n) for x in others]) for a, n in parts_of(size, CHUNK)]
        if not parts:
            parts = [f(texts, Scanned(texts), *others)]
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    return _apply(kind, whole, *columns)


def word_count(body: Column) -> Column:
    """int: the number of words, null for a null text."""
    return scanned("int", lambda texts, s: pa.array(s.count.astype(np.int32), mask=pc.is_null(texts).to_numpy(zero_copy_only=False)), body)


def words(body: Column) -> Column:
    """array<string>: the words."""
    return scanned("array<string>", lambda texts, s: lists_of(s.values(), s.first, texts), body)


def word_char_starts(body: Column) -> Column:
    """array<bigint>: the character at which each word begins, and the text's length at the end."""

    def found(texts: pa.Array, s: Scanned) -> pa.Array:
        rows = np.arange(len(s.count))
        out = np.empty(len(s.starts) + len(rows), np.int64)
        row = s.word_row()
        out[np.arange(len(s.starts)) + row] = s.chars(s.starts) - s.chars(s.at)[row]
        out[s.first[1:] + rows] = s.chars(s.at[1:]) - s.chars(s.at[:-1])
        return lists_of(pa.array(out), s.first + np.arange(len(rows) + 1), texts)

    return scanned("array<bigint>", found, body)


def line_starts(body: Column) -> Column:
    """struct(n, breaks): the number of words, and the words before which a line ends, but for the first."""

    def found(texts: pa.Array, s: Scanned) -> pa.Array:
        ends = np.flatnonzero(s.data == 10)
        row = np.searchsorted(s.at, ends, "right") - 1
        # numbered over all texts, so that the copies of a break stand together
        place = np.searchsorted(s.starts, ends)
        kept = (place > s.first[row]) & (place < s.first[row + 1])
        place, row = place[kept], row[kept]
        new = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
        place, row = place[new], row[new]
        breaks = lists_of(pa.array(place - s.first[row]), np.searchsorted(row, np.arange(len(s.count) + 1)))
        return pa.StructArray.from_arrays([pa.array(s.count.astype(np.int64)), breaks], ["n", "breaks"], mask=pc.is_null(texts))

    return scanned("struct<n:bigint,breaks:array<bigint>>", found, body)


def cut(body: Column, cuts: Column, include_text: bool) -> Column:
    """array<struct<a, b, begin, end[, text]>>: the parts of a text between ascending words; words a to b, characters begin to end.

    The first part takes in the white space before the first word, so that the texts joined are the body.
    """
    kind = "a:bigint,b:bigint,begin:bigint,end:bigint" + (",text:string" if include_text else "")
    names = [x.split(":")[0] for x in kind.split(",")]

    def found(texts: pa.Array, s: Scanned, lists: pa.Array) -> pa.Array:
        at_word, own = flat(lists)
        rows = np.arange(len(s.count))
        offsets = own + np.arange(len(rows) + 1)
        cut_row = np.repeat(rows, np.diff(own))
        row = np.repeat(rows, np.diff(offsets))
        head, tail = np.zeros(len(row), bool), np.zeros(len(row), bool)
        head[offsets[:-1]] = tail[offsets[1:] - 1] = True
        a, b, begin, end = (np.empty(len(row), np.int64) for _ in names[:4])
        a[head], a[~head] = 0, at_word
        b[tail], b[~tail] = s.count, at_word
        begin[head], begin[~head] = s.at[:-1], s.starts[s.first[cut_row] + at_word]
        end[tail], end[~tail] = s.at[1:], begin[~head]
        base = s.chars(s.at)[row]
        parts = [pa.array(x) for x in (a, b, s.chars(begin) - base, s.chars(end) - base)]
        if include_text:
            # parts follow each other without a gap
            edges = np.append(begin, s.at[-1]).astype(np.int32)
            parts.append(pa.StringArray.from_buffers(len(row), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(s.data))))
        return lists_of(pa.StructArray.from_arrays(parts, names), offsets, texts)

    return scanned(f"array<struct<{kind}>>", found, body, cuts)
