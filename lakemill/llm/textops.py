"""Vectorised word handling over Arrow string columns.

A batch is cut into pieces of a few MB (a longer document is one piece), the
UTF-8 bytes of a piece are one numpy array, and words, word hashes and hashes
of word windows are arrays over it. Cost per byte does not depend on how the
bytes are spread over documents, and memory is bounded by the piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that part words in `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

PIECE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55 | 1)
_MASK = (1 << 64) - 1
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Powers:
    """Powers of the hash base and of its inverse, grown to the longest piece."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, dtype=np.uint64)], dtype=np.uint64)
                cls.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE, dtype=np.uint64)], dtype=np.uint64)
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Piece:
    """Rows lo..hi of a batch: their bytes, and where each row and word lies."""

    lo: int
    hi: int
    data: np.ndarray  # uint8
    rows: np.ndarray  # row r is data[rows[r]:rows[r + 1]]
    starts: np.ndarray  # of words
    ends: np.ndarray
    first: np.ndarray  # row r has words first[r] .. first[r + 1] - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.n_words)

    def word_hashes(self) -> np.ndarray:
        up, down = _Powers.to(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])


def window_hashes(words: np.ndarray, width: int, seed: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """Hash of each run of width words (also of runs that cross rows)."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    weight = seed | 1
    for k in range(width):
        out += words[k : k + n] * np.uint64(weight)
        weight = weight * 0xDA942042E4DD58B5 & _MASK | 1
    return mix(out)


def window_ok(piece: Piece, width: int) -> np.ndarray:
    """Whether the window that starts at a word ends in the same row."""
    n = max(0, len(piece.starts) - width + 1)
    last = np.repeat(piece.first[1:], piece.n_words)[:n]
    return np.arange(n) + width <= last


def text_array(column: pa.Array) -> pa.Array:
    """The column as large strings, null as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(column: pa.Array, separator: np.ndarray = SPACE, limit: int = PIECE_BYTES, lower: bool = False) -> Iterator[Piece]:
    """The words of each row of a string column; lower: A-Z count as a-z."""
    text = text_array(column)
    if not len(text):
        return
    _, offsets, raw = text.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        own = data[offsets[lo] : offsets[hi]]
        if lower:
            own = LOWER[own]
        yield _cut(lo, hi, own, offsets[lo : hi + 1] - offsets[lo], separator)
        lo = hi


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _cut(lo: int, hi: int, data: np.ndarray, rows: np.ndarray, separator: np.ndarray) -> Piece:
    word = ~separator[data]
    begin, end = word.copy(), word.copy()
    if len(data):
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        at = rows[:-1][rows[:-1] < rows[1:]]  # first bytes of rows that have any
        begin[at] = word[at]
        last = rows[1:][rows[:-1] < rows[1:]] - 1
        end[last] = word[last]
    starts = np.flatnonzero(begin)
    return Piece(lo, hi, data, rows, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, rows))
