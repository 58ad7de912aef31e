"""Words and hashes of whole text columns, computed with numpy inside Spark tasks.

The helpers work on the UTF-8 bytes of an Arrow string column.  Every word
class used here treats all bytes from 0x80 on alike, so splitting bytes and
splitting characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; one longer text is one piece.
PIECE_BYTES = 1 << 19

_WORD = 64
_ROLL = 0x9E3779B97F4A7C13  # multipliers of the polynomials, 3 modulo 8
_WINDOW = 0xD1342543DE82EF93
_SECOND = 0xA0761D6478BD6423


def non_space_bytes() -> np.ndarray:
    """Table of the class ``[^\\x20\\x09-\\x0D]``."""
    table = np.ones(256, dtype=bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return table


def alnum_bytes() -> np.ndarray:
    """Table of the class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` (after A-Z became a-z)."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def ascii_lower() -> np.ndarray:
    """Byte table that lower-cases A-Z and leaves every other byte."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        if column.num_chunks > 1 and column.type in (pa.string(), pa.binary()):  # together they may be beyond 32-bit offsets
            column = column.cast(pa.large_string() if column.type == pa.string() else pa.large_binary())
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    ends = ends.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, at least one row."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, rows)
        at = min(to, rows)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a finaliser of xor-shifts and products)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class Powers:
    """Powers of an odd multiplier modulo 2**64 and of its inverse, extended on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << _WORD)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[: n + 1], self.down[: n + 1]


class Words:
    """Words of some texts: byte spans, the word range of each text, 64-bit word hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        self.data = data
        inside = word_bytes[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def texts(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


class Hasher:
    """Word hashes and Rabin-Karp hashes of word windows; one per task, it keeps its tables."""

    def __init__(self):
        self.values = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.roll, self.window, self.second = Powers(_ROLL), Powers(_WINDOW), Powers(_SECOND)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span."""
        up, down = self.roll.upto(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * up[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def words(self, w: Words) -> np.ndarray:
        return self.spans(w.data, w.starts, w.ends)

    def windows(self, hashes: np.ndarray, size: int, second: bool = False) -> np.ndarray:
        """Hash of the ``size`` words from each word on (``len - size + 1`` values)."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.uint64)
        up, down = (self.second if second else self.window).upto(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=sums[1:])
        return mix((sums[size:] - sums[: n + 1 - size]) * down[: n + 1 - size])


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Index of the first word of every window that lies in one text."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    total = int(counts.sum())
    base = np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts)
    return base + np.arange(total)


def joined_words(w: Words, keep: np.ndarray) -> pa.Array:
    """Text of the kept words of each text, joined by one space."""
    counts = np.bincount(w.texts()[keep], minlength=len(w.bounds) - 1)
    starts, ends = w.starts[keep], w.ends[keep]
    sizes = ends - starts + 1  # each word and a space after it
    to = np.cumsum(sizes)
    at = np.repeat(starts - (to - sizes), sizes) + np.arange(int(to[-1]) if len(to) else 0)
    out = np.append(w.data, np.uint8(0x20))[at]
    out[to - 1] = 0x20
    # the space after the last word of each text goes
    last = np.cumsum(counts)
    drop = to[last[counts > 0] - 1] - 1
    out = np.delete(out, drop)
    lengths = np.zeros(len(counts), np.int64)
    edge = np.concatenate(([0], to))[np.concatenate(([0], last))]
    lengths = np.diff(edge) - (counts > 0)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
