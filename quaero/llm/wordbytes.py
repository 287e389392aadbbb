"""Words and word n-grams of Arrow text columns, as numpy arrays over UTF-8 bytes.

Texts are never turned into Python strings: a batch's bytes are classified by a
256-entry table, word bounds come from the changes of class, and word hashes are
sums of table values times powers by position (``numpy.add.reduceat``).  All
hashes are fixed functions of the bytes, so they agree between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of alphanumeric words: 0-9, a-z (after lower-casing), everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_random = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _random.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(int(_random.integers(0, 2**64, dtype=np.uint64)) | 5)
_Q = np.uint64(int(_random.integers(0, 2**64, dtype=np.uint64)) | 3)
_powers = np.ones(1, np.uint64)

#: Texts are handled in groups of about so many bytes; one longer text is a group of its own.
GROUP = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers)), _P, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


def text_groups(column: pa.Array, group: int = GROUP) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of slices of a string column; a null text counts as empty.

    ``offsets`` has one entry more than rows and starts at 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + group, "right")) - 1
        end = min(n, max(end, start + 1))
        yield slice(start, end), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


class Words:
    """Word bounds in a group of texts: byte positions ``start``, ``end``; ``first[i]`` to ``first[i + 1]`` are text i's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.data, self.offsets, self.inside = data, offsets, inside
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = inside[data]
        begins = word[1:-1] & ~word[:-2]
        ends = word[1:-1] & ~word[2:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begins[cut] |= word[1:-1][cut]
        ends[cut - 1] |= word[1:-1][cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n = np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text's number of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, as :func:`span_hashes` gives it; bytes between words count as zero."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        base = self.start[0]
        body, at, length = self.data[base:], self.start - base, self.end - self.start
        longest = int(length.max())
        within = np.arange(len(body), dtype=np.int32 if len(body) < 2**31 else np.int64)
        within -= np.repeat(at.astype(within.dtype), np.diff(np.append(at, len(body))))
        np.minimum(within, longest, out=within)
        value = np.where(self.inside, _BYTE, np.uint64(0))[body]
        value *= powers(longest + 1)[within]
        return _finish(np.add.reduceat(value, at), length)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which are in order and don't overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    total = int(length.sum())
    head = np.zeros(len(start), np.int64)
    np.cumsum(length[:-1], out=head[1:])
    within = np.arange(total) - np.repeat(head, length)
    where = within + np.repeat(start, length)
    value = _BYTE[data[where]] * powers(int(length.max(initial=0)) + 1)[within]
    out = np.zeros(len(start), np.uint64)
    full = length > 0
    out[full] = np.add.reduceat(value, head[full]) if full.any() else 0
    return _finish(out, length)


def _finish(total: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(total + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each position on (shorter by k - 1; across texts too)."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = word[:n].copy()
    for j in range(1, k):
        out = out * _Q + word[j : j + n]
    return mix(out)


def gram_in_doc(doc: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from each position on are of one text."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def covered(n: int, start: np.ndarray, length) -> np.ndarray:
    """Which of n positions lie in a span of ``length`` from one of ``start``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) > 0


def segment_sum(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of value[first[i]:first[i + 1]]."""
    total = np.concatenate(([0], np.cumsum(value)))
    return total[first[1:]] - total[first[:-1]]
