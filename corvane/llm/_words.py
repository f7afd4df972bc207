"""Vectorised words, lines and shingles over Arrow string columns (numpy only, no Spark).

Texts are handled as the UTF-8 bytes that Arrow holds. A block is a run of rows of about a megabyte; a row is never cut.
Words and lines are named by 64-bit hashes: eight bytes at a time go into a state that is mixed after each step (not a
polynomial, whose collisions have a structure), and spans over ``LONG`` bytes through XXH3. Two given different spans share a
name with a probability of about 2**-64, so n different spans hold two of one name with about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK = 1 << 20
U = np.uint64
#: Spans over so many bytes are hashed one by one.
LONG = 64
#: The lowest 0 to 8 bytes of a word.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of at most ``most`` bytes, one row at least. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes in ``table``, and for each row where its runs begin (one entry more)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[-1] = inside[-1]
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut - 1]]  # a run that would go on into the next row
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    starts, ends = at[::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * U(0x9FB21C651E98DF25) + U(0x9E3779B97F4A7C15))
    if not len(out):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from every place
    on = None  # all spans, then those that go on
    for done in range(0, min(LONG, int(size.max())), 8):
        if done:
            on = np.flatnonzero((size > done) & (size <= LONG)) if on is None else on[size[on] > done]
        at, left, state = (starts, size, out) if on is None else (starts[on] + done, size[on] - done, out[on])
        state = mix(state * U(0xD6E8FEB86659FD93) + (eight[at] & _LOW[np.minimum(left, 8)]))
        if on is None:
            out = state
        else:
            out[on] = state
    long = np.flatnonzero(size > LONG)
    if len(long):
        raw = memoryview(padded)
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    return out


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from where each row's items begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words of one sequence; with fewer words, of the whole sequence; none without words."""
    n = len(words)
    if not n:
        return words
    m = min(k, n)
    x = np.zeros(n - m + 1, np.uint64)
    for i in range(m):
        x = (x + words[i : n - m + 1 + i]) * U(0x9FB21C651E98DF25)
        x ^= x >> U(32)
    return mix(x + U(m))


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines of every row (an empty row has one empty line), and where each row's lines begin."""
    nl = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], nl + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], nl]), kind="stable")
    per_row = np.searchsorted(nl, offsets[1:]) - np.searchsorted(nl, offsets[:-1]) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(per_row)])
