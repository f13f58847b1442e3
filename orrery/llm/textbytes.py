"""Vectorised views of Arrow text columns: words as byte ranges, and 64-bit word hashes.

Texts stay as the UTF-8 bytes of the Arrow buffer. All word patterns used here separate
words by ASCII characters alone, so byte classes decide exactly what a code-point pattern would.

A word's hash takes its bytes eight at a time through two states that each step mixes without a
linear rule, so that no pattern of letters makes hashes equal; words beyond LONG bytes go through BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles; a longer document makes a longer step.
BLOCK_BYTES = 4 << 20
#: Bytes from which a word is hashed on its own.
LONG = 512

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of `[^\x20\x09-\x0D]+`.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is lower-cased.
PUNCT = np.zeros(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    PUNCT[_a : _b + 1] = True

_SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, 3, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n+1 offsets of its rows; null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about `limit` bytes: first row, end row, bytes, offsets from 0."""
    raw, off = text_buffer(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_ranges(low: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and the n+1 offsets of each row's words."""
    n = len(low)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~separators[low]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = word[1:] != word[:-1]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begins = edge | first
    begins = begins[:n] & word
    ends = (edge | first)[1:] & word
    ends[n - 1] = word[n - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, off)


def range_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    sizes = (stops - starts).astype(np.int64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))  # those from each byte on
    a = sizes.astype(np.uint64) * _ODD ^ _SEEDS[0]
    b = a + _SEEDS[1]
    at, left, live = starts, sizes, slice(None)
    if (sizes > LONG).any():
        live = np.flatnonzero(sizes <= LONG)
        at, left = starts[live], sizes[live]
    while len(at):
        chunk = eight[at] & _FIRST[np.minimum(left, 8)]
        a[live] = mix(a[live] ^ chunk)
        b[live] = mix(b[live] + chunk * _ODD) ^ _SEEDS[2]
        more = np.flatnonzero(left > 8)
        at, left = at[more] + 8, left[more] - 8
        live = more if isinstance(live, slice) else live[more]
    out = mix(a + (b << np.uint64(32) | b >> np.uint64(32)))
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : stops[k]].tobytes(), digest_size=8).digest(), "little")
    return out
