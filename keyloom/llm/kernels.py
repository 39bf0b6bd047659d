"""Vectorised text kernels: words, rolling hashes, sliding minima.

All of them work on one chunk of texts at a time: the UTF-8 bytes of several
documents laid end to end plus the offsets between them.  Nothing ever crosses
a document boundary.  Hashes are polynomial hashes modulo 2**64 over randomised
byte codes, finished by a 64-bit mixer, so any stretch costs O(1) after one
prefix sum.  Such a hash takes strings for equal that are built to agree modulo
a power of two (Thue-Morse strings and their complements, from a thousand units
on), so stretches of more than :data:`LONG` bytes are named by BLAKE2b instead,
and what must be exact uses two hashes with bases and codes of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text in one chunk; a longer single document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Stretches of more bytes are hashed by BLAKE2b.
LONG = 64

_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_SEEDS = (0x1234567, 0x89ABCDE)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, _inverse(base)
        self.up = self.down = np.ones(1, U64)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            steps = np.full(size, self.base, U64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=U64)
            steps[1:] = self.inv
            self.down = np.cumprod(steps, dtype=U64)
        return self.up[:n], self.down[:n]


_POWERS = tuple(_Powers(b) for b in _BASES)
_CODES = tuple(np.random.default_rng(s).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1) for s in _SEEDS)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply); a bijection."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


class Chunk:
    """Texts laid end to end: ``data`` bytes, ``offsets`` (n + 1), rows ``first``.. of the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int) -> None:
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a column of texts into chunks of about ``limit`` bytes at document boundaries."""
    data, off = text_buffers(column)
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield Chunk(data[off[at] : off[to]], off[at : to + 1] - off[at], at)
        at = to


def byte_table(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words of any characters but space and the controls 9 to 13.
SPACED = byte_table(b" \t\n\x0b\x0c\r")
#: Words of digits, lower-case ASCII letters and everything beyond ASCII.
ALNUM = byte_table(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes kept."""
    return _LOWER[data]


class Words:
    """Words of a chunk: byte spans, their document, and the first word of each document."""

    def __init__(self, chunk: Chunk, table: np.ndarray, lower: bool = False) -> None:
        self.chunk = chunk
        self.data = data = lowered(chunk.data) if lower else chunk.data
        if not len(data):
            self.start = self.end = np.zeros(0, np.int64)
        else:
            inside = table[data]
            edge = np.empty(len(data) + 1, bool)
            edge[0], edge[-1] = inside[0], False
            edge[1:-1] = inside[1:] & ~inside[:-1]
            cut = chunk.offsets[:-1][chunk.offsets[:-1] < len(data)]
            edge[cut] |= inside[cut]
            self.start = np.flatnonzero(edge[:-1])
            stop = np.empty(len(data), bool)
            stop[-1] = inside[-1]
            stop[:-1] = inside[:-1] & ~inside[1:]
            last = chunk.offsets[1:] - 1
            last = last[last >= 0]
            stop[last] |= inside[last]
            self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, chunk.offsets[:-1], "left")
        self.bounds = np.append(self.first, len(self.start))
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(chunk.n), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return stretch_hashes(self.data, self.start, self.end, seed)


def prefix_sums(codes: np.ndarray, seed: int = 0) -> np.ndarray:
    """Prefix sums of a polynomial hash over 64-bit codes (length n + 1)."""
    up, _ = _POWERS[seed].take(len(codes) + 1)
    sums = np.empty(len(codes) + 1, U64)
    sums[0] = 0
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the stretches [start, end); equal stretches have equal hashes wherever they lie."""
    _, down = _POWERS[seed].take(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def stretch_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of byte stretches of any length, long ones by BLAKE2b."""
    out = span_hashes(prefix_sums(byte_codes(data, seed), seed), start, end, seed)
    for i in np.flatnonzero(end - start > LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([seed]))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def byte_codes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    return _CODES[seed][data]


def ragged_hashes(data: np.ndarray, bounds: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the stretches between bounds, some MB at a time."""
    out, at, n = np.empty(len(bounds) - 1, U64), 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, "right")) - 1)
        b = bounds[at : to + 1] - bounds[at]
        out[at:to] = span_hashes(prefix_sums(byte_codes(data[bounds[at] : bounds[to]], seed), seed), b[:-1], b[1:], seed)
        at = to
    return out


def rolling(sums: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of all stretches of ``width`` units; the caller drops those that cross documents."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, U64)
    _, down = _POWERS[seed].take(len(sums))
    return mix((sums[width:] - sums[:-width]) * down[:n])


def window_mask(bounds: np.ndarray, width: int, n: int) -> np.ndarray:
    """True at starts of ``width``-unit stretches inside one document; ``bounds`` delimit documents."""
    ok = np.ones(max(n, 0), bool)
    # a start is bad if it lies within the last width - 1 units of its document
    lo, hi = np.maximum(bounds[1:] - width + 1, bounds[:-1]), bounds[1:]
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, np.minimum(lo, n), 1)
    np.add.at(delta, np.minimum(hi, n), -1)
    ok[np.cumsum(delta[:-1]) > 0] = False
    return ok


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def covered(starts: np.ndarray, widths: np.ndarray | int, n: int) -> np.ndarray:
    """Mask of the units covered by stretches."""
    delta = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + widths, n), minlength=n + 1)
    return np.cumsum(delta[:n]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, touching ones joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


def grouped_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values in each [bounds[i], bounds[i + 1])."""
    sums = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return sums[bounds[1:]] - sums[bounds[:-1]]
