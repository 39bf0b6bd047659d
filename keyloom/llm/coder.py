"""Token ids of many texts through a memory of distinct pieces.

A tokeniser never merges across the piece boundaries used here, so each
distinct piece of text is encoded once a worker and its ids are looked up
afterwards.  The memory is bounded and starts afresh when it is full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import kernels as K


class PieceCoder:
    """Ids of pieces, remembered by the pieces' hashes; ``encode`` maps texts to lists of ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 600_000) -> None:
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.offsets = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, texts: list[str]) -> None:
        got = self.encode(texts)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        n, have = self.used, int(self.offsets[self.used])
        while n + len(got) + 1 > len(self.offsets):
            self.offsets = np.concatenate((self.offsets, np.zeros(len(self.offsets), np.int64)))
        self.offsets[n + 1 : n + 1 + len(got)] = have + np.cumsum(lengths)
        total = int(lengths.sum())
        while have + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.int32)))
        self.flat[have : have + total] = [t for x in got for t in x]
        self.used = n + len(got)

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and the number of ids of each piece."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slot) + len(distinct) > self.most and self.slot:
            self.forget()
        slot, keys = self.slot, distinct.tolist()
        at = [slot.get(h, -1) for h in keys]
        where = np.array(at, np.int64)
        new = np.flatnonzero(where < 0)
        if len(new):
            raw = data.tobytes()
            f = first[new]
            self_first = self.used
            self._add([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[f].tolist(), end[f].tolist())])
            where[new] = np.arange(self_first, self.used)
            slot.update(zip(distinct[new].tolist(), range(self_first, self.used)))
        where = where[inverse]
        counts = self.offsets[where + 1] - self.offsets[where]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(self.offsets[where] - (ends - counts), counts)
        return self.flat[index], counts


def segments(chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts before white space so that byte-level pre-tokenisation of the parts equals that of the whole.

    A part is a run of white space and what follows it.  A cut is made only
    before a blank or a newline, and only after a printable ASCII byte or a
    multi-byte character that cannot be white space itself.  Returns starts,
    ends and the bounds of each document's segments.
    """
    d = chunk.data
    n = len(d)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(chunk.n + 1, np.int64)
    cut = np.zeros(n, bool)
    gap = (d[1:] == 32) | (d[1:] == 10)
    before = d[:-1]
    solid = (before > 32) & (before < 127)
    wide = before >= 0x80
    wide[1:] &= d[:-2] != 0xC2
    wide[2:] &= (d[:-3] < 0xE1) | (d[:-3] > 0xE3)
    cut[1:] = gap & (solid | wide)
    inside = chunk.offsets[:-1][chunk.offsets[:-1] < n]
    cut[inside] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    bounds = np.append(np.searchsorted(start, chunk.offsets[:-1], "left"), len(start))
    return start, end, bounds
