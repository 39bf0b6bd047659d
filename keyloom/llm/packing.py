"""Packing: order-preserving dynamic programming over cut positions.

Documents are tokenised and laid end to end in their order; a sequence is a
window of at most ``length`` tokens between two cuts.  Cuts may lie at document
ends (free), at sentence ends (a small penalty) and, so that no stretch without
a sentence end blocks the way, at every ``stride``-th token (a larger one).
The cuts minimise

    sum over sequences of (padding + penalty of the cut that ends it)

With padding ``length - (j - i)`` the recurrence is

    best[j] = length - pos[j] + penalty[j] + min(best[i] + pos[i]),  pos[j] - length <= pos[i] < pos[j]

whose minimum slides over a window, so one monotone queue serves all
transitions in time proportional to the number of positions.  The rest at the
end of a block of documents is cut at powers of two, which need no padding.

Documents never leave the partition that the scan gives them: there is no
shuffle, each task packs its own blocks, and a block is bounded in tokens.

Added tokens of the tokenizer (``<|endoftext|>``) that a text holds get their
own ids, as the tokenizer gives them.

Nulls and edge cases: a null text counts as empty; an empty text is its end
token alone; a very long text spans several blocks' worth of tokens and is cut
like any other; repeated rows are packed as often as they occur; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .coder import PieceCoder, segments


@dataclass(frozen=True)
class Packer:
    """Parameters; ``ranks`` holds the same vocabulary as ``tokenizer``, as merge ranks."""

    ranks: str = field(default_factory=lambda: public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokenizer: str = field(default_factory=lambda: public_tokenizers.path("byte_bpe_50k.json"))
    pattern: str = public_tokenizers.PATTERN
    end_id: int = 0
    length: int = 1024
    sentence_penalty: int = 1
    stride_penalty: int = 6
    stride: int = 32
    block_tokens: int = 1 << 20
    remembered: int = 400_000


def added_tokens(tokenizer: str) -> dict[str, int]:
    """The tokenizer's added tokens; in plain text, too, it matches them before all else."""
    import json

    with open(tokenizer, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in what is beside them are not supported")
    return {t["content"]: t["id"] for t in added}


@lru_cache(maxsize=2)
def byte_coder(ranks: str, pattern: str, most: int, tokenizer: str) -> PieceCoder:
    """One a worker process, shared by its tasks."""
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    added = added_tokens(tokenizer)
    literal = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
    widths = np.zeros(max(table.values()) + 1, np.int64)
    widths[list(table.values())] = [len(k) for k in table]

    def split_at_added(text: str) -> list[int]:
        """What is between added tokens is encoded by itself; none holds white space, so a segment has them whole."""
        out, at = [], 0
        for m in literal.finditer(text):
            out += [*own.encode_ordinary(text[at : m.start()]), added[m[0]]]
            at = m.end()
        return out + own.encode_ordinary(text[at:])

    def encode(texts: list[str]) -> list[list[int]]:
        """All parts in one call where they begin with a blank or a newline and end in what is none.

        Such parts are tokenised alike alone and side by side; the tokens'
        widths tell where each part ends.  Parts with added tokens are split there.
        """
        joint = [i for i, t in enumerate(texts) if t[0] in " \n" and t[-1].isprintable() and not t[-1].isspace() and not literal.search(t)]
        out: list[list[int]] = [[]] * len(texts)
        ids = np.array(own.encode_ordinary("".join(texts[i] for i in joint)), np.int64)
        ends = np.searchsorted(np.cumsum(widths[ids]), np.cumsum([len(texts[i].encode()) for i in joint])) + 1 if joint else []
        flat, at = ids.tolist(), 0
        for i, end in zip(joint, ends.tolist() if joint else []):
            out[i] = flat[at:end]
            at = end
        for i in set(range(len(texts))).difference(joint):
            out[i] = split_at_added(texts[i])
        return out

    return PieceCoder(encode, most)


def tokenise(chunk: K.Chunk, coder: PieceCoder, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all documents with their end ids, document bounds, and the positions after sentence ends."""
    start, end, bounds = segments(chunk)
    hashes = K.stretch_hashes(chunk.data, start, end) if len(start) else np.zeros(0, np.uint64)
    ids, counts = coder.ids(chunk.data, start, end, hashes) if len(start) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    per_doc = K.grouped_sum(counts, bounds)
    doc_bounds = np.concatenate(([0], np.cumsum(per_doc + 1)))
    out = np.full(int(doc_bounds[-1]), end_id, np.uint32)
    inner = np.ones(len(out), bool)
    inner[doc_bounds[1:] - 1] = False
    out[inner] = ids
    # a sentence ends where a segment ends in a full stop, an exclamation or a question mark
    if len(start):
        last = chunk.data[end - 1]
        stop = (last == 46) | (last == 33) | (last == 63)
        seg_doc = np.repeat(np.arange(chunk.n), np.diff(bounds))
        marks = (np.cumsum(counts) + seg_doc)[stop]
    else:
        marks = np.zeros(0, np.int64)
    return out, doc_bounds, marks


def cuts(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, p: Packer) -> np.ndarray:
    """Positions 0 < .. <= n at which sequences end, the last being the start of the block's rest or n."""
    grid = np.arange(p.stride, n + 1, p.stride)
    pos = np.unique(np.concatenate(([0], doc_ends, sentence_ends, grid, [n])))
    cost = np.full(len(pos), p.stride_penalty, np.int64)
    cost[np.searchsorted(pos, sentence_ends)] = p.sentence_penalty
    cost[np.searchsorted(pos, doc_ends)] = 0
    cost[0] = 0
    where, penalty = pos.tolist(), cost.tolist()
    best, back = [0] * len(where), [0] * len(where)
    queue: deque[int] = deque()
    length, values = p.length, [0] * len(where)
    for j in range(1, len(where)):
        at = where[j]
        v = values[j - 1]
        while queue and values[queue[-1]] >= v:
            queue.pop()
        queue.append(j - 1)
        while where[queue[0]] < at - length:
            queue.popleft()
        i = queue[0]
        b = length - at + penalty[j] + values[i]
        best[j], back[j] = b, i
        values[j] = b + at
    out, j = [], len(where) - 1
    while j:
        out.append(where[j])
        j = back[j]
    return np.array(out[::-1], np.int64)


def powers(n: int) -> list[int]:
    """n as a sum of distinct powers of two, greatest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def sequence_ends(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, p: Packer) -> np.ndarray:
    """Cuts of a block; sequences far from full at its end are cut anew at powers of two."""
    ends = cuts(n, doc_ends, sentence_ends, p)
    if len(ends) and (rest := int(ends[-1] - (ends[-2] if len(ends) > 1 else 0))) < p.length:
        first = int(ends[-1]) - rest
        ends = np.concatenate((ends[:-1], first + np.cumsum(powers(rest))))
    return ends


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def _packer(p: Packer, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], first_sequence: int) -> tuple[pa.RecordBatch, int]:
        ids = np.concatenate([x[0] for x in parts])
        shift = np.concatenate(([0], np.cumsum([len(x[0]) for x in parts])))
        bounds = np.concatenate([x[1][:-1] + s for x, s in zip(parts, shift)] + [shift[-1:]])
        marks = np.concatenate([x[2] + s for x, s in zip(parts, shift)])
        doc_ids = np.concatenate([x[3] for x in parts])
        ends = sequence_ends(len(ids), bounds[1:], marks, p)
        cut = np.unique(np.concatenate((bounds, ends, [0])))
        a, b = cut[:-1], cut[1:]
        doc = np.searchsorted(bounds, a, "right") - 1
        seq = np.searchsorted(ends, a, "right")
        seq_start = np.concatenate(([0], ends))[seq]
        raw, crc = memoryview(np.ascontiguousarray(ids, "<u4").tobytes()), zlib.crc32
        sums = [crc(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())]
        if with_ids:
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)))
        else:
            lists = pa.nulls(len(a), pa.list_(pa.int32()))
        tokens = np.diff(bounds)
        columns = [doc_ids[doc], a - bounds[doc], b - a, np.array(sums, np.int64), tokens[doc], seq + first_sequence, a - seq_start]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(c, np.int64)) for c in columns), lists], names), first_sequence + len(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = byte_coder(p.ranks, p.pattern, p.remembered, p.tokenizer)
        number = TaskContext.get().partitionId() << 40  # sequences of a task are numbered within its own range
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for chunk in K.chunks(batch.column("text"), 2 * K.CHUNK_BYTES):
                ids, bounds, marks = tokenise(chunk, coder, p.end_id)
                doc_ids = batch.column("doc_id").slice(chunk.first, chunk.n).cast(pa.int64()).to_numpy(zero_copy_only=False)
                held.append((ids, bounds, marks, doc_ids))
                size += len(ids)
                if size >= p.block_tokens:
                    out, number = pack(held, number)
                    yield out
                    held, size = [], 0
        if held:
            out, number = pack(held, number)
            yield out

    return run


def pack(docs: DataFrame, packer: Packer | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences; ``ids`` are the pieces' tokens."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(_packer(packer or Packer(), with_ids), SCHEMA)
