"""Substring dedup on words: a count-min prefilter before exact grouping.

A window is ``width`` consecutive words.  First pass: every partition sketches
how often its windows' anchors occur (:mod:`keyloom.llm.repeats`); the merged
count-min sketch overestimates, so a window that occurs twice is never lost.
Second pass: only windows estimated repeated are grouped, exactly, by a 96-bit
digest of their word sequence (two hashes of independent word hashes); of each group the document with the smallest id
keeps its words and all others lose them.

Within a chunk equal runs of windows are reduced to that of the smallest
document before anything is shuffled, so a passage that a third of the corpus
shares costs one record a chunk.  The sketch's size is bounded by
:class:`repeats.Sketch`; see there for what happens beyond the bound.

Nulls and edge cases: a null text has no words; texts shorter than a window are
kept; rows with equal doc_id never remove each other's words; a null doc_id
comes after all others; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import repeats as R
from .common import buckets, dealt, text_bytes

U64 = np.uint64


@dataclass(frozen=True)
class Passages:
    """Parameters: window and anchor widths in words, the sketch, and the MB held before sending."""

    width: int = 50
    gram: int = 10
    sketch: R.Sketch = field(default_factory=lambda: R.Sketch(rows=3, most_bits=27))
    held_mb: int = 96


def _windows(p: Passages) -> Callable[[K.Chunk], R.Windows]:
    def of(chunk: K.Chunk) -> R.Windows:
        words = K.Words(chunk, K.SPACED)
        return R.Windows(words.hashes(), words.bounds, p.width, p.gram)

    return of


def _sender(p: Passages, bits: int, bitmap, n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Resolve copies within the held chunks, deal the rest to buckets by anchor."""

    def send(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        offsets = np.concatenate(([0], np.cumsum(x["many"])))
        first, last = offsets[:-1], offsets[1:] - 1
        cls, least = R.first_of_class(x["doc"], x["w1"][first], x["w2"][first].astype(U64), x["w1"][last], x["many"])
        later = x["doc"] > least[cls]
        # of each class, the runs of its least document go on; the others are copies of them
        s, e = x["start"][later], (x["start"] + x["many"] + p.width - 1)[later]
        docs, keys, s, e = R.row_spans(x["doc"][later], x["key"][later], s, e)
        bucket = (x["anchor"] % U64(n_buckets)).astype(np.int64)
        order = np.flatnonzero(~later)
        order = order[np.argsort(bucket[order], kind="stable")]
        cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(cut)).tolist():
            r = order[cut[b] : cut[b + 1]]
            w = R.ragged(offsets[r], x["many"][r])
            rows.append(
                (
                    b, x["key"][r].tobytes(), x["doc"][r].tobytes(), x["start"][r].astype(np.uint32).tobytes(),
                    x["many"][r].astype(np.uint16).tobytes(), x["w1"][w].tobytes(), x["w2"][w].tobytes(),
                )
            )
        if len(keys):
            rows.append((int(keys[0]) % n_buckets, keys.tobytes(), docs.tobytes(), s.tobytes(), e.tobytes(), b"", b""))
        columns = list(zip(*rows)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])],
            ["bucket", "key", "doc", "start", "many", "w1", "w2"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = R.Held()
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for chunk in K.chunks(batch.column("text")):
                words = K.Words(chunk, K.SPACED)
                h = words.hashes()
                runs = R.Windows(h, words.bounds, p.width, p.gram)
                on = np.flatnonzero(R.repeated(runs.anchor, bits, bitmap.value, p.sketch.rows))
                if not len(on):
                    continue
                w = R.ragged(runs.start[on], runs.many[on])
                one = K.span_hashes(K.prefix_sums(h), w, w + p.width)
                two = K.span_hashes(K.prefix_sums(words.hashes(1), 1), w, w + p.width, 1)
                row = runs.doc[on]
                held.add(
                    key=keys[chunk.first + row], doc=docs[chunk.first + row], start=runs.start[on] - words.bounds[row], many=runs.many[on],
                    anchor=runs.anchor[on],
                )
                held.add(w1=one, w2=(two >> U64(32)).astype(np.uint32))
                if held.bytes > p.held_mb << 20:
                    yield send(held.take())
        if held.bytes:
            yield send(held.take())

    return run


def _grouper(p: Passages) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One bucket: windows by digest; a window is covered if a smaller document holds it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = R.Held()
        for batch in batches:
            for key, doc, start, many, w1, w2 in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "start", "many", "w1", "w2"))):
                keys = np.frombuffer(key, np.int64)
                if not w1:
                    yield R.spans_frame(np.frombuffer(doc, np.int64), keys, np.frombuffer(start, np.int64), np.frombuffer(many, np.int64))
                    continue
                n = np.frombuffer(many, np.uint16).astype(np.int64)
                pos = R.ragged(np.frombuffer(start, np.uint32).astype(np.int64), n)
                held.add(
                    key=np.repeat(keys, n), doc=np.repeat(np.frombuffer(doc, np.int64), n), pos=pos, w1=np.frombuffer(w1, U64),
                    w2=np.frombuffer(w2, np.uint32),
                )
        if held.bytes:
            x = held.take()
            cls, least = R.first_of_class(x["doc"], x["w2"], x["w1"])
            on = x["doc"] > least[cls]
            yield R.spans_frame(*R.row_spans(x["doc"][on], x["key"][on], x["pos"][on], x["pos"][on] + p.width))

    return run


def repeated_passages(docs: DataFrame, passages: Passages | None = None) -> DataFrame:
    """Word spans (doc_id, key, start, end) that a document with a smaller id holds too; rows are named as in :func:`repeats.keyed`."""
    p = passages or Passages()
    texts = R.keyed(docs)
    size = text_bytes(texts)
    bits, bitmap = R.merged_sketch(texts, _windows(p), math.ceil(size / (3.0 * (p.width - p.gram + 2) / 2)), p.sketch)
    n = buckets(docs.sparkSession, size)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)  # rows * 2**bits / 8 bytes, bounded by Sketch.most_bits
    records = texts.mapInArrow(_sender(p, bits, sent, n), "bucket long, key binary, doc binary, start binary, many binary, w1 binary, w2 binary")
    return dealt(records, n).mapInArrow(_grouper(p), R.SPANS)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, s, e in R.batch_rows(batch):
            words = text.split()  # splits bytes at the blank and the controls 9 to 13
            kept, at = [], 0
            for a, b in zip(s.tolist(), e.tolist()):
                kept += words[at:a]
                at = b
            kept += words[at:]
            out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
        columns = list(zip(*out)) if out else [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def without_passages(docs: DataFrame, passages: Passages | None = None) -> DataFrame:
    """Every row of ``docs`` with its kept words, their digest, and how many were removed."""
    return R.with_spans(
        docs, repeated_passages(docs, passages), _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string",
    )
