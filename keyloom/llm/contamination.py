"""Benchmark decontamination: a prefix-filtered set join, verified over item-sized windows.

Every benchmark item is cut into windows of ``width`` consecutive words (an item
of fewer words is one window).  A window is contained in a document only if all
its words are, so a single word is a complete prefix at containment 1; the
rarest one makes the shortest candidate lists.  The steps:

1. count, over all documents, the words that occur in the benchmark (a bounded
   vocabulary) and order each window's words by rarity;
2. index the windows by their rarest word and its place in the window;
3. read the documents once: every occurrence of a prefix word names the windows
   it may belong to; the positional bound (the window must fit between the ends
   of the document) and the length bound discard most, the window's hash the
   rest, and the words themselves confirm what is left.

The benchmark is the stated query set.  Its windows are sent to the executors
in blocks of at most ``block_windows``, each in a pass of its own, so neither a
broadcast nor what a task holds outgrows its bound however large the benchmark
is.  Documents are not shuffled for one block; for several, only those without a
hit have to be told from the others by (doc_id, text hash).

Nulls and edge cases: a null or wordless text has no words and is clean; a null
or wordless item has no windows; the windows of an item without item_id hit like
any other but add nothing to the items found; repeated items count once per item_id; repeated
document rows give repeated result rows; extra columns are ignored; an empty
benchmark hits nothing and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R
from .common import written


@dataclass(frozen=True)
class Windows:
    """Parameters: window width in words, and the most windows in one broadcast block."""

    width: int = 10
    block_windows: int = 1_000_000


SCHEMA = "doc_id long, key long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _words(text: bytes) -> list[bytes]:
    chunk = K.Chunk(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0)
    w = K.Words(chunk, K.ALNUM, lower=True)
    low = w.data.tobytes()
    return [low[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes that :class:`kernels.Words` gives to these words."""
    joined = b" ".join(words)
    off = np.cumsum([0] + [len(w) + 1 for w in words])
    data = np.frombuffer(joined, np.uint8)
    return K.stretch_hashes(data, off[:-1], off[:-1] + np.array([len(w) for w in words], np.int64))


def item_windows(text: bytes, width: int) -> list[tuple[bytes, ...]]:
    words = _words(text)
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def _counter(vocabulary: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for chunk in K.chunks(batch.column(0)):
                h = K.Words(chunk, K.ALNUM, lower=True).hashes()
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                counts += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts)), pa.array(counts[counts > 0])], ["word", "n"])

    return run


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences, in all documents, of each word of a sorted vocabulary of hashes."""
    sums = docs.select("text").mapInArrow(_counter(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(vocabulary), np.int64)
    for r in sums.collect():  # as many rows as the block's vocabulary at most
        counts[r["word"]] = r["n"]
    return counts


class Index:
    """Windows of a block by their rarest word."""

    def __init__(self, windows: list[tuple[bytes, ...]], owners: list[list[str]], hashes: dict[bytes, int], rarity: dict[bytes, int]) -> None:
        self.windows, self.owners = windows, owners
        sizes = np.array([len(w) for w in windows], np.int64)
        place = [min(range(len(w)), key=lambda i: (rarity.get(w[i], 0), w[i], i)) for w in windows]
        prefix = np.array([hashes[w[p]] for w, p in zip(windows, place)], np.uint64)
        order = np.argsort(prefix, kind="stable")
        self.prefix, self.place, self.size, self.which = prefix[order], np.array(place, np.int64)[order], sizes[order], order
        self.keys, self.first, self.many = np.unique(self.prefix, return_index=True, return_counts=True)
        self.hash = np.array([self._hash([hashes[x] for x in windows[i]]) for i in order.tolist()], np.uint64)

    @staticmethod
    def _hash(words: list[int]) -> int:
        sums = K.prefix_sums(np.array(words, np.uint64))
        return int(K.span_hashes(sums, np.array([0]), np.array([len(words)]))[0])

    def hits(self, words: K.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers, ascending) and windows of all occurrences."""
        if not len(self.keys) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        pos = np.flatnonzero(self.keys[at] == hashes)
        key = at[pos]
        many = self.many[key]
        pos = np.repeat(pos, many)
        ends = np.cumsum(many)
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[key] - (ends - many), many)
        start = pos - self.place[entry]
        stop = start + self.size[entry]
        doc = words.doc[pos]
        fits = (start >= words.bounds[doc]) & (stop <= words.bounds[doc + 1])
        start, stop, entry = start[fits], stop[fits], entry[fits]
        same = K.span_hashes(K.prefix_sums(hashes), start, stop) == self.hash[entry]
        start, entry = start[same], entry[same]
        data = words.data
        exact = [
            all(data[words.start[s + j] : words.end[s + j]].tobytes() == w for j, w in enumerate(self.windows[self.which[e]]))
            for s, e in zip(start.tolist(), entry.tolist())
        ]
        keep = np.array(exact, bool)
        start, entry = start[keep], entry[keep]
        order = np.argsort(start, kind="stable")
        return start[order], entry[order]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ITEMS = pa.list_(pa.string())


def _finder(index: Index, hit_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, key, text) to each row's words, spans and items, or to those of rows that are hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                words = K.Words(chunk, K.ALNUM, lower=True)
                start, entry = index.hits(words, words.hashes())
                spans: list[list] = [[] for _ in range(chunk.n)]
                items: list[list] = [[] for _ in range(chunk.n)]
                doc = words.doc[start]
                edge = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    d, base = int(doc[a]), int(words.bounds[doc[a]])
                    s, e = K.merge_spans(start[a:b] - base, start[a:b] - base + index.size[entry[a:b]])
                    spans[d] = [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())]
                    items[d] = sorted({x for w in np.unique(index.which[entry[a:b]]).tolist() for x in index.owners[w]})
                part = batch.slice(chunk.first, chunk.n)
                out = pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(words.counts.astype(np.int64)), pa.array(spans, _SPANS), pa.array(items, _ITEMS)], [
                        "doc_id", "key", "n_words", "spans", "items",
                    ]
                )
                yield out.filter(pa.array([bool(x) for x in spans])) if hit_only else out

    return run


def _blocks(benchmark: DataFrame, rules: Windows) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """The benchmark's distinct windows with their items, a bounded block at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    block: dict[tuple[bytes, ...], set[str]] = {}
    given = False
    for r in rows.dropDuplicates().toLocalIterator():  # one partition of the query set at a time
        if r["text"] is None:
            continue
        for w in item_windows(r["text"].encode(), rules.width):
            owners = block.setdefault(w, set())
            if r["item_id"] is not None:
                owners.add(r["item_id"])
        if len(block) >= rules.block_windows:
            yield block
            block, given = {}, True
    if block or not given:
        yield block


def _indexes(texts: DataFrame, benchmark: DataFrame, rules: Windows) -> Iterator[Index]:
    """An index of each block of the benchmark, its windows' words ordered by their rarity in all texts."""
    for block in _blocks(benchmark, rules):
        words = sorted({w for x in block for w in x})
        hashes = dict(zip(words, word_hashes(words).tolist())) if words else {}
        vocabulary = np.unique(np.fromiter(hashes.values(), np.uint64, len(hashes)))
        counts = dict(zip(vocabulary.tolist(), word_counts(texts, vocabulary).tolist())) if words else {}
        yield Index(list(block), [sorted(v) for v in block.values()], hashes, {w: counts[h] for w, h in hashes.items()})


def _hits(texts: DataFrame, index: Index, hit_only: bool) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(index)  # a block of at most block_windows windows
    return texts.mapInArrow(lambda it: _finder(sent.value, hit_only)(it), SCHEMA)


def _further(texts: DataFrame, indexes: list[Index], following: Iterator[Index]) -> DataFrame:
    """Rows hit by the windows of several blocks: one pass and one small table a block, so a task holds one index at a time."""
    found = [written(_hits(texts, i, True), "hits") for i in indexes]
    found += [written(_hits(texts, i, True), "hits") for i in following]
    return reduce(DataFrame.unionByName, found)


def matches(docs: DataFrame, benchmark: DataFrame, rules: Windows | None = None) -> DataFrame:
    """Per row of ``docs``: its number of words, the merged spans (word numbers) hit, and the items found.

    One block needs no shuffle.  Of several, each is read against all documents
    by itself; the rows' findings meet by (doc_id, text hash), without texts.
    """
    rules = rules or Windows()
    texts = R.keyed(docs)
    own = F.nullif(F.col("doc_id"), F.lit(R.NO_ID)).alias("doc_id")
    indexes = _indexes(texts.select("text"), benchmark, rules)
    index, second = next(indexes), next(indexes, None)
    if second is None:
        return _hits(texts, index, False).select(own, "n_words", "spans", "items")
    # rows alike in doc_id and text have the same findings
    hits = _further(texts, [index, second], indexes).dropDuplicates()
    by_row = hits.groupBy("doc_id", "key").agg(
        F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    rows = _hits(texts, Index([], [], {}, {}), False).select("doc_id", "key", "n_words")
    none, no_items = F.array().cast("array<struct<start:bigint,end:bigint>>"), F.array().cast("array<string>")
    # spans in order of their starts, joined where they meet
    last = lambda out: F.element_at(out, -1)
    meet = lambda out, x: F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last(out)["start"].alias("start"), F.greatest(last(out)["end"], x["end"]).alias("end"))))
    spans = F.aggregate(
        F.array_sort("s"), none, lambda out, x: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= x["start"]), meet(out, x)).otherwise(F.concat(out, F.array(x))),
    )
    joined = rows.join(by_row.withColumn("spans", spans), ["doc_id", "key"], "left")
    return joined.select(own, "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", no_items).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and item digest of :func:`matches`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, rules: Windows | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of the benchmark occurs; no shuffle for one block."""
    rules = rules or Windows()
    left = docs.withColumn("text", F.col("text").cast("string"))
    texts = R.keyed(docs)
    indexes = _indexes(texts.select("text"), benchmark, rules)
    index, second = next(indexes), next(indexes, None)
    if second is not None:
        hit = _further(texts, [index, second], indexes).select("doc_id", "key").distinct()
        named = left.select(
            F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("own"), F.coalesce(F.col("doc_id").cast("long"), F.lit(R.NO_ID)).alias("doc_id"),
            F.xxhash64("text").alias("key"),
        )
        return named.join(hit, ["doc_id", "key"], "left_anti").select("own.*")
    sent = docs.sparkSession.sparkContext.broadcast(index)  # a block of at most block_windows windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column("text")):
                words = K.Words(chunk, K.ALNUM, lower=True)
                start, _ = sent.value.hits(words, words.hashes())
                clean = np.ones(chunk.n, bool)
                clean[words.doc[start]] = False
                yield batch.slice(chunk.first, chunk.n).filter(pa.array(clean))

    return left.mapInArrow(run, left.schema)
