"""N-gram Jaccard join over count vectors.

A document's set holds its distinct ``shingle``-word shingles.  Two documents
link when ``100 * intersection >= percent * union``; the join returns each
document's class (equal sets), component (reachable by links) and, if asked,
its number of links.

1. *Rarity.*  A sketch of bounded size estimates in how many texts each shingle
   occurs, as a level of four bits.  Level and hash order all shingles.
2. *Prefixes.*  Linked sets share one of the first ``n - ceil(percent n / 100) + 1``
   shingles of either, whatever the order; shingles that occur in one text alone
   are left out, so most documents send nothing.  Classes that share a prefix
   shingle and whose sizes allow a link are joined into *families*; no link
   leaves a family.
3. *Families.*  A family's whole texts go to one task, which hashes shingles into
   groups, indexes the group counts as points of an R-tree (sort-tile-recursive
   packing, boxes with the greatest count per coordinate), bounds overlaps by
   summed coordinate minima, and verifies each surviving pair on the shingles
   themselves.  Verified links are united at once; of an already united pair
   nothing is compared unless links are counted.  Only one row a class leaves.
4. *Large families* are dealt to tiles of at most ``tile`` shingles.  Counting
   links compares all pairs of tiles.  Otherwise each tile is united around a
   shared pivot first, and only what is not in the family's largest component
   is compared with the other tiles, so a hot group of near copies costs one
   comparison each.

Shingles are compared by two 64-bit hashes with bases of their own; words of
more than 64 bytes enter by BLAKE2b (:mod:`keyloom.llm.kernels`).  Documents with
equal sets are one class from the start, so exact copies are never compared.

Nulls and edge cases: a null or wordless text has an empty set, links with
nothing and is a class and component of its own; a text of fewer words than a
shingle has its whole word sequence as single shingle; repeated rows are copies;
a null doc_id counts as the greatest and is returned as null unless it is alone;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R
from .common import buckets, dealt, text_bytes, written
from .components import components

U64 = np.uint64
NO_ID = 2**63 - 1
#: A class weighs as many shingles at least when tiles are filled.
_LEAST_WEIGHT = 64
WITHIN = 2


@dataclass(frozen=True)
class Join:
    """Parameters.

    Shingle length and least similarity in percent; most groups of the count
    vectors and the tree's leaf size; whether links are counted; MB held before
    sending; the sketch's greatest size (2**``most_bits`` counters of four bits,
    64 MB at 27) and its shards; the shingles that a task compares at once.
    """

    shingle: int = 3
    percent: int = 90
    groups: int = 128
    leaf: int = 16
    count_links: bool = True
    held_mb: int = 24
    most_bits: int = 27
    shards: int = 64
    tile: int = 1 << 20

    def needed(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
        """Least intersection of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many shingles of a set of n, in any fixed order, hold one of every linked set's own prefix."""
        return n - -(-self.percent * n // 100) + 1


def shingle_sets(chunk: K.Chunk, join: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text by ascending hash, their second hashes, and the bounds of each text's."""
    words = K.Words(chunk, K.SPACED, lower=True)
    sums = [K.prefix_sums(words.hashes(s), s) for s in (0, 1)]
    start = np.flatnonzero(K.window_mask(words.bounds, join.shingle, max(len(words) - join.shingle + 1, 0)))
    short = np.flatnonzero((words.counts > 0) & (words.counts < join.shingle))
    first, last = np.concatenate((start, words.bounds[short])), np.concatenate((start + join.shingle, words.bounds[short + 1]))
    one, two = (K.span_hashes(x, first, last, s) for s, x in enumerate(sums))
    doc = np.concatenate((words.doc[start], short))
    order = np.argsort(one)
    doc = doc[order].astype(np.uint16 if chunk.n <= 1 << 16 else np.int64)  # the stable sort of small numbers takes one pass
    again = np.argsort(doc, kind="stable")
    order, doc = order[again], doc[again]
    one, two = one[order], two[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (doc[1:] != doc[:-1])
    n = np.bincount(doc[new], minlength=chunk.n)
    return one[new], two[new], np.concatenate(([0], np.cumsum(n))).astype(np.int64)


def fingerprints(one: np.ndarray, two: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits for each set, as rows of two words, one from either hash; equal sets have equal ones, the empty set zeros."""
    n = np.diff(bounds).astype(U64)
    sums = [K.grouped_sum(K.mix(v ^ U64(salt)), bounds) for v, salt in ((one, 0x5851F42D4C957F2D), (two, 0x14057B7EF767814F))]
    out = np.stack([K.mix(sums[0] + n), K.mix(sums[1] ^ (n << U64(32)))], 1)
    out[n == 0] = 0
    return out


def _places(values: np.ndarray, bits: int) -> np.ndarray:
    return (K.mix(values ^ U64(0x2545F4914F6CDD1D)) >> U64(64 - bits)).astype(np.int64)


def rarity(texts: DataFrame, size: int, join: Join) -> tuple[int, np.ndarray]:
    """Bits of the sketch of texts of ``size`` bytes, and its levels: the whole logarithm of each counter, two to a byte.

    Partitions send the places of their shingles by shard, as steps between
    sorted places; a shard adds them up.  Counters are shared when there are more
    shingles than places: levels then only rise, which changes the order and
    which shingles count as single, but loses no link.
    """
    bits = min(max(math.ceil(math.log2(max(size / 5, 2))), 12), join.most_bits)
    shards = min(join.shards, 1 << (bits - 6))
    each = (1 << bits) // shards

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            places = np.sort(np.concatenate(held))
            cut = np.searchsorted(places, np.arange(shards + 1) * each)
            on = np.flatnonzero(np.diff(cut)).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array(on, pa.int64()), pa.array([R._packed(places[cut[s] : cut[s + 1]] - s * each) for s in on], pa.binary())],
                ["shard", "places"],
            )

        for batch in batches:
            for chunk in K.chunks(batch.column(0)):
                held.append(_places(shingle_sets(chunk, join)[0], bits))
                size += len(held[-1])
                if size >= 1 << 20:
                    yield flush()
                    held.clear()
                    size = 0
        if size:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = counts.setdefault(shard, np.zeros(each, np.uint32))
                steps = np.frombuffer(raw, np.uint16).astype(np.int64)
                places = np.cumsum(steps)[steps < 65535]
                edge = np.flatnonzero(np.diff(places, prepend=-1))
                own[places[edge]] += np.diff(np.append(edge, len(places))).astype(np.uint32)
        for shard, own in counts.items():
            level = np.minimum(np.log2(np.maximum(own, 1)).astype(np.uint8), 15)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([(level[::2] | level[1::2] << 4).tobytes()], pa.binary())], ["shard", "levels"],
            )

    sent = texts.select("text").mapInArrow(partial, "shard long, places binary")
    levels = np.zeros((1 << bits) // 2, np.uint8)
    for r in dealt(sent, shards, "shard").mapInArrow(merge, "shard long, levels binary").toLocalIterator():  # 2**bits / 2 bytes in all
        levels[r["shard"] * each // 2 : (r["shard"] + 1) * each // 2] = np.frombuffer(r["levels"], np.uint8)
    return bits, levels


def prefix_shingles(one: np.ndarray, bounds: np.ndarray, bits: int, levels: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of all prefixes, without the shingles of level 0 (those of a single text)."""
    n = np.diff(bounds)
    place = _places(one, bits)
    level = levels[place >> 1] >> ((place & 1) << 2).astype(np.uint8) & 15
    single = K.grouped_sum((level == 0).astype(np.int64), bounds)
    doc = np.flatnonzero((n > 0) & (single < join.prefix(n)))
    index = R.ragged(bounds[doc], n[doc])
    index = index[level[index] > 0]
    many = (n - single)[doc]
    owner = np.repeat(np.arange(len(doc)), many)
    order = np.lexsort((one[index], level[index], owner))
    rank = np.arange(len(index)) - np.repeat(np.cumsum(many) - many, many)
    on = rank < np.repeat(join.prefix(n[doc]) - single[doc], many)
    return doc[owner[on]], one[index[order[on]]]


_PASS = "bucket long, fps binary, size binary, row binary, shingle binary, doc_id array<long>, key array<long>, n array<long>"
_FOUND = "kind int, fp binary, other binary, doc_id long, key long, n long"


def _pass(join: Join, bits: int, levels, n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Read all texts once; deal documents' measures and prefix shingles to buckets."""

    def send(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        fps = np.stack([x["fp1"], x["fp2"]], 1)
        rows: list[tuple] = [(int(x["key"][0]) % n_buckets, fps.tobytes(), b"", b"", b"", x["doc_id"], x["key"], x["n"])]
        # of equal sets one is enough to go through the cells
        first = np.zeros(len(fps), bool)
        first[np.unique(fps, axis=0, return_index=True)[1]] = True
        on = first[x["row"]]
        row, shingle = x["row"][on], x["shingle"][on]
        bucket = (shingle % U64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in np.flatnonzero(np.diff(at)).tolist():
            r = order[at[b] : at[b + 1]]
            used, small = np.unique(row[r], return_inverse=True)
            rows.append((b, fps[used].tobytes(), x["n"][used].tobytes(), small.astype(np.uint32).tobytes(), shingle[r].tobytes(), [], [], []))
        c = list(zip(*rows))
        kinds = [pa.int64(), *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 3]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(c, kinds)], ["bucket", "fps", "size", "row", "shingle", "doc_id", "key", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = R.Held(), 0
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for chunk in K.chunks(batch.column("text")):
                one, two, bounds = shingle_sets(chunk, join)
                fp = fingerprints(one, two, bounds)
                doc, shingle = prefix_shingles(one, bounds, bits, levels.value, join)
                held.add(
                    fp1=fp[:, 0], fp2=fp[:, 1], doc_id=docs[chunk.first : chunk.first + chunk.n], key=keys[chunk.first : chunk.first + chunk.n],
                    n=np.diff(bounds),
                )
                held.add(row=doc + rows, shingle=shingle)
                rows += chunk.n
                if held.bytes > join.held_mb << 20:
                    yield send(held.take())
                    rows = 0
        if rows:
            yield send(held.take())

    return run


def _binary(fp: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(fp, "<u8").tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(fp), [None, pa.py_buffer(raw)]).cast(pa.binary())


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over the edges (a, b)."""
    low = np.arange(n)
    while len(a):
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while (low != low[low]).any():
            low = low[low]
        open_ = low[a] != low[b]
        a, b = a[open_], b[open_]
    return low


def _cells(join: Join) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One bucket: the documents' rows, and an edge from each class to the least one that the bucket joins it with.

    Of the classes of one shingle, ordered by size, neighbours are joined whose
    sizes allow a link: if two of them may link, so may all that lie between.
    """

    def frame(kind: int, many: int, **columns) -> pa.RecordBatch:
        kinds = {"kind": pa.int32(), "fp": pa.binary(), "other": pa.binary(), "doc_id": pa.int64(), "key": pa.int64(), "n": pa.int64()}
        columns["kind"] = np.full(many, kind, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(many, t) for k, t in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = R.Held(), 0
        for batch in batches:
            for fps, size, row, shingle, doc, key, n in zip(*(batch.column(c) for c in ("fps", "size", "row", "shingle", "doc_id", "key", "n"))):
                fp = np.frombuffer(fps.as_py(), U64).reshape(-1, 2)
                if len(row.as_py()) == 0:
                    docs = doc.values.to_numpy()
                    yield frame(0, len(docs), fp=_binary(fp), doc_id=docs, key=key.values.to_numpy(), n=n.values.to_numpy())
                    continue
                held.add(fp1=fp[:, 0], fp2=fp[:, 1], size=np.frombuffer(size.as_py(), np.int64))
                held.add(row=np.frombuffer(row.as_py(), np.uint32).astype(np.int64) + rows, shingle=np.frombuffer(shingle.as_py(), U64))
                rows += len(fp)
        if not rows:
            return
        x = held.take()
        order = np.lexsort((x["fp2"], x["fp1"], x["size"]))  # classes by size, equal ones side by side
        new = np.ones(rows, bool)
        new[1:] = (x["fp1"][order][1:] != x["fp1"][order][:-1]) | (x["fp2"][order][1:] != x["fp2"][order][:-1])
        cls = np.empty(rows, np.int64)
        cls[order] = np.cumsum(new) - 1
        fp, size = np.stack([x["fp1"][order][new], x["fp2"][order][new]], 1), x["size"][order][new]
        member = cls[x["row"]]
        order = np.lexsort((member, x["shingle"]))
        shingle, member = x["shingle"][order], member[order]
        a, b = member[:-1], member[1:]
        near = (shingle[1:] == shingle[:-1]) & (a != b) & (100 * size[a] >= join.percent * size[b])
        low = united(len(fp), a[near], b[near])
        least = low[np.flatnonzero(low != np.arange(len(fp)))]
        on = np.flatnonzero(low != np.arange(len(fp)))
        for i in range(0, len(on), 100_000):
            yield frame(1, len(on[i : i + 100_000]), fp=_binary(fp[on[i : i + 100_000]]), other=_binary(fp[least[i : i + 100_000]]))

    return run


def count_vectors(values: np.ndarray, bounds: np.ndarray, groups: int) -> np.ndarray:
    """Points: shingles per group, a row a document; two bytes a coordinate where counts allow."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = doc * groups + (K.mix(values) % U64(groups)).astype(np.int64)
    points = np.bincount(place, minlength=(len(bounds) - 1) * groups).reshape(-1, groups)
    return points.astype(np.uint16 if points.max(initial=0) < 1 << 16 else np.int64)


class RTree:
    """Packed R-tree over count vectors; each box keeps the greatest count per coordinate and its sizes' range."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int) -> None:
        self.points, self.sizes = points, sizes
        self.order = self._tiled(np.arange(len(points)), leaf)
        self.levels = []
        high, low, top = points[self.order], sizes[self.order], sizes[self.order]
        while True:
            at = np.arange(0, len(high), leaf)
            high, low, top = np.maximum.reduceat(high, at), np.minimum.reduceat(low, at), np.maximum.reduceat(top, at)
            self.levels.append((high, low, top))
            if len(high) == 1:
                break
        self.leaf = leaf

    def _tiled(self, rows: np.ndarray, leaf: int) -> np.ndarray:
        """Sort-tile-recursive: slabs by size, in them by the coordinate that varies most."""
        rows = rows[np.argsort(self.sizes[rows], kind="stable")]
        slab = leaf * max(1, int(np.ceil(np.sqrt(len(rows) / leaf))))
        out = []
        for i in range(0, len(rows), slab):
            r = rows[i : i + slab]
            axis = int(np.argmax(self.points[r].var(0)))
            out.append(r[np.argsort(self.points[r, axis], kind="stable")])
        return np.concatenate(out)

    def query(self, point: np.ndarray, size: int, join: Join, wanted: np.ndarray | None = None) -> np.ndarray:
        """Rows (of those ``wanted``) whose summed minima with ``point`` reach the overlap that a link needs."""
        boxes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low, top = (x[boxes] for x in self.levels[depth])
            fits = (
                np.minimum(high, point).sum(1) >= join.needed(size, low)
            ) & (100 * top >= join.percent * size) & (100 * size >= join.percent * low)
            boxes = boxes[fits]
            below = len(self.levels[depth - 1][0]) if depth else len(self.order)
            boxes = (boxes[:, None] * self.leaf + np.arange(self.leaf)).ravel()
            boxes = boxes[boxes < below]
        rows = self.order[boxes]
        if wanted is not None:
            rows = rows[wanted[rows]]
        return rows[np.minimum(self.points[rows], point).sum(1) >= join.needed(size, self.sizes[rows])]


class Members:
    """Classes of one family (or of two tiles of it) and the links between them.

    ``side`` tells two tiles apart, whose members are compared across alone; on
    side :data:`WITHIN` all are compared.  Of two members one must ``ask``;
    ``label`` is what they are united to beforehand.
    """

    def __init__(self, one: np.ndarray, two: np.ndarray, bounds: np.ndarray, join: Join) -> None:
        self.join, self.bounds, self.n = join, bounds, np.diff(bounds)
        order = np.lexsort((two, one))
        new = np.ones(len(one), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        self.ids = np.empty(len(one), np.int64)
        self.ids[order] = np.cumsum(new) - 1
        self.mark = np.zeros(int(new.sum()), np.uint8)
        groups = 1 << int(np.clip(np.ceil(np.log2(max(2 * float(np.median(self.n)), 1))), 4, np.log2(join.groups)))
        self.points = count_vectors(one, bounds, groups)
        self.tree = RTree(self.points, self.n, join.leaf)

    def overlap(self, x: int, others: np.ndarray) -> np.ndarray:
        """Shingles that x shares with each of the others, exactly."""
        own = self.ids[self.bounds[x] : self.bounds[x + 1]]
        self.mark[own] = 1
        out = np.empty(len(others), np.int64)
        many, at = np.cumsum(self.n[others]), 0
        while at < len(others):  # some millions of shingles at a time
            to = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + (1 << 21), "right")))
            part = others[at:to]
            held = self.mark[self.ids[R.ragged(self.bounds[part], self.n[part])]]
            out[at:to] = np.add.reduceat(held, np.cumsum(self.n[part]) - self.n[part], dtype=np.int64)
            at = to
        self.mark[own] = 0
        return out

    def link(self, side: np.ndarray, asks: np.ndarray, label: np.ndarray, copies: np.ndarray, count: bool) -> tuple[np.ndarray, np.ndarray]:
        """Labels after all links, and the number of rows that each class links with."""
        label, links = label.copy(), np.zeros(len(self.n), np.int64)
        left = len(np.unique(label))
        place = np.empty(len(self.n), np.int64)
        place[self.tree.order] = np.arange(len(self.n))
        for x in self.tree.order.tolist():
            if not count and left == 1:
                break
            wanted = place > place[x]
            if side[x] != WITHIN:
                wanted &= side != side[x]
            if not asks[x]:
                wanted &= asks
            if not count:
                wanted &= label != label[x]
            if not wanted.any():
                continue
            near = self.tree.query(self.points[x], int(self.n[x]), self.join, wanted)
            if not len(near):
                continue
            near = near[self.overlap(x, near) >= self.join.needed(int(self.n[x]), self.n[near])]
            links[x] += copies[near].sum()
            links[near] += copies[x]
            for other in np.unique(label[near]).tolist():
                if other != label[x]:
                    label[label == other] = label[x]
                    left -= 1
        return label, links


_UNIT = "unit string, fp binary, copies long, side int, asks boolean, label binary"
_LINKED = "unit string, fp binary, root binary, links long"


def _resolver(join: Join, count: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by unit, with texts, to the least class that each is united with and its number of links."""

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        unit = t["unit"].combine_chunks().dictionary_encode()
        names, unit = unit.dictionary.to_pylist(), unit.indices.to_numpy().astype(np.int64)
        fp = np.frombuffer(b"".join(t["fp"].to_pylist()), U64).reshape(-1, 2)
        order = np.lexsort((fp[:, 1], fp[:, 0], unit))
        again = np.zeros(len(order), bool)
        again[1:] = (unit[order][1:] == unit[order][:-1]) & (fp[order][1:] == fp[order][:-1]).all(1)
        rows = order[~again]
        t, unit, fp = t.take(pa.array(rows)), unit[rows], fp[rows]
        sets = [shingle_sets(c, join) for c in K.chunks(t["text"])]
        one, two = (np.concatenate([s[i] for s in sets]) for i in (0, 1))
        bounds = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(s[2]) for s in sets]))))
        # a text that another class's key led to by chance is none of this class
        own = (np.concatenate([fingerprints(*s) for s in sets]) == fp).all(1)
        copies, side, asks = t["copies"].to_numpy(), t["side"].to_numpy(), t["asks"].combine_chunks().to_numpy(zero_copy_only=False)
        label = t["label"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        edge = np.append(np.flatnonzero(np.diff(unit, prepend=-1)), len(unit))
        root, links = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            r = a + np.flatnonzero(own[a:b])
            if len(r) < 2:
                continue
            index = R.ragged(bounds[r], np.diff(bounds)[r])
            family = Members(one[index], two[index], np.concatenate(([0], np.cumsum(np.diff(bounds)[r]))), join)
            got, links[r] = family.link(side[r], asks[r], label[r], copies[r], count)
            _, first, back = np.unique(got, return_index=True, return_inverse=True)
            root[r] = r[first][back]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()).take(pa.array(unit)), _binary(fp), _binary(fp[root]), pa.array(links)], ["unit", "fp", "root", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            unit = t["unit"].combine_chunks().dictionary_encode().indices.to_numpy()
            last = int(np.flatnonzero(np.diff(unit, prepend=-1))[-1])  # the last unit may go on in the next batch
            if last:
                yield from settle(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None:
            yield from settle(rest)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated rows of a class's holder go before they are shuffled again."""
    seen: set[bytes] = set()
    for batch in batches:
        on = []
        for fp in batch.column("fp").to_pylist():
            on.append(fp not in seen)
            seen.add(fp)
        yield batch.filter(pa.array(on, pa.bool_()))
        if len(seen) > 1_000_000:
            seen.clear()


def _resolved(texts: DataFrame, units: DataFrame, join: Join, count: bool) -> DataFrame:
    """``units``: (doc_id, key, fp, copies, places: array of (unit, side, asks), label); see :class:`Members`."""
    # merged at every size: the wanted rows grow with the texts, so a broadcast would hold for small tables alone
    found = texts.join(units.hint("merge"), ["doc_id", "key"]).select("fp", "copies", "places", "label", "text")
    once = found.mapInArrow(_once, found.schema)
    rows = once.select(F.explode("places").alias("p"), "fp", "copies", "label", "text").select(
        "p.unit", "fp", "copies", "p.side", "p.asks", "label", "text",
    )
    n = buckets(texts.sparkSession)
    return rows.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(_resolver(join, count), _LINKED)


def _place(unit, side, asks):
    return F.struct(unit.alias("unit"), side.cast("int").alias("side"), asks.alias("asks"))


def links(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key, n, fp), and (fp, root, links) of all classes that may link: equal roots are one component."""
    spark, texts = docs.sparkSession, R.keyed(docs)
    size = text_bytes(texts)
    n = buckets(spark, size)
    bits, levels = rarity(texts, size, join)
    sent = spark.sparkContext.broadcast(levels)  # 2**bits / 2 bytes, bounded by Join.most_bits
    found = written(dealt(texts.mapInArrow(_pass(join, bits, sent, n), _PASS), n).mapInArrow(_cells(join), _FOUND), "classes")
    rows = found.filter("kind = 0").select("doc_id", "key", "n", "fp")
    families = components(found.filter("kind = 1").select("fp", "other"), "fp", "other").select(
        F.col("node").alias("fp"), F.col("component").alias("family"),
    )
    # counted before they are joined, so that a class of very many copies is a row a task
    counted = rows.filter("n > 0").groupBy("fp").agg(
        F.min(F.struct("doc_id", "key")).alias("at"), F.count("*").alias("copies"), F.max("n").alias("n"),
    )
    classes = written(counted.join(families, "fp").select("fp", "family", "at.doc_id", "at.key", "copies", "n"), "families")
    weight = F.greatest("n", F.lit(_LEAST_WEIGHT))
    large = classes.groupBy("family").agg(F.sum(weight).alias("weight"), F.min("fp").alias("pivot")).filter(F.col("weight") > join.tile)
    large = written(large.select("family", "pivot", F.ceil(F.col("weight") / join.tile).cast("int").alias("tiles")), "large")
    whole = F.array(_place(F.hex("family"), F.lit(WITHIN), F.lit(True)))
    if large.isEmpty():
        done = _resolved(texts, classes.withColumn("places", whole).withColumn("label", F.col("fp")), join, join.count_links)
        return rows, written(done.select("fp", "root", "links"), "linked")
    marked = classes.join(large, "family", "left").withColumn(
        "tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"),
    ).withColumn("label", F.col("fp"))
    name = lambda i, j: F.concat_ws(":", F.hex("family"), i.cast("string"), j.cast("string"))
    tile, each = F.col("tile"), F.sequence(F.lit(0), F.col("tiles") - 1)
    small = F.col("tiles").isNull()
    if join.count_links:
        places = F.transform(
            each,
            lambda u: _place(name(F.least(u, tile), F.greatest(u, tile)), F.when(u == tile, WITHIN).otherwise((u < tile).cast("int")), F.lit(True)),
        )
        done = written(_resolved(texts, marked.withColumn("places", F.when(small, whole).otherwise(places)), join, True), "linked")
        return rows, _united(done)
    around = F.when(F.col("fp") == F.col("pivot"), F.transform(each, lambda u: _place(name(u, u), F.lit(WITHIN), F.lit(True)))).otherwise(
        F.array(_place(name(tile, tile), F.lit(WITHIN), F.lit(True)))
    )
    first = _united(written(_resolved(texts, marked.withColumn("places", F.when(small, whole).otherwise(around)), join, False), "linked"))
    # what is not in the largest component of its family asks all others, in blocks
    placed = written(marked.filter(~small).drop("label").join(first.select("fp", F.col("root").alias("label")), "fp"), "tiled")
    largest = placed.groupBy("family", "label").agg(F.sum(weight).alias("w")).groupBy("family").agg(
        F.max_by("label", F.struct("w", "label")).alias("top"), F.sum("w").alias("all"), F.max("w").alias("w"),
    )
    open_ = largest.filter("w < all").select("family", "top", F.ceil((F.col("all") - F.col("w")) / join.tile).cast("int").alias("blocks"))
    asking = placed.join(open_, "family").withColumn("asks", F.col("label") != F.col("top")).withColumn(
        "block", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int"),
    )
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    plain = F.transform(blocks, lambda q: _place(name(tile, q), F.lit(WITHIN), F.lit(False)))
    as_asked = F.transform(each, lambda u: _place(name(u, F.col("block")), F.lit(WITHIN), F.lit(True)))
    both = F.when(F.col("asks"), F.concat(as_asked, F.filter(plain, lambda p: p["unit"] != name(tile, F.col("block"))))).otherwise(plain)
    second = _resolved(texts, asking.withColumn("places", both), join, False)
    again = components(written(second.select("fp", "root"), "linked"), "fp", "root").select(
        F.col("node").alias("fp"), F.col("component").alias("next"),
    )
    # the second pass names classes; their first labels lead on to what they were united with
    joined = first.join(again, "fp", "left").select("root", F.coalesce("next", "fp").alias("next")).distinct()
    final = components(joined, "root", "next").select(F.col("node").alias("root"), F.col("component").alias("final"))
    return rows, first.join(final, "root").select("fp", F.col("final").alias("root"), "links")


def _united(done: DataFrame) -> DataFrame:
    """Units' outcomes put together: classes that any of them unites, and the sums of their links."""
    roots = components(done.select("fp", "root"), "fp", "root").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    return written(done.groupBy("fp").agg(F.sum("links").alias("links")).join(roots, "fp").select("fp", "root", "links"), "united")


def near_duplicates(docs: DataFrame, join: Join | None = None) -> DataFrame:
    """One row for every row of ``docs``: (doc_id, n_shingles, class_id, component_id, n_links, key).

    class_id is the least doc_id with the same set, component_id the least doc_id
    reachable by links, n_links the number of other rows linked with (null unless
    links are counted); key tells texts under one doc_id apart.
    """
    join = join or Join()
    rows, found = links(docs, join)
    classes = rows.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    inside = classes.join(found, "fp")
    least = inside.groupBy("root").agg(F.min("class_id").alias("component_id"))
    linked = inside.join(least, "root").select("fp", "component_id", "links")
    ids = classes.join(linked, "fp", "left").select(
        "fp", "class_id", F.coalesce("component_id", "class_id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    ids = written(ids, "ids")  # a table, so that the join may be split at a class of very many copies
    out = rows.join(ids, "fp", "left")
    known = lambda c: F.nullif(F.coalesce(F.col(c), F.col("doc_id")), F.lit(NO_ID))
    n_links = F.coalesce("n_links", F.lit(0)) if join.count_links else F.lit(None)
    return out.select(
        F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), known("component_id").alias("component_id"),
        known("class_id").alias("class_id"), n_links.cast("long").alias("n_links"), "key",
    )


def without_near_duplicates(docs: DataFrame, join: Join | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those linked, directly or by others, with a row of lesser (doc_id, text hash).

    Rows without words stay; rows that repeat doc_id and text are one.
    """
    join = join or Join(count_links=False)
    rows, found = links(docs, join)
    member = rows.filter("n > 0").join(found.select("fp", "root"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "doc_id", "key")
    stays = member.groupBy("root").agg(
        F.min(F.struct("doc_id", "key")).alias("first"), F.max(F.struct("doc_id", "key")).alias("last"),
    ).filter("first <> last")
    stays = written(stays.select("root", "first"), "stays")  # a table, so that the join may be split at a hot root
    gone = member.join(stays, "root").filter(F.struct("doc_id", "key") != F.col("first")).select("doc_id", "key").distinct()
    text, own = F.col("text").cast("string"), F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(own.alias("own"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("key"))
    return named.join(gone, ["doc_id", "key"], "left_anti").dropDuplicates(["doc_id", "key"]).select("own.*")
