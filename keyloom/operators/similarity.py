"""Similarity joins on word sets, shared results and word counts; exact, by inverted indexes.

A word that a third of all rows hold gives its index entry that many rows.  The
prefix filter therefore takes the rarest words of each row; adaptive execution
splits what is left of a hot entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from ..functions import numbers as N
from .cluster import checkpointed


def document_frequency(rows: DataFrame, words: str, keys: list[str]) -> DataFrame:
    """In how many rows each word occurs, within ``keys``."""
    return rows.select(*keys, F.explode(F.array_distinct(words)).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("df"))


def prefixes(rows: DataFrame, row_id: str, words: str, keys: list[str], least: float, weak: list[str]) -> DataFrame:
    """Index entries (row id, keys, word, seen, rest, total, ids, set) of each row: its rarest words.

    Words are ordered by frequency; a prefix ends where the weight of what
    follows can no longer reach ``least`` of the whole, so two rows at ``least``
    share a prefix word.  ``seen`` names the words before, ``rest`` is the weight
    from the word on; ``ids`` are the set's words as numbers, ``set`` itself
    travels along so that no second join is needed.
    """
    distinct = rows.select(row_id, *keys, F.array_compact(F.array_distinct(words)).alias("set"))
    df = document_frequency(rows, words, keys)
    listed = distinct.select(row_id, *keys, F.explode("set").alias("word")).join(df, [*keys, "word"])
    weight = F.when(F.col("word").isin(*weak), 3).otherwise(10) if weak else F.lit(10)
    entry = F.struct("df", "word", weight.alias("w"), F.xxhash64("word").alias("id"))
    ordered = listed.groupBy(row_id, *keys).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    total = F.aggregate("e", F.lit(0), lambda t, x: t + x["w"])
    before = F.aggregate(
        "e", F.array().cast("array<int>"), lambda t, x: F.concat(t, F.array(F.coalesce(F.try_element_at(t, F.lit(-1)), F.lit(0)) + x["w"])),
    )
    x = ordered.withColumn("total", total).withColumn("upto", before).withColumn("ids", F.transform("e", lambda v: v["id"]))
    places = F.transform(
        "e", lambda v, i: F.struct(
            v["word"].alias("word"), (F.col("total") - F.element_at("upto", i + 1) + v["w"]).alias("rest"), F.slice("ids", F.lit(1), i).alias("seen"),
        ),
    )
    kept = F.filter(places, lambda v: v["rest"] >= F.col("total") * F.lit(least) - 1e-9)
    return x.select(row_id, *keys, "total", "ids", F.transform("e", lambda v: v["word"]).alias("set"), F.explode(kept).alias("p")).select(
        row_id, *keys, "p.word", "p.seen", "p.rest", "total", "ids", "set",
    )


def similar_pairs(
    rows: DataFrame, row_id: str, words: str, keys: list[str], least: float, weak: list[str] | None = None, below: float | None = None,
) -> DataFrame:
    """Pairs (keys, a, b, similarity), a < b, of rows with equal ``keys`` and weighted Jaccard in [least, below).

    A pair is made at its first shared word alone, in the order of frequency, so
    pairs need no ``distinct``; what either row has from there on bounds its
    overlap.  Survivors are scored in the join itself, by their words' hashes
    first and, where those reach ``least``, by the words.
    """
    weak = weak or []
    index = prefixes(rows, row_id, words, keys, least, weak)
    side = lambda i: index.select(*keys, "word", F.col(row_id).alias(i), *[F.col(c).alias(c + i) for c in ("seen", "rest", "total", "ids", "set")])
    both = side("a").join(side("b"), [*keys, "word"]).filter("a < b")
    both = both.filter(F.least("resta", "restb") * (1 + least) >= (F.col("totala") + F.col("totalb")) * least - 1e-6)
    both = both.filter(~F.arrays_overlap("seena", "seenb"))
    shared = F.size(F.array_intersect("idsa", "idsb")) * 10  # what they share weighs no more than this
    both = both.filter(shared * (1 + least) >= (F.col("totala") + F.col("totalb")) * least - 1e-6)
    scored = both.select(
        *keys, "a", "b", N.weighted_jaccard(F.col("seta"), F.col("setb"), weak).alias("similarity"),
    ).filter(F.col("similarity") >= least)
    if below is not None:
        scored = scored.filter(F.col("similarity") < below)
    return scored


def overlap_pairs(items: DataFrame, row_id: str, item: str, least: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs (a, b, shared), a < b, of rows that share at least ``least`` distinct items."""
    keys = keys or []
    once = items.select(row_id, item, *keys).distinct()
    pairs = once.withColumnRenamed(row_id, "a").join(once.withColumnRenamed(row_id, "b"), [*keys, item]).filter("a < b")
    return pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def keep_apart(rows: DataFrame, row_id: str, words: str, keys: list[str], items: DataFrame, item: str, least: int, close: float = 0.6) -> DataFrame:
    """Pairs with close words whose results differ: both have items, fewer than ``least`` shared (none counts).

    Shared items are counted for the close pairs alone, not for all that meet in some item.
    """
    held = items.select(row_id, item).distinct()
    with_items = rows.join(held.select(row_id).distinct(), row_id, "left_semi")
    near = similar_pairs(with_items, row_id, words, keys, close)
    common = near.select("a", "b").join(held.withColumnRenamed(row_id, "a"), "a").join(held.withColumnRenamed(row_id, "b"), ["b", item])
    shared = common.groupBy("a", "b").agg(F.count("*").alias("shared"))
    return near.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0))).filter(F.col("shared") < least)


def cosine_pairs(bags: DataFrame, row_id: str, word: str, count: str, keys: list[str], least: float) -> DataFrame:
    """All pairs (a, b, cosine) of rows of equal ``keys`` that share a word, both ways; for small groups, as rows grow with the pairs."""
    norm = bags.groupBy(row_id).agg(F.sqrt(F.sum(F.col(count) * F.col(count))).alias("norm"))
    a = bags.select(F.col(row_id).alias("a"), *keys, word, F.col(count).alias("x"))
    b = bags.select(F.col(row_id).alias("b"), *keys, word, F.col(count).alias("y"))
    # each pair once, then both ways
    dots = a.join(b, [*keys, word]).filter("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dots.join(norm.select(F.col(row_id).alias("a"), F.col("norm").alias("na")), "a").join(
        norm.select(F.col(row_id).alias("b"), F.col("norm").alias("nb")), "b",
    )
    cosine = scored.select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 9).alias("cosine")).filter(F.col("cosine") >= least)
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return cosine.select(ways.alias("p"), "cosine").select("p.a", "p.b", "cosine")


#: Bags of a block, and words in them, at most about so many; rows scored at a time.
BLOCK, BLOCK_WORDS, SLICE = 8192, 1 << 22, 256


def _bags(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """(ids, row numbers, counts, words) of a table (id, vec), ids ascending."""
    vec = table.column("vec").combine_chunks()
    flat = vec.flatten()
    size = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
    return table.column("id").combine_chunks(), np.repeat(np.arange(len(vec)), size), flat.field("n").to_numpy(zero_copy_only=False), flat.field("word")


def block_top(left: pa.Table, right: pa.Table, least: float, k: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """For each bag (id, vec: list of word, n) of ``left`` its first ``k`` of ``right``: by cosine of nine digits, falling, then by place.

    Words that a quarter of both sides hold are multiplied as matrices, the
    others are added by the lists of rows that hold them.
    """
    (ids, i, x, u), (others, j, y, v) = _bags(left), _bags(right)
    code = pa.concat_arrays([u, v]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    n, m, total = len(ids), len(others), int(code.max(initial=-1)) + 1
    na, nb = np.sqrt(np.bincount(i, x * x, n)), np.sqrt(np.bincount(j, y * y, m))
    p, q = code[: len(i)], code[len(i) :]
    i, x, p, j, y, q = i[p >= 0], x[p >= 0], p[p >= 0], j[q >= 0], y[q >= 0], q[q >= 0]
    dense = (np.bincount(p, minlength=total) * 4 >= n) & (np.bincount(q, minlength=total) * 4 >= m)
    at = np.cumsum(dense) - 1
    a, b = np.zeros((n, int(dense.sum()))), np.zeros((int(dense.sum()), m))
    np.add.at(a, (i[dense[p]], at[p[dense[p]]]), x[dense[p]])
    np.add.at(b, (at[q[dense[q]]], j[dense[q]]), y[dense[q]])
    i, x, p, j, y, q = i[~dense[p]], x[~dense[p]], p[~dense[p]], j[~dense[q]], y[~dense[q]], q[~dense[q]]
    order = np.argsort(q, kind="stable")
    j, y, cut, rows = j[order], y[order], np.searchsorted(q[order], np.arange(total + 1)), np.searchsorted(i, np.arange(n + 1))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, n, SLICE):
        dot = a[s : s + SLICE] @ b
        for e in range(rows[s], rows[min(s + SLICE, n)]):
            c, d = cut[p[e]], cut[p[e] + 1]
            np.add.at(dot[i[e] - s], j[c:d], x[e] * y[c:d])
        with np.errstate(invalid="ignore", divide="ignore"):
            score = dot / (na[s : s + SLICE, None] * nb[None, :]) * 1e9
        whole = np.trunc(score)
        whole += score - whole >= 0.5
        whole[~((whole / 1e9 >= least) & (dot != 0))] = -1
        for _ in range(min(k, m)):
            best = whole.argmax(1)
            value = whole[np.arange(len(best)), best]
            on = np.flatnonzero(value >= 0)
            if not len(on):
                break
            found.append((on + s, best[on], value[on] / 1e9))
            whole[on, best[on]] = -1
    r, c, value = (np.concatenate([f[t] for f in found]) if found else np.zeros(0, np.int64) for t in range(3))
    return ids.take(pa.array(r)), others.take(pa.array(c)), value


def cosine_top(bags: DataFrame, row_id: str, word: str, count: str, keys: list[str], least: float, k: int) -> DataFrame:
    """For each row its ``k`` most similar others (other, cosine) of equal ``keys``; ties by id.  ``least`` is above 0, counts are positive.

    A row has one bag, with a word once.  Equal bags are one class, which stands
    under its least id and keeps its first k + 1 ids.  Classes go in blocks; a
    task multiplies two blocks and hands on the first k + 1 classes of each,
    so what moves grows with the classes times the blocks, and no pair is a row.
    """
    entry = F.struct(F.col(word).alias("word"), F.coalesce(F.col(count).cast("double"), F.lit(0.0)).alias("n"))
    asked = bags.dropna(subset=[row_id, *keys]).groupBy(F.col(row_id).alias("id"), *keys).agg(F.array_sort(F.collect_list(entry)).alias("vec"))
    rows = checkpointed(asked)
    first = F.row_number().over(Window.partitionBy(*keys, "vec").orderBy("id"))
    classes = checkpointed(
        rows.withColumn("_k", first).filter(F.col("_k") <= k + 1).groupBy(*keys, "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0])
    )
    sizes = classes.groupBy(*keys).agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.size("vec")) / BLOCK_WORDS)).cast("int").alias("blocks"),
    )
    placed = classes.join(sizes, keys).select(*keys, "blocks", F.expr("cast(pmod(xxhash64(id), blocks) as int)").alias("block"), "id", "vec")
    kept = [bags.schema[c] for c in keys]
    own = bags.schema[row_id].dataType

    def pack(table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        part = table.select(["id", "vec"]).sort_by("id").combine_chunks()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(part)
        return table.select([*keys, "blocks", "block"]).slice(0, 1).append_column("bags", pa.array([sink.getvalue().to_pybytes()], pa.binary()))

    packed = placed.groupBy(*keys, "block").applyInArrow(
        pack, StructType([*kept, StructField("blocks", IntegerType()), StructField("block", IntegerType()), StructField("bags", BinaryType())]),
    )
    packed = checkpointed(packed)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sides = packed.select(*keys, F.col("block").alias("one"), every, F.lit(0).alias("side"), "bags").unionByName(
        packed.select(*keys, F.col("block").alias("other"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("one"), F.lit(1).alias("side"), "bags")
    )

    def score(table: pa.Table) -> pa.Table:
        held = dict(zip(table.column("side").to_pylist(), table.column("bags").to_pylist()))
        a, b, cosine = block_top(*(pa.ipc.open_stream(held[i]).read_all() for i in (0, 1)), least, k + 1)
        same = [pa.repeat(table.column(c)[0], len(a)) for c in keys]
        return pa.Table.from_arrays([*same, a, b, pa.array(cosine, pa.float64())], names=[*keys, "a", "b", "cosine"])

    near = sides.groupBy(*keys, "one", "other").applyInArrow(
        score, StructType([*kept, StructField("a", own), StructField("b", own), StructField("cosine", DoubleType())]),
    )
    ahead = F.row_number().over(Window.partitionBy(*keys, "a").orderBy(F.desc("cosine"), "b"))
    near = near.withColumn("_k", ahead).filter(F.col("_k") <= k + 1).join(classes.select(*keys, F.col("id").alias("b"), "ids"), [*keys, "b"])
    lists = near.select(*keys, F.col("a").alias("class"), "cosine", F.explode("ids").alias("b")).groupBy(*keys, "class").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("minus"), "b"))), 1, k + 1).alias("near"),
    )
    named = rows.join(classes.select(*keys, "vec", F.col("id").alias("class")), [*keys, "vec"]).select(F.col("id").alias("a"), *keys, "class")
    others = F.slice(F.filter("near", lambda x: x["b"] != F.col("a")), 1, k)
    return named.join(lists, [*keys, "class"]).select("a", F.posexplode(others).alias("at", "x")).select(
        "a", F.col("x.b").alias("b"), (-F.col("x.minus")).alias("cosine"), (F.col("at") + 1).alias("rank"),
    )


def nearest(left: DataFrame, left_id: str, right: DataFrame, right_id: str, words: str, keys: list[str]) -> DataFrame:
    """For each left row the right row that shares most words (the least id on ties); none without a shared word."""
    a = left.select(F.col(left_id).alias("a"), *keys, F.explode(F.array_distinct(words)).alias("word"))
    b = right.select(F.col(right_id).alias("b"), *keys, F.explode(F.array_distinct(words)).alias("word"))
    shared = a.join(b, [*keys, "word"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return shared.groupBy("a").agg(F.min_by("b", F.struct(-F.col("shared"), "b")).alias("b"), F.max("shared").alias("shared"))


def near_spellings(words: DataFrame, word: str, df: str, keys: list[str] | None = None) -> DataFrame:
    """Pairs of words one deletion apart on either side: the candidates for a typo, by deletion neighbourhoods."""
    keys = keys or []
    text = F.col(word)
    cuts = F.transform(
        F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))),
    )
    index = words.select(*keys, word, df, F.explode(F.array_distinct(F.concat(F.array(text), cuts))).alias("cut"))
    left = index.select(*keys, F.col(word).alias("rare"), F.col(df).alias("rare_df"), "cut")
    right = index.select(*keys, F.col(word).alias("common"), F.col(df).alias("common_df"), "cut")
    return left.join(right, [*keys, "cut"]).filter("rare <> common").select(*keys, "rare", "rare_df", "common", "common_df").distinct()


def shared_order(a: Column, b: Column) -> Column:
    """Whether the words that both lists hold come in the same order."""
    inter = F.array_intersect(a, b)
    return F.filter(a, lambda x: F.array_contains(inter, x)) == F.filter(b, lambda x: F.array_contains(inter, x))
