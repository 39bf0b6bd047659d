"""Sharding by rendezvous hashing of a stable record key over weighted shards.

Each shard's score for a key is ``-weight / ln(u)`` with ``u`` a hash of key and
shard in (0, 1); the greatest score wins.  A further shard changes only the rows
it wins, about its share of the weight.  Scores are column expressions: no rows
move to choose a shard.

Slots within a shard are gapless.  Rows are numbered inside (shard, block), the
block being a hash of the row, and a table of shards x blocks counts, whose size
doesn't depend on the data, gives each block its first slot.

Only DataFrame functions are used.

Nulls and edge cases: a null key is a key of its own (the empty one); a null
text has size ``overhead`` and the checksum of no bytes; repeated rows share a
shard and take slots of their own; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(key: Column, shard: int) -> Column:
    """A number in (0, 1) from 52 bits of MD5 over ``key:shard``."""
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The winning shard of a key; on equal scores the greater number."""
    scores = [F.struct((F.lit(-float(w)) / F.log(unit_hash(key, s))).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_max(F.array(*scores))["shard"]


def shard(docs: DataFrame, weights: list[float], grown: float | None = 1.0, blocks: int = 4096, overhead: int = 8) -> DataFrame:
    """doc_id, size, checksum, shard, slot, and the shard with one more of weight ``grown``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.select("*", rendezvous(key, weights).alias("shard"))
    if grown is not None:
        # the old winner against the new shard alone: all other scores are what they were
        old = F.element_at(F.array(*[F.lit(-float(w)) / F.log(unit_hash(key, s)) for s, w in enumerate(weights)]), F.col("shard") + 1)
        new = F.lit(-float(grown)) / F.log(unit_hash(key, len(weights)))
        rows = rows.withColumn("grown_shard", F.when(new >= old, F.lit(len(weights))).otherwise(F.col("shard")))
    else:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = rows.withColumn(
        "block",
        F.pmod(F.conv(F.substring(F.md5(F.concat(key, F.lit("#"), F.col("text_crc32"))), 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int"),
    )
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))  # shards x blocks rows at most
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("place", inside)
    placed = numbered.join(F.broadcast(first) if len(weights) * blocks <= 200_000 else first, ["shard", "block"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int"), (F.col("first") + F.col("place") - 1).cast("long").alias("slot"),
        F.col("grown_shard").cast("int"),
    )
