"""Connected components of an edge table, in DataFrame operations alone.

Every node points at a node of its component; in each round a node's pointer
and its parent's pointer are lowered to the least grandparent among its
neighbours, and pointers skip a generation (the FastSV scheme of Zhang, Azad
and Hu, 2020).  Rounds grow with the logarithm of the longest path.  Each round
is written to the checkpoint folder, so lineage stays short and a lost executor
costs a reread.  A hub costs one pre-aggregated row a task in the aggregations,
and adaptive execution splits it in the joins.

Nulls and edge cases: edges with a null end are ignored; repeated edges and
loops change nothing; no edges give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component is the least node reachable."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    both = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    parent = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("up")))
    while True:
        grand = parent.join(parent.select(F.col("node").alias("up"), F.col("up").alias("gp")), "up")
        least = both.join(grand.select(F.col("node").alias("v"), F.col("gp").alias("gv")), "v").groupBy("u").agg(F.min("gv").alias("low"))
        seen = grand.join(least, grand["node"] == least["u"], "left").select("node", "up", "gp", F.coalesce("low", "gp").alias("low"))
        own, above = F.struct("node", F.least("up", "gp", "low").alias("new"), F.col("up").alias("was")), F.struct(
            F.col("up").alias("node"), F.least("gp", "low").alias("new"), F.lit(None).alias("was"),
        )
        lowered = seen.select(F.explode(F.array(own, above)).alias("x")).select("x.*")
        after = cut(lowered.groupBy("node").agg(F.min("new").alias("up"), F.max("was").alias("was")))
        changed = not after.filter("up <> was").isEmpty()
        parent = after.select("node", "up")
        if not changed:
            return parent.select("node", F.col("up").alias("component"))
