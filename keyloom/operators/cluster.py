"""Clustering keywords: leader clustering in volume order, consolidation, naming, roll-ups."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that the cluster names; where it names none, one under the warehouse."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return df.checkpoint(eager=True)


def leaders(nodes: DataFrame, edges: DataFrame, topic: str | None = None) -> DataFrame:
    """Seeds and members of leader clustering: (id, seed, tier, score).

    ``nodes`` (id, rank) are taken in order of rank; ``edges`` (a, b, tier,
    score), a before b in rank, name the pairs that may join.  A node joins the
    earlier seed with the best (tier, score), the earliest on ties, and is a
    seed where no earlier seed may take it.  The seeds are the lexicographically
    first maximal independent set, so rounds settle all nodes whose earlier
    neighbours are settled, not one node at a time.  Each round keeps only the
    edges whose two ends are still open, and is checkpointed.

    ``topic`` names a column of a trusted parent topic: a node joins its topic's
    seed before all else (tier 3).  A topic has one seed, the first of its nodes
    that nothing else takes, so a round needs the first open node of each topic
    and no pairs inside it.
    """
    pairs = checkpointed(edges.select("a", "b", "tier", "score"))
    named = F.col(topic) if topic else F.lit(None).cast("string")
    waiting = checkpointed(nodes.select("id", "rank", named.alias("topic")))
    open_, settled = pairs.select("a", "b"), []
    while True:
        # all ends of open edges wait: a node without an earlier one is a seed, its later neighbours are members
        first = waiting.join(open_.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        if topic:
            heads = waiting.filter("topic is not null").groupBy("topic").agg(F.min_by("id", "rank").alias("id")).select("id")
            first = first.filter("topic is null").unionByName(first.join(heads, "id", "left_semi"))
        first = checkpointed(first)
        taken = open_.join(first.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
        if topic:
            own = waiting.join(first.filter("topic is not null").select("topic", F.col("id").alias("seed")), "topic").filter("id <> seed")
            taken = taken.unionByName(own.select("id"))
        taken = checkpointed(taken.distinct())
        settled.append(first.withColumn("state", F.lit(1)))
        settled.append(waiting.join(taken, "id", "left_semi").withColumn("state", F.lit(2)))
        waiting = checkpointed(waiting.join(first.select("id").unionByName(taken), "id", "left_anti"))
        if waiting.isEmpty():
            break
        # edges with a settled end say nothing more: members take nobody, seeds have spoken
        left = waiting.select("id")
        open_ = checkpointed(
            open_.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi")
        )
    state = reduce(DataFrame.unionByName, settled)
    seeds = state.filter("state = 1").select(F.col("id").alias("a"), F.col("rank").alias("seed_rank"))
    options = pairs.select("a", "b", "tier", "score")
    if topic:
        heads = state.filter("state = 1 and topic is not null").select("topic", F.col("id").alias("a"), F.col("rank").alias("r"))
        by_topic = state.filter("state = 2").join(heads, "topic").filter("r < rank")
        options = options.unionByName(by_topic.select("a", F.col("id").alias("b"), F.lit(3).alias("tier"), F.lit(1.0).alias("score")))
    best = options.join(seeds, "a").groupBy("b").agg(
        F.max_by(F.struct("a", "tier", "score"), F.struct("tier", "score", -F.col("seed_rank"))).alias("m")
    )
    members = state.filter("state = 2").join(best, state["id"] == best["b"]).select(
        "id", F.col("m.a").alias("seed"), F.col("m.tier").alias("tier"), F.col("m.score").alias("score"),
    )
    own = seeds.select(F.col("a").alias("id"), F.col("a").alias("seed"), F.lit(9).alias("tier"), F.lit(1.0).alias("score"))
    return own.unionByName(members)


def leaders_by_loop(ids: list, edges: list[tuple], topics: dict | None = None) -> dict:
    """The same by a plain loop over ids in order of rank; for tests."""
    before: dict = {}
    for a, b, tier, score in edges:
        before.setdefault(b, []).append((tier, score, a))
    place = {x: i for i, x in enumerate(ids)}
    seed: dict = {}
    of_topic: dict = {}
    for x in ids:
        t = (topics or {}).get(x)
        options = [(k, s, -place[a], a) for k, s, a in before.get(x, []) if seed.get(a) == a]
        seed[x] = of_topic[t] if t in of_topic else max(options)[3] if options else x
        if seed[x] == x and t is not None:
            of_topic[t] = x
    return seed


def consolidate(clusters: DataFrame, keys: list[str], order: list[Column], has_urls: str | None = None) -> DataFrame:
    """Clusters that ask the same question take the first one's id; those whose seed has results stay apart."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.first("cluster_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    owner = F.when(F.col(has_urls), F.col("cluster_id")).otherwise(first) if has_urls else first
    return clusters.withColumn("owner_id", owner)


def best_name(members: DataFrame, cluster: str) -> DataFrame:
    """The member that names each cluster (columns phrase, volume, typo, fluency).

    Without a year if such a member has a fifth of the top volume; without a
    typo if any; of those with half the best volume the plainest, then largest,
    then shortest; a plain member of four fifths of that volume and at most eight
    words replaces it when it reads more fluently by 0.3.
    """
    w = Window.partitionBy(cluster)
    year = F.rlike("phrase", F.lit(r"\b(19|20)[0-9]{2}\b"))
    plain = ~F.rlike("phrase", F.lit(r"[0-9]|\b(what|when|where|who|why|how|which)$"))
    words = F.size(F.split("phrase", " "))
    x = members.withColumn("_y", year).withColumn("_p", plain.cast("int")).withColumn("_n", words)
    x = x.withColumn("_top", F.max("volume").over(w)).withColumn("_free", F.max(F.when(~F.col("_y"), F.col("volume"))).over(w))
    x = x.filter(~F.col("_y") | (F.coalesce(F.col("_free"), F.lit(-1)) * 5 < F.col("_top")))
    x = x.withColumn("_clean", F.max((~F.col("typo")).cast("int")).over(w)).filter(~F.col("typo") | (F.col("_clean") == 0))
    x = x.withColumn("_best", F.max("volume").over(w))
    strong = F.col("volume") * 2 >= F.col("_best")
    key = F.struct(F.col("_p"), F.col("volume"), -F.length("phrase"), F.col("phrase"))
    x = x.withColumn("_seed", F.max(F.when(strong, F.struct(key.alias("k"), "phrase", "volume", "fluency", F.col("_p").alias("p")))).over(w))
    band = strong & (F.col("_p") == 1) & (F.col("volume") * 5 >= F.col("_seed.volume") * 4) & (F.col("_n") <= 8) & (
        F.col("fluency") >= F.col("_seed.fluency") + 0.3
    )
    agg = x.groupBy(cluster).agg(
        F.first("_seed").alias("s"), F.max(F.when(band, F.struct("fluency", "volume", -F.length("phrase"), "phrase"))).alias("b"),
    )
    return agg.select(cluster, F.when((F.col("s.p") == 1) & F.col("b").isNotNull(), F.col("b.phrase")).otherwise(F.col("s.phrase")).alias("name"))


def cluster_ids(clusters: DataFrame, volume: str, name: str, shards: int = 64) -> DataFrame:
    """``C0001``.. in order of falling volume and name.

    Global ranks without one task for all rows: rows are cut into ranges by a
    sort, numbered inside, and shifted by the ranges' counts.
    """
    return global_rank(clusters, [F.desc(volume), F.asc(name)], "_rank").withColumn("cluster_id", F.format_string("C%04d", "_rank")).drop("_rank")


def global_rank(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """1.. in the given total order: range partitions, numbered each and shifted by what stands before."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = checkpointed(parts.withColumn("_at", F.monotonically_increasing_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("_part", "_first", before.alias("_before"))
    return parts.join(F.broadcast(shift), "_part").withColumn(
        out, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long"),
    ).drop("_part", "_at", "_first", "_before")


def bucket(rank: Column, n: Column) -> Column:
    """A, B or C by the share of the rank among all."""
    return F.when(rank <= n * 0.2, "A").when(rank <= n * 0.5, "B").otherwise("C")


def roll_up(rows: DataFrame, dims: list[str], cluster: str, keywords: str, volume: str, name: str, top: int = 5) -> DataFrame:
    """Groups of clusters: counts, volume, share in percent to one decimal, names of the greatest ones.

    The greatest names are kept by rank inside each group, so no group is
    collected whole.
    """
    filled = rows.select(*[F.coalesce(F.nullif(F.col(d), F.lit("")), F.lit("(none)")).alias(d) for d in dims], cluster, keywords, volume, name)
    # an aggregate first; the share's total is that of one row a group
    groups = filled.groupBy(*dims).agg(F.countDistinct(cluster).alias("clusters"), F.sum(keywords).alias("keywords"), F.sum(volume).alias("volume"))
    total = groups.agg(F.sum("volume").alias("_total"))
    rank = F.row_number().over(Window.partitionBy(*dims).orderBy(F.desc(volume), name))
    best = filled.withColumn("_r", rank).filter(F.col("_r") <= top).groupBy(*dims).agg(F.array_sort(F.collect_list(F.struct("_r", name))).alias("_t"))
    joined = groups.join(best, dims).crossJoin(F.broadcast(total))
    share = F.when(F.col("_total") > 0, F.bround(F.col("volume") * 100.0 / F.col("_total"), 1)).otherwise(0.0)
    return joined.select(
        *dims, "clusters", "keywords", "volume", share.alias("volume_share_pct"),
        F.array_join(F.transform("_t", lambda t: t[name]), " | ").alias("top_clusters"),
    )


def label_mix(rows: DataFrame, cluster: str, label: str, volume: str) -> DataFrame:
    """Counts and volumes of a label inside each cluster, largest first, rows without a label last."""
    named = F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit("no label"))
    each = rows.withColumn("_l", named).groupBy(cluster, "_l").agg(F.count("*").alias("n"), F.sum(volume).alias("v"))
    order = F.struct((F.col("_l") == "no label").cast("int"), -F.col("v"), "_l", "n", "v")
    listed = each.groupBy(cluster).agg(F.array_sort(F.collect_list(order.alias("x"))).alias("x"))
    text = F.transform("x", lambda t: F.concat(t["_l"], F.lit(" "), t["n"].cast("string"), F.lit(" ("), t["v"].cast("string"), F.lit(")")))
    return listed.select(cluster, F.array_join(text, "; ").alias("mix"))


def reach(points: DataFrame, kd: str, position: str, least: int = 20) -> DataFrame:
    """Difficulty that a site already wins: the value at index int(0.75 n) of the sorted difficulties in the top ten.

    Difficulties are whole or rounded figures, so they are counted by value
    first; the running count over values is small however many rows there are.
    """
    counted = points.filter(
        F.col(kd).isNotNull() & (F.col(position) > 0) & (F.col(position) <= 10)
    ).groupBy(F.col(kd).alias("v")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.orderBy("v"))).crossJoin(F.broadcast(total))
    index = F.least(F.col("total") - 1, F.floor(F.col("total") * 0.75)) + 1
    return upto.filter((F.col("total") >= least) & (F.col("upto") >= index)).agg(F.min("v").alias("reach"), F.max("total").alias("measured"))


def staged_groups(rows: DataFrame, row_id: str, stages: list[tuple[str, list[str]]], least: int) -> DataFrame:
    """(id, stage, group_key): each stage takes the groups of enough members; all others fall through to the next."""
    left, taken = rows, []
    for name, keys in stages:
        named = left.filter(F.forall(F.array(*[F.coalesce(F.col(k), F.lit("")) for k in keys]), lambda x: x != ""))
        groups = named.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
        got = named.join(groups, keys, "left_semi").select(row_id, F.lit(name).alias("stage"), F.concat_ws("|", *keys).alias("group_key"))
        taken.append(got)
        left = left.join(got.select(row_id), row_id, "left_anti")
    taken.append(left.select(row_id, F.lit("rest").alias("stage"), F.lit("").alias("group_key")))
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def split_by_theme(
    rows: DataFrame, group: str, theme: str, volume: str, max_size: int, least: int, max_sub: int, floor: int = 500, share: float = 0.02,
) -> DataFrame:
    """(group, theme, placed): large groups are split by their strongest themes; the rest is standalone or backlog."""
    themes = rows.groupBy(group, theme).agg(F.count("*").alias("n"), F.sum(volume).alias("v"))
    w, ordered = Window.partitionBy(group), Window.partitionBy(group).orderBy(F.desc("v"), theme)
    x = themes.withColumn("size", F.sum("n").over(w)).withColumn(
        "rest", F.sum("v").over(w) - F.max("v").over(w),
    ).withColumn("k", F.row_number().over(ordered))
    fit = (F.col("n") >= least) & ((F.col("k") == 1) | (F.col("v") >= F.greatest(F.lit(floor), F.col("rest") * share)))
    x = x.withColumn("fit", fit).withColumn(
        "sub", F.sum(F.col("fit").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    placed = F.when(F.col("size") <= max_size, "whole").when(F.col("fit") & (F.col("sub") <= max_sub), "pillar").when(
        F.col("v") >= F.greatest(F.lit(floor), F.col("rest") * share), "standalone",
    ).otherwise("backlog")
    return x.select(group, theme, F.col("n").alias("members"), F.col("v").alias("volume"), placed.alias("placed"))


def core_names(tokens: Column, weak: list[str]) -> Column:
    """Core words: the set of words that are not weak."""
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: ~t.isin(*weak)))) if weak else F.array_sort(F.array_distinct(tokens))


def winnable_volume(rows: DataFrame, keys: list[str], volume: str, kd: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.bround(F.sum(N.winnable(F.col(volume), F.col(kd))), 3).alias("winnable"))
