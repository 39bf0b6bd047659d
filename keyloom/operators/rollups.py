"""Reports over clusters and plans: coverage, labels, spelling fixes, duplicates across pillars, carried plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T


def coverage(rows: DataFrame) -> DataFrame:
    """One row: keywords and volume with results, difficulty, parent, trend (columns urls, kd, parent, trend, volume)."""
    checks = {
        "results": F.size(F.coalesce("urls", F.array().cast("array<string>"))) > 0, "difficulty": F.col("kd").isNotNull(),
        "parent": F.coalesce("parent", F.lit("")) != "", "trend": F.size(F.coalesce("trend", F.array().cast("array<double>"))) > 0,
    }
    aggs = [x for name, hit in checks.items() for x in (F.count_if(hit).alias(f"{name}_keywords"), F.sum(F.when(hit, F.col("volume")).otherwise(0)).alias(f"{name}_volume"))]
    return rows.agg(*aggs)


def grouping_basis(members: DataFrame, cluster: str) -> DataFrame:
    """Why a cluster is one: a decision, a given group, a single keyword, one kind of evidence, or mixed."""
    kind = F.regexp_extract("joined", "^([a-z]+)", 1)
    x = members.groupBy(cluster).agg(
        F.max(F.size(F.coalesce("decision_ids", F.array().cast("array<string>"))) > 0).alias("d"),
        F.max(F.coalesce("group", F.lit("")) != "").alias("p"), F.count("*").alias("n"), F.collect_set(F.when(kind != "seed", kind)).alias("k"),
    )
    basis = F.when(F.col("d"), "decision").when(F.col("p"), "group").when(F.col("n") == 1, "single").when(F.size("k") == 1, F.element_at("k", 1)).otherwise("mixed")
    return x.select(cluster, basis.alias("basis"))


def verified_share(members: DataFrame, cluster: str) -> DataFrame:
    """Share of a cluster's volume that joined by shared results; the seed counts where any member did."""
    serp = F.startswith("joined", F.lit("serp"))
    w = Window.partitionBy(cluster)
    x = members.withColumn("_any", F.max(serp.cast("int")).over(w)).withColumn("_v", serp | ((F.col("joined") == "seed") & (F.col("_any") == 1)))
    return x.groupBy(cluster).agg(
        F.when(
            F.sum("volume") > 0, F.round(F.sum(F.when(F.col("_v"), F.col("volume")).otherwise(0)) / F.sum("volume"), 4),
        ).otherwise(0.0).alias("verified")
    )


def excluded_counts(excluded: DataFrame) -> DataFrame:
    return excluded.groupBy("reason").agg(F.count("*").alias("keywords"), F.sum("volume").alias("volume"))


def fix_rows(fixes: DataFrame, changed: DataFrame, words: str, volume: str) -> DataFrame:
    """Per fix: keywords changed, the first three, and the volumes of wrong and right word."""
    each = changed.select(F.explode(F.array_distinct(words)).alias("word"), F.col(volume).alias("v"), F.array_join(words, " ").alias("k"))
    hit = each.join(fixes, each["word"] == fixes["wrong"])
    first = hit.groupBy("wrong", "right").agg(F.count("*").alias("keywords"), F.sum("v").alias("from_volume"))
    rank = F.row_number().over(Window.partitionBy("wrong").orderBy(F.desc("v"), "k"))
    examples = hit.withColumn("_r", rank).filter("_r <= 3").groupBy("wrong").agg(
        F.array_join(F.array_sort(F.collect_list("k")), " | ").alias("examples")
    )
    right = each.groupBy(F.col("word").alias("right")).agg(F.sum("v").alias("to_volume"))
    return first.join(examples, "wrong").join(right, "right", "left").na.fill(0, ["to_volume"])


def representative(members: DataFrame, node: str) -> DataFrame:
    """The member that names a node: strength is the geometric mean of winnable and owned volume, less for extra words."""
    score = F.sqrt(F.col("winnable") * F.col("volume")) / (1 + 0.5 * F.col("extra"))
    return members.groupBy(node).agg(F.max_by("id", F.struct(F.round(score, 6), "fluency", "volume", "id")).alias("representative"))


def pillar_hub(members: DataFrame, pillar: str) -> DataFrame:
    """The cluster that leads a pillar: a list need, no narrower facet, fewest extra words, most winnable volume."""
    lists = F.col("need").isin("choose", "inspire").cast("int")
    return members.groupBy(pillar).agg(F.max_by("id", F.struct(lists, -F.col("facets"), -F.col("extra"), "winnable", "id")).alias("hub"))


def promoted(members: DataFrame, pillar: str, least: int = 50, share: float = 0.15) -> DataFrame:
    """Pillars whose hub has volume enough to be a post of its own."""
    total = F.sum("volume").over(Window.partitionBy(pillar))
    return members.withColumn("_t", total).filter(F.col("is_hub") & (F.col("volume") >= least) & (F.col("volume") >= share * F.col("_t"))).drop("_t")


def across_pillars(posts: DataFrame, least: float = 0.5) -> DataFrame:
    """Posts of two pillars with the same topic and core: the one that owns more stays, if half their words agree."""
    w = Window.partitionBy("topic", "core").orderBy(F.desc("owned"), "id")
    x = posts.withColumn("_k", F.row_number().over(w)).withColumn("_first", F.first(F.struct("id", "pillar", "words")).over(w))
    drop = (F.col("_k") > 1) & (F.col("_first.pillar") != F.col("pillar")) & (N.jaccard(F.col("words"), F.col("_first.words")) >= least)
    return x.withColumn("merged_into", F.when(drop, F.col("_first.id"))).drop("_k", "_first")


def sub_hubs(posts: DataFrame, pillar: str, least: int = 3) -> DataFrame:
    """(pillar, word, hub, posts): words that several posts of a pillar share and that a post is named by alone.

    Rarer words are settled first and take their posts; sequential inside a
    pillar, whose size the plan bounds.
    """

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        names = {i: set(w) for i, w in zip(pdf["id"], pdf["words"])}
        counts: dict[str, int] = {}
        for ws in names.values():
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
        free, out = set(names), []
        for word in sorted((w for w, n in counts.items() if n >= least), key=lambda w: (counts[w], w)):
            hub = next((i for i in sorted(free) if names[i] == {word}), None)
            below = sorted(i for i in free if word in names[i] and i != hub)
            if hub is not None and len(below) + 1 >= least:
                free -= {hub, *below}
                out.append((pdf[pillar].iloc[0], word, hub, "|".join(map(str, below))))
        return pd.DataFrame(out, columns=[pillar, "word", "hub", "posts"])

    return posts.select(pillar, "id", "words").groupBy(pillar).applyInPandas(settle, f"{pillar} string, word string, hub long, posts string")


def topic_words(rows: DataFrame, group: str, words: str, least: int = 3, share: float = 0.5) -> DataFrame:
    """Words in at least ``share`` of a group's names, and in three of them."""
    n = rows.groupBy(group).agg(F.count("*").alias("_n"))
    each = rows.select(group, F.explode(F.array_distinct(words)).alias("word")).groupBy(group, "word").agg(F.count("*").alias("names"))
    return each.join(n, group).filter((F.col("names") >= least) & (F.col("names") >= share * F.col("_n"))).drop("_n")


def carry_over(posts: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """Bring team columns of an earlier plan to a new one: by address, then by the main keyword's signature, one to one."""
    x, left, taken = posts, previous, None
    for key in ("url", "signature"):
        a = x.filter(F.coalesce(F.col(key), F.lit("")) != "").withColumn(
            "_k", F.row_number().over(Window.partitionBy(key).orderBy("slug")),
        ).filter("_k = 1").select("slug", key)
        b = left.filter(F.coalesce(F.col(key), F.lit("")) != "").withColumn(
            "_k", F.row_number().over(Window.partitionBy(key).orderBy("old_slug")),
        ).filter("_k = 1").select("old_slug", key)
        got = a.join(b, key).select("slug", "old_slug")
        taken = got if taken is None else taken.unionByName(got)
        x, left = x.join(got, "slug", "left_anti"), left.join(got, "old_slug", "left_anti")
    values = taken.join(previous.select("old_slug", *[F.col(c).alias(f"_{c}") for c in columns]), "old_slug")
    out = posts.join(values, "slug", "left")
    return out.select(
        *[c for c in posts.columns if c not in columns],
        *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) if c in posts.columns else F.col(f"_{c}").alias(c) for c in columns],
        F.col("old_slug").isNotNull().alias("carried"),
    )


def not_planned(clusters: DataFrame, posts: DataFrame, words: str = "words") -> DataFrame:
    """Clusters left out (backlog, skip) with the planned post that shares most words."""
    from . import similarity as S

    out = clusters.filter(F.col("role").isin("backlog", "skip"))
    near = S.nearest(out, "id", posts, "slug", words, ["market"])
    return out.join(near.select(F.col("a").alias("id"), F.col("b").alias("nearest"), "shared"), "id", "left")


def bucketed_volumes(
    rows: DataFrame, source: str, volume: str, steps: tuple[int, ...] = (0, 10, 50, 100, 500, 1000, 5000, 10000, 50000, 100000, 500000, 1000000),
) -> DataFrame:
    """Sources whose every volume is a bucket value of the planner, so that its figures are ranges."""
    return rows.groupBy(source).agg((F.bool_and(F.col(volume).isin(*steps)) & (F.count(volume) > 0)).alias("bucketed"))


def filters_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A key and value sheet as one map; the first value of a key stays."""
    one = rows.filter(F.coalesce(F.trim(key), F.lit("")) != "").groupBy(F.lower(F.trim(key)).alias("k")).agg(F.min_by(value, "row").alias("v"))
    return one.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("filters"))


def anchor_from_title(title):
    """A list-style title as anchor: the leading number, what follows a dash or colon, and a year dropped."""
    x = F.regexp_replace(T.straight_quotes(F.lower(title)), r"\s*[-:|–—(].*$", "")
    x = F.regexp_replace(x, r"^(?:top )?[0-9]+\+? ", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\b(?:19|20)[0-9]{2}\b", ""), r"\s+", " "))
