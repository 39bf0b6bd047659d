"""Groups that a team brings along: their keywords beside the exports', their clusters, and what clusters rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T


def prior_rows(grouped: DataFrame) -> DataFrame:
    """Rows of grouped files (group, market, keyword, volume as written, kd as written, is_main) as keyword rows.

    Their own volume loses to any export's (vclass 1, or -1 and volume 0 where
    there is none); rows without a keyword in normal form go.
    """
    volume = N.parse_number(F.col("volume"), integer=True)
    norm = T.normal_form(F.col("keyword"))
    known = volume["value"].isNotNull()
    return grouped.withColumn("_v", volume).filter(F.coalesce(norm, F.lit("")) != "").select(
        "keyword", F.coalesce(
            F.nullif(F.lower(F.trim("market")), F.lit("")), F.lit("all"),
        ).alias("market"), F.when(known, F.col("_v.value").cast("long")).otherwise(0).alias("volume"),
        (F.col("_v.estimate") | ~known).alias("vol_est"), F.when(known, 1).otherwise(-1).alias("vclass"), N.parse_number(F.col("kd"))["value"].alias("kd"), "group", "is_main",
    )


def with_priors(exports: DataFrame, priors: DataFrame) -> DataFrame:
    """Export rows, then the groups' (column ``idx`` counts on), so that on a tie the export's own row wins."""
    columns = ["keyword", "market", "volume", "vclass", "kd", "group", "is_main"]
    own = exports.withColumn("group", F.lit(None).cast("string")).withColumn("is_main", F.lit(False))
    return own.select(*columns, F.lit(0).alias("part")).unionByName(priors.select(*columns, F.lit(1).alias("part")))


def prior_clusters(rows: DataFrame, row_id: str) -> DataFrame:
    """One cluster for each (group, market) of rows that have a group: members by place, the main first, then by volume and keyword.

    A group of several markets is one cluster in each, and ``split`` says so.
    """
    place = Window.partitionBy("group", "market").orderBy(F.desc(F.coalesce("is_main", F.lit(False))), F.desc("volume"), "keyword", row_id)
    markets = rows.filter("group is not null").select("group", "market").distinct().groupBy("group").agg((F.count("*") > 1).alias("split"))
    x = rows.filter("group is not null").withColumn("place", F.row_number().over(place))
    return x.join(markets, "group").select(row_id, "group", "market", "keyword", "place", (F.col("place") == 1).alias("is_seed"), "split")


def parent_seeds(seeds: DataFrame) -> DataFrame:
    """(market, parent, ngroup, seed): the first seed by rank that names a parent topic."""
    return seeds.filter("coalesce(parent, '') <> ''").groupBy("market", "parent", "ngroup").agg(
        F.min_by("id", "rank").alias("seed"), F.min("rank").alias("seed_rank"),
    )


def parent_hints(clusters: DataFrame) -> DataFrame:
    """Merge candidates (a, b, parent): a cluster and the earlier one that first names its parent topic."""
    first = parent_seeds(clusters).withColumnRenamed("seed", "a")
    x = clusters.filter("coalesce(parent, '') <> ''").join(first, ["market", "parent", "ngroup"]).filter(F.col("seed_rank") < F.col("rank"))
    return x.select("a", F.col("id").alias("b"), "parent")


def seed_basis(clusters: DataFrame) -> DataFrame:
    """(cluster, basis): why a cluster is named after its seed and not after its greatest keyword.

    Columns: cluster, seed and top (structs of keyword, volume, winnable,
    fluency, fixed), given_main (the team's main names it) and given (some member
    is the team's main).
    """
    year = lambda k: F.rlike(k, F.lit(r"\b(19|20)[0-9]{2}\b"))
    s, t = F.col("seed"), F.col("top")
    basis = (
        F.when(F.col("given_main"), "given main").when(F.col("given"), "better main than the given one").when(s["volume"] >= t["volume"], "max_volume").when(
            year(t["keyword"]) & ~year(s["keyword"]), "evergreen (no year)",
        )
        .when(t["fixed"] & ~s["fixed"], "spelled correctly").when(s["winnable"] > t["winnable"] * 1.2, "easier to rank").when(
            s["fluency"] > t["fluency"], "more natural phrasing",
        ).otherwise("plain phrasing")
    )
    return clusters.select("cluster", basis.alias("basis"))


def easier_seed(members: DataFrame, cluster: str, ratio: float = 1.25, least: float = 50.0, margin: float = 0.3) -> DataFrame:
    """(cluster, name): a member that wins so much more than the seed that the page should be named after it; only clusters with one.

    Columns id, keyword, volume, winnable, fit, fluency, plain, core, is_seed.  It
    must be plain, at most eight words, easier, hold the seed's core, read about
    as naturally, and win ``ratio`` times as much and ``least`` more.
    """
    w = Window.partitionBy(cluster)
    x = members.withColumn("_s", F.max(F.when(F.col("is_seed"), F.struct("winnable", "fit", "fluency", "core"))).over(w))
    able = (
        ~F.col("is_seed") & F.col("plain") & (F.size(F.split("keyword", " ")) <= 8) & (F.col("fit") > F.col("_s.fit")) & (
            F.size(F.array_except(F.col("_s.core"), F.col("core"))) == 0
        )
        & (F.col("fluency") >= F.col("_s.fluency") - margin) & (F.col("winnable") >= ratio * F.col("_s.winnable")) & (
            F.col("winnable") - F.col("_s.winnable") >= least
        )
    )
    order = F.struct("winnable", "volume", -F.length("keyword"), "keyword")
    return x.filter(able).groupBy(cluster).agg(F.max_by("keyword", order).alias("name"))


def grouped_columns(c: Column) -> Column:
    """A cell that lists keywords, as an array: semicolons, pipes, commas or line breaks apart them."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[;|,\n]"), F.trim), lambda x: x != "")
