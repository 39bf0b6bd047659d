"""Search result files: one entry per market and keyword, the latest check's ten best results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def latest_results(rows: DataFrame, most: int = 10) -> DataFrame:
    """Long rows (keyword, market, checked_at, position, url, title) to (market, key, keyword, checked_at, urls, titles).

    An address counts once, at its best position; ties of position go by
    address and title.
    """
    x = rows.withColumn("key", T.decision_key(F.col("keyword"))).withColumn("url", T.canonical_url(F.col("url")))
    newest = x.groupBy("market", "key").agg(F.max("checked_at").alias("checked_at"))
    best = x.join(newest, ["market", "key", "checked_at"], "left_semi").groupBy("market", "key", "checked_at", "url").agg(
        F.min(F.struct("position", "title", "keyword")).alias("b")
    )
    rank = F.row_number().over(Window.partitionBy("market", "key").orderBy("b.position", "url", "b.title"))
    top = best.withColumn("_r", rank).filter(F.col("_r") <= most)
    listed = top.groupBy("market", "key").agg(
        F.max("checked_at").alias("checked_at"), F.min("b.keyword").alias("keyword"),
        F.array_sort(F.collect_list(F.struct("_r", "url", F.col("b.title").alias("title")))).alias("l"),
    )
    return listed.select(
        "market", "key", "keyword", "checked_at", F.transform("l", lambda e: e["url"]).alias("urls"),
        F.transform("l", lambda e: e["title"]).alias("titles"),
    )


def wide_results(rows: DataFrame, column: str = "serp_urls") -> DataFrame:
    """Wide rows (keyword, urls in one cell) as long ones, position by order."""
    each = rows.select(
        "keyword", "market", "checked_at",
        F.posexplode(F.filter(F.transform(F.split(column, r"[|\s]+"), lambda v: F.trim(v)), lambda u: u != "")).alias("p", "url"),
    )
    return each.select("keyword", "market", "checked_at", (F.col("p") + 1).alias("position"), "url", F.lit("").alias("title"))


def apply_results(keywords: DataFrame, results: DataFrame, row_id: str, keyword: str, variants: str, market: str) -> DataFrame:
    """Bring results to keywords: the keyword itself, then its variants; its own market, then results without one."""
    names = keywords.select(
        row_id, F.col(market).alias("_m"),
        F.posexplode(F.concat(F.array(F.col(keyword)), F.coalesce(F.col(variants), F.array().cast("array<string>")))).alias("_o", "_n"),
    )
    tries = names.select(
        row_id, "_o", T.decision_key(F.col("_n")).alias("key"),
        F.explode(
            F.array(F.struct(F.lit(0).alias("q"), F.col("_m").alias("market")), F.struct(F.lit(1).alias("q"), F.lit("").alias("market")))
        ).alias("t"),
    )
    found = tries.select(row_id, "_o", "key", "t.q", "t.market").join(results.select("market", "key", "urls", "checked_at"), ["market", "key"])
    first = found.groupBy(row_id).agg(F.min_by(F.struct("urls", "checked_at"), F.struct("_o", "q")).alias("f"))
    return keywords.join(first, row_id, "left").withColumn("urls", F.col("f.urls")).withColumn("checked_at", F.col("f.checked_at")).drop("f")
