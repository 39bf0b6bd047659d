"""Merging rows of one keyword: sources of the same phrase, spelling variants, one reason per excluded row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_sources(rows: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """Fold rows of one keyword in input order into one.

    Columns: vclass, volume, kd, position, url, src, tool and ``order``.  A later
    row wins only if its (vclass, volume) is strictly greater; difficulty falls
    back to the loser's; the best position brings its url; sources are united in
    input order.  The fold is one ordered aggregate, since difficulty inherited
    along the way depends on the order.  Values of a key are as many as its
    source files give, so the collected list is short.
    """
    fields = ["vclass", "volume", "kd", "position", "url", "src", "tool"]
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("rows"))
    first = F.element_at("rows", 1)
    start = F.struct(*[first[f].alias(f) for f in ["vclass", "volume", "kd", "position", "url"]])

    def step(acc: Column, r: Column) -> Column:
        wins = (r["vclass"] > acc["vclass"]) | ((r["vclass"] == acc["vclass"]) & (r["volume"] > acc["volume"]))
        pick = lambda f: F.when(wins, r[f]).otherwise(acc[f])
        lose = lambda f: F.when(wins, acc[f]).otherwise(r[f])
        worse = lose("position").isNotNull() & (pick("position").isNull() | (pick("position") > lose("position")))
        url = F.when(worse & (F.coalesce(lose("url"), F.lit("")) != ""), lose("url")).otherwise(
            F.coalesce(F.nullif(pick("url"), F.lit("")), lose("url"))
        )
        return F.struct(
            pick("vclass").alias("vclass"),
            pick("volume").alias("volume"),
            F.coalesce(pick("kd"), lose("kd")).alias("kd"),
            F.when(worse, lose("position")).otherwise(pick("position")).alias("position"),
            url.alias("url"),
        )

    folded = listed.select(*keys, F.aggregate(F.slice("rows", 2, F.size("rows")), start, step).alias("m"), "rows")
    sources = F.array_join(F.array_distinct(F.filter(F.transform("rows", lambda r: r["src"]), lambda s: s.isNotNull())), "|")
    tools = F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["tool"], F.coalesce(r["volume"].cast("string"), F.lit("")))), "|")
    return folded.select(
        *keys, "m.*", sources.alias("src"), tools.alias("sources"), F.element_at("rows", 1)[order].alias("first_seen"),
        F.size("rows").cast("long").alias("n_rows"),
    )


def merge_variants(rows: DataFrame, keys: list[str], phrase: str, volume: str, order: str) -> DataFrame:
    """One row per variant key: the phrase of the greatest volume (the earliest on ties) with its variants.

    A phrase without a year beats one with a year from a fifth of its volume on.
    """
    year = F.rlike(phrase, F.lit(r"\b(19|20)[0-9]{2}\b"))
    row = F.struct(F.col(order).alias("o"), F.col(phrase).alias("p"), F.col(volume).alias("v"), year.alias("y"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def prefer(acc: Column, r: Column) -> Column:
        plain_new, plain_old = ~r["y"] & acc["y"] & (r["v"] * 5 >= acc["v"]), r["y"] & ~acc["y"] & (acc["v"] * 5 >= r["v"])
        return F.when(plain_new | (~plain_old & (r["v"] > acc["v"])), r).otherwise(acc)

    kept = listed.withColumn("k", F.aggregate(F.slice("rows", 2, F.size("rows")), F.element_at("rows", 1), prefer))
    others = F.filter("rows", lambda r: r["o"] != F.col("k.o"))
    return kept.select(
        *keys,
        F.col("k.p").alias(phrase),
        F.col("k.v").alias(volume),
        F.transform(others, lambda r: r["p"]).alias("variants"),
        F.transform(others, lambda r: r["v"]).alias("variant_volumes"),
        F.col("k.o").alias(order),
    )


def distinct_volume(volume: Column, variant_volumes: Column) -> Column:
    """Sum of the distinct volumes of a phrase and its variants: the same figure is counted once."""
    return F.aggregate(F.array_distinct(F.concat(F.array(volume), variant_volumes)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def route(rows: DataFrame, rules: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """Add the name of the first rule that a row fails, or null; later rules never see it."""
    return rows.withColumn(name, F.coalesce(*[F.when(failed, F.lit(rule)) for rule, failed in rules], F.lit(None).cast("string")))


def kept_and_excluded(routed: DataFrame, name: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Both sides of :func:`route`; each row is on exactly one."""
    return routed.filter(F.col(name).isNull()).drop(name), routed.filter(F.col(name).isNotNull())


def forward_fill(rows: DataFrame, partition: list[str], order: str, column: str, out: str) -> DataFrame:
    """Blank cells continue the value above them."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.last(F.nullif(F.col(column), F.lit("")), ignorenulls=True).over(w))


def unpivot_pairs(rows: DataFrame, id_columns: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Side-by-side (keyword, volume) columns as rows, with the group that the keyword column names."""
    cells = F.array(*[F.struct(F.lit(k).alias("grp"), F.col(f"`{k}`").cast("string").alias("keyword"), F.col(f"`{v}`").cast("string").alias("volume")) for k, v in pairs])
    return rows.select(*id_columns, F.explode(cells).alias("c")).select(*id_columns, "c.*").filter("coalesce(trim(keyword), '') <> ''")
