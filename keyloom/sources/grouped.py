"""Grouped keyword sheets in several layouts, brought to one record shape.

Record: group_no, main, keyword, volume, kd, pillar, role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.merge import unpivot_pairs


def layout_of(columns: list[str]) -> str:
    """plan, wide, long, pairs or block, by the columns that a sheet has."""
    have = {c.lower() for c in columns}
    if {"stt", "main_keyword", "pillar"} <= have:
        return "plan"
    if {"main_keyword", "secondary_keywords"} <= have:
        return "wide"
    if "keyword" in have and have & {"group", "cluster", "topic"}:
        return "long"
    if {"main_keyword", "secondary_keyword"} <= have:
        return "block"
    return "pairs"


def _filled(c: Column, order: str) -> Column:
    w = Window.partitionBy("_src").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(F.nullif(F.trim(c), F.lit("")), ignorenulls=True).over(w)


def block(rows: DataFrame, order: str = "row") -> DataFrame:
    """A row with a main keyword starts a group, rows without continue it; the pillar is inherited downwards.

    ``_src`` names the sheet: order matters inside a sheet only, and a sheet is
    what one person's file holds.
    """
    main = F.nullif(F.trim("main_keyword"), F.lit(""))
    w = Window.partitionBy("_src").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = rows.withColumn("group_no", F.sum(main.isNotNull().cast("int")).over(w)).withColumn("main", _filled(F.col("main_keyword"), order))
    x = x.withColumn("pillar", _filled(F.col("pillar"), order) if "pillar" in rows.columns else F.lit(None).cast("string"))
    mains = x.filter(main.isNotNull()).select(
        "_src", "group_no", "main", F.col("main").alias("keyword"), "volume", "kd", "pillar", F.lit("main").alias("role"),
    )
    second = F.nullif(F.trim("secondary_keyword"), F.lit(""))
    members = x.filter(second.isNotNull()).select(
        "_src", "group_no", "main", second.alias("keyword"), "volume", "kd", "pillar", F.lit("secondary").alias("role"),
    )
    return mains.unionByName(members).filter("main is not null")


def wide(rows: DataFrame, order: str = "row") -> DataFrame:
    """One row a group, its members in a list cell."""
    x = rows.withColumn("group_no", F.row_number().over(Window.partitionBy("_src").orderBy(order))).withColumn("main", F.trim("main_keyword"))
    pillar = F.col("pillar") if "pillar" in rows.columns else F.lit(None).cast("string")
    mains = x.select("_src", "group_no", "main", F.col("main").alias("keyword"), "volume", "kd", pillar.alias("pillar"), F.lit("main").alias("role"))
    items = x.select(
        "_src", "group_no", "main", F.explode(T.split_list(F.coalesce("secondary_keywords", F.lit("")))).alias("keyword"),
        F.lit(None).cast("string").alias("volume"), F.lit(None).cast("string").alias("kd"), pillar.alias("pillar"), F.lit("secondary").alias("role"),
    )
    return mains.unionByName(items).filter("main <> ''")


def long(rows: DataFrame, group: str = "group", order: str = "row") -> DataFrame:
    """One row a keyword; a blank group cell continues the one above; the greatest volume is the main."""
    x = rows.withColumn("_g", _filled(F.col(group), order)).filter("_g is not null and coalesce(trim(keyword), '') <> ''")
    first = F.row_number().over(Window.partitionBy("_src", "_g").orderBy(F.desc_nulls_last(F.col("volume").try_cast("double")), order))
    x = x.withColumn("_k", first).withColumn("main", F.first("keyword").over(Window.partitionBy("_src", "_g").orderBy("_k")))
    number = F.min(order).over(Window.partitionBy("_src", "_g"))
    return x.select(
        "_src", number.alias("group_no"), "main", "keyword", "volume", "kd" if "kd" in rows.columns else F.lit(None).cast("string").alias("kd"),
        F.lit(None).cast("string").alias("pillar"), F.when(F.col("_k") == 1, "main").otherwise("secondary").alias("role"),
    )


def keyword_columns(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns that hold keywords, by profile: three cells, 90 % text, few commas, 80 % distinct, 1 to 12 words.

    One aggregate over all candidate columns; its single row comes to the driver.
    """
    cell = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    exprs = []
    for i, c in enumerate(columns):
        v = cell(c)
        exprs += [
            F.count(v).alias(f"n{i}"), F.count_if(F.rlike(v, F.lit(r"\p{L}"))).alias(f"t{i}"), F.count_if(F.instr(v, ",") > 0).alias(f"c{i}"), F.approx_count_distinct(v, 0.02).alias(f"d{i}"), F.avg(F.size(F.split(v, r"\s+"))).alias(f"w{i}"),
        ]
    r = rows.agg(*exprs).first()
    ok = lambda i: r[f"n{i}"] >= 3 and r[f"t{i}"] >= 0.9 * r[f"n{i}"] and r[f"c{i}"] <= 0.05 * r[f"n{i}"] and r[f"d{i}"] >= 0.8 * r[f"n{i}"] and 1 <= r[f"w{i}"] <= 12
    return [c for i, c in enumerate(columns) if ok(i)]


def pairs(rows: DataFrame, order: str = "row") -> DataFrame:
    """Side-by-side (keyword, volume) columns; each pair is a group named by its header."""
    columns = [c for c in rows.columns if c not in ("_src", order)]
    named = keyword_columns(rows, columns)
    found = [(c, columns[columns.index(c) + 1]) for c in named if columns.index(c) + 1 < len(columns) and columns[columns.index(c) + 1] not in named]
    if len(found) < 2:
        raise ValueError("fewer than two keyword and volume column pairs")
    each = unpivot_pairs(rows, ["_src", order], found).withColumnRenamed("grp", "group")
    return long(each, "group", order)


def read_grouped(rows: DataFrame, order: str = "row") -> DataFrame:
    """Any layout to records."""
    kind = layout_of(rows.columns)
    if kind in ("block", "plan") and "secondary_keyword" in rows.columns:
        return block(rows, order)
    if kind in ("wide", "plan"):
        return wide(rows, order)
    if kind == "long":
        return long(rows, next(c for c in ("group", "cluster", "topic") if c in rows.columns), order)
    return pairs(rows, order)
