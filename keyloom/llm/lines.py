"""Line dedup by overlapping three-line windows.

Every line is hashed once; a window is ``width`` consecutive lines, named by the
hash of their hashes.  Windows found more than once, anywhere, stay at their
first place in order of (doc_id, line number); at every later place the lines
they cover go, covered positions of overlapping windows being merged.  Windows
are judged on the input, not on what is left.  A window whose lines are all
blank is not counted.

Only DataFrame functions are used.  Counting pre-aggregates before it shuffles,
so a window that a third of the corpus shares is one row a task; the join that
brings the first place back is one that adaptive execution splits at hot keys.

Nulls and edge cases: a null text has no lines and stays null; an empty text is
one empty line; texts of fewer lines than a window are kept; rows with the same
doc_id and text stand at the same places and keep their lines alike; a null
doc_id comes after all others; extra columns ride along as they are, and counts
whose names they bear get an underscore more; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

NO_ID = 2**63 - 1


def _named(docs: DataFrame) -> tuple[Column, Column]:
    """What names a row: doc_id, null as the greatest, and its text's hash."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_key")


def line_windows(text: Column, width: int) -> Column:
    """Array of (line, window) over all windows with a line that is not blank."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(F.md5(x).alias("h"), F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")).alias("solid")))


def covered_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, row_key, covered): the line numbers, from 0, to remove from each row that loses any."""
    rows = docs.select(*_named(docs), line_windows(F.col("text").cast("string"), width).alias("lines"))
    rows = rows.filter(F.size("lines") >= width)
    starts = F.sequence(F.lit(0), F.size("lines") - width)
    window = F.transform(
        starts,
        lambda i: F.struct(
            i.cast("int").alias("line"),
            F.md5(F.concat(*[F.element_at("lines", i + j + 1)["h"] for j in range(width)])).alias("window"),
            F.exists(F.slice("lines", i + 1, F.lit(width)), lambda x: x["solid"]).alias("solid"),
        ),
    )
    windows = rows.select("doc_id", "row_key", F.explode(window).alias("w")).filter("w.solid").select("doc_id", "row_key", "w.line", "w.window")
    place = F.struct("doc_id", "line")
    seen = windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last"))
    later = windows.join(seen.select("window", "first"), "window").filter(place > F.col("first"))
    return later.groupBy("doc_id", "row_key").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence("line", F.col("line") + width - 1)))).alias("covered")
    )


def without_repeated_lines(docs: DataFrame, width: int = 3, counts: bool = True) -> DataFrame:
    """``docs`` with the texts' remaining lines; all other columns as they were, and n_lines and n_lines_removed after them if ``counts``."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    joined = docs.select(own, *_named(docs)).join(covered_lines(docs, width), ["doc_id", "row_key"], "left")
    lines = F.split(F.col("own.text").cast("string"), "\n")
    # what is left by one pass of a hash set, so that a text of a million repeated lines costs what it is long
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "covered")
    new = F.when(F.col("covered").isNull(), F.col("own.text").cast("string")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    )
    columns = [new.alias("text") if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns]
    if not counts:
        return joined.select(*columns)
    n = F.when(F.col("own.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(free_name("n_lines", docs.columns))
    return joined.select(*columns, n, F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias(free_name("n_lines_removed", docs.columns)))
