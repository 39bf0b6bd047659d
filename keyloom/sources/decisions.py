"""Decision tables that people keep beside a project: comma, semicolon or tab separated, with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tabular

#: The columns of a decision table, in order.
COLUMNS = ("decision_id", "action", "market", "keyword", "target", "value", "reason", "evidence", "source_issue", "author", "date")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """All columns of :data:`COLUMNS` as strings, empty where absent; rows without action and keyword go.

    Headers count without case and blanks.  A row without an id is named by its
    content, so that logs of two runs agree.
    """
    header_line = tabular._head_lines(spark, path)[0]
    delimiter = max(tabular.DELIMITERS, key=lambda d: len(tabular.cells_of(header_line, d)))
    names = [c.strip().lower().replace(" ", "_").lstrip("﻿") for c in tabular.cells_of(header_line, delimiter)]
    if not {"action", "keyword"} <= set(names):
        raise ValueError("a decision table needs the columns action and keyword")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    reader = spark.read.schema(schema).option("sep", delimiter).option("header", True).option("enforceSchema", True)
    rows = reader.option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    at = {n: f"c{i}" for i, n in reversed(list(enumerate(names)))}
    cell = lambda n: F.trim(F.coalesce(F.col(at[n]), F.lit(""))) if n in at else F.lit("")
    x = rows.select(*[cell(n).alias(n) for n in COLUMNS]).filter("action <> '' or keyword <> ''")
    own = F.concat(F.lit("D-"), F.substring(F.sha1(F.encode(F.concat_ws("|", *COLUMNS[1:]), "UTF-8")), 1, 8))
    return x.withColumn("action", F.lower("action")).withColumn("decision_id", F.when(F.col("decision_id") == "", own).otherwise(F.col("decision_id")))
