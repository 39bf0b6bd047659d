"""A training-data pipeline in five stages, each calling one operator of ``keyloom.llm``.

``STAGES`` names (name, function) pairs; every function takes (spark, docs,
sf_dir) and returns a DataFrame.  Each stage's result is written as Parquet and
reread as the next one's ``docs``.  All stages but the last return the columns
of ``documents``, extra ones included, whatever they are called; the last
returns the packed pieces.

Shingles are of five words and similarity is 0.8.  ORACLE_SQL is None: tokeniser
measures and packing have no SQL; tests hold each stage against brute force.

Nulls and edge cases of every stage: a null doc_id is a row like any other and
comes after all others; texts are read whole however long; an empty table gives
an empty result; what null and empty texts, ties and repeated rows come to is
said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import contamination, jaccard, lines, packing, quality
from keyloom.llm.common import made, release, table, work_dir
from keyloom.session import shipped

ORACLE_SQL = None


@shipped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have too few words and go; rows are judged one by one,
    so repeated rows stay or go alike.
    """
    return quality.kept_rows(docs)


@shipped
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of three-line windows; n_chars follows the text.

    No row goes.  A null text stays null, an empty one empty; of copies in one
    document the first place stays, of those in several the least doc_id's;
    repeated rows lose their lines alike.
    """
    kept = lines.without_repeated_lines(docs, 3, counts=False)
    if "n_chars" not in docs.columns:
        return kept
    count = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), count).otherwise(F.col("n_chars")))


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of every group of near duplicates.

    Documents without words stay; of several texts under the least doc_id the one
    with the least hash stays; rows that repeat doc_id and text are one.
    """
    return jaccard.without_near_duplicates(docs, jaccard.Join(shingle=5, percent=80, count_links=False))


@shipped
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts are clean; null and empty items have no windows; an item
    without item_id counts like any other; repeated rows stay or go alike.
    """
    return contamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


@shipped
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents in sequences of at most 1024 tokens.

    A null or empty text is its end token alone; repeated rows are packed as
    often as they occur.
    """
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result goes through Parquet in the shared folder, and what nothing reads any more is deleted."""
    docs, first = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, first, but=path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
