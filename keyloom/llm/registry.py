"""Driver-facing queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, jaccard, lines, packing, quality, sharding, sql, substrings, suffixes, urls, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

#: The url rules of the production query.
URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]
SHARDS = 24


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), jaccard.Join(shingle=3, percent=90)).select(
        "doc_id", "n_shingles", "component_id", "class_id", "n_links",
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_substrings(table(spark, sf_dir, "documents")).drop("kept")


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.without_repeated_lines(docs, 3)
    return kept.select("doc_id", "n_lines", "n_lines_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_packing_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digest(contamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_substring_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_passages(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Query]:
    import corpus_pipeline

    own = [
        op1_ngram_jaccard,
        op2_url_filters,
        op3_quality_fertility,
        op4_suffix_array_dedup,
        op5_line_windows,
        op6_packing_dp,
        op7_decontamination,
        op8_rendezvous_sharding,
        op9_substring_sketch,
        op10_warc_transactions,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL where it can state the same result; the other queries are tested against brute force."""
    return dict(sql.ORACLE)
