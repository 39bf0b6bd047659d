"""Seasonal calendar: occasions by rule, deadlines per market, next event for a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D

#: Occasions with their markets and date rules (see functions.dates.occurrence).
OCCASIONS = [
    ("new-years-day", "us uk", ("fixed", 1, 1)),
    ("valentines-day", "us uk", ("fixed", 2, 14)),
    ("st-patricks-day", "us uk", ("fixed", 3, 17)),
    ("mothers-day-uk", "uk", ("easter", -21)),
    ("easter", "us uk", ("easter", 0)),
    ("mothers-day", "us", ("nth", 5, "SUN", 2)),
    ("memorial-day", "us", ("last", 5, "MON")),
    ("fathers-day", "us uk", ("nth", 6, "SUN", 3)),
    ("independence-day", "us", ("fixed", 7, 4)),
    ("labor-day", "us", ("nth", 9, "MON", 1)),
    ("halloween", "us uk", ("fixed", 10, 31)),
    ("thanksgiving", "us", ("nth", 11, "THU", 4)),
    ("black-friday", "us uk", ("after", ("nth", 11, "THU", 4), 1)),
    ("cyber-monday", "us uk", ("after", ("nth", 11, "THU", 4), 4)),
    ("christmas", "us uk", ("fixed", 12, 25)),
    ("boxing-day", "uk", ("fixed", 12, 26)),
]


def occasions(years: DataFrame, year: str = "year") -> DataFrame:
    """(occasion, year, market, event_date) for every year given; rules are columns, the rule list is fixed."""
    y = F.col(year)
    rows = [F.struct(F.lit(name).alias("occasion"), F.lit(markets).alias("markets"), D.occurrence(rule, y).alias("event_date")) for name, markets, rule in OCCASIONS]
    each = years.select(y.cast("int").alias("year"), F.explode(F.array(*rows)).alias("o"))
    return each.select("o.occasion", "year", F.explode(F.split("o.markets", " ")).alias("market"), "o.event_date")


def with_deadlines(events: DataFrame, today: Column, new_weeks: int = 12, refresh_weeks: int = 6) -> DataFrame:
    """Publish-by and refresh-by dates with their status."""
    publish, refresh = F.date_sub("event_date", 7 * new_weeks), F.date_sub("event_date", 7 * refresh_weeks)
    return events.withColumn("publish_by", publish).withColumn("refresh_by", refresh).withColumn(
        "status", D.deadline_status(F.col("publish_by"), today),
    )


def next_event(rows: DataFrame, day: str, events: DataFrame, keys: list[str]) -> DataFrame:
    """For each row the first event on or after its day, the last one where none follows.

    ``events`` holds a few dozen rows a year; it becomes one sorted array per
    key (bounded by years x occasions) that each row searches, so ``rows`` is
    neither sorted nor multiplied.
    """
    lists = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("event_date", "occasion"))).alias("_e"))
    joined = rows.join(F.broadcast(lists), keys, "left") if keys else rows.crossJoin(F.broadcast(lists))
    after = F.filter("_e", lambda e: e["event_date"] >= F.col(day))
    pick = F.when(F.size(after) > 0, F.element_at(after, 1)).otherwise(F.try_element_at("_e", F.lit(-1)))
    return joined.withColumn("_p", pick).withColumn("next_date", F.col("_p.event_date")).withColumn("next_occasion", F.col("_p.occasion")).drop("_e", "_p")


def years_between(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
