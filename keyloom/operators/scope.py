"""Which keywords a run keeps: markets, noise, limits, patterns, decisions, facets; one reason for each that goes.

Rules run in a fixed order and the first that a row fails names its reason.  A
decision to drop comes before all rules but the market; a decision to keep lifts
every rule but the market and the choice of facets, and what it lifted is
recorded; a keyword of an existing group is never dropped by a rule, and the rule
it meets is recorded instead.  Everything is one projection: rows don't move.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Scope:
    """What a run takes in; ``only`` names facet columns with the values allowed, all of which must hold."""

    markets: tuple[str, ...] = ("us", "uk", "all")
    min_volume: int | None = None
    max_volume: int | None = None
    max_kd: float | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    only: tuple[tuple[str, tuple[str, ...]], ...] = ()
    drop_shop: bool = False
    #: Volume limits hold from this class of volume on.
    known_class: int = 0


def _first(rules: list[tuple[Column, Column]]) -> Column:
    return F.coalesce(*[F.when(failed, reason) for failed, reason in rules], F.lit(None).cast("string"))


def _matches(patterns: tuple[str, ...], *texts: Column) -> Column:
    return reduce(Column.__or__, [F.coalesce(F.rlike(t, F.lit(p)), F.lit(False)) for p in patterns for t in texts], F.lit(False))


def noise_reason(raw: Column, norm: Column, respelled: Column, rules: list[tuple[str, str]], language: Column) -> Column:
    """The noise rule that a keyword meets: as it was typed, with the language rule, else as it was respelled, without."""
    typed = [(F.rlike(raw, F.lit(p)) | F.rlike(norm, F.lit(p)), F.lit(name)) for name, p in rules] + [(language, F.lit("language"))]
    again = [(F.rlike(respelled, F.lit(p)), F.lit(name)) for name, p in rules]
    return F.coalesce(_first(typed), F.when(respelled != norm, _first(again)))


def scoped(rows: DataFrame, scope: Scope, noise: Column | None = None) -> DataFrame:
    """``rows`` with ``reason`` (null where kept), ``lifted`` (the rule that a decision to keep set aside) and ``hit`` (the one that a grouped keyword meets).

    Columns read: keyword, norm, market, volume, vclass, kd, need, prior
    (whether an existing group holds it), action and decision_id (null where no
    decision names it), and the facets of ``only``.  Unknown difficulty passes;
    volume limits hold where a volume is known at all (vclass of ``known_class`` or more).
    """
    low, norm = F.lower("keyword"), F.col("norm")
    none = F.lit(None).cast("string")
    keep, drop = F.coalesce(F.col("action") == "keep_keyword", F.lit(False)), F.coalesce(F.col("action") == "drop_keyword", F.lit(False))
    rules = [(noise.isNotNull(), noise)] if noise is not None else []
    known = F.col("vclass") >= scope.known_class
    if scope.min_volume:
        rules.append((known & (F.col("volume") < scope.min_volume), F.lit("filter:min_volume")))
    if scope.max_volume:
        rules.append((known & (F.col("volume") > scope.max_volume), F.lit("filter:max_volume")))
    if scope.max_kd is not None:
        rules.append((F.col("kd") > scope.max_kd, F.lit("filter:max_kd")))
    if scope.include:
        rules.append((~_matches(scope.include, norm, low), F.lit("filter:include_no_match")))
    rules += [(_matches((p,), norm, low), F.lit(f"filter:exclude:{p}")) for p in scope.exclude]
    early = _first(rules)
    outside = ~reduce(Column.__and__, [F.coalesce(F.col(c).isin(*values), F.lit(False)) for c, values in scope.only], F.lit(True))
    shop = F.lit(scope.drop_shop) & F.coalesce(F.col("need") == "shop", F.lit(False))
    late = _first([(outside, F.lit("filter:only")), (shop, F.lit("filter:drop_shop"))])
    x = rows.withColumn("_early", early).withColumn("_late", late)
    market = F.when(~F.coalesce(F.col("market"), F.lit("")).isin(*scope.markets), F.concat(F.lit("market:"), F.coalesce("market", F.lit(""))))
    decided = F.when(drop, F.concat(F.lit("decision:"), "decision_id"))
    prior = F.coalesce(F.col("prior"), F.lit(False))
    early_left = F.when(keep | prior, none).otherwise(F.col("_early"))
    late_left = F.when((keep & (F.col("_late") == "filter:drop_shop")) | prior, none).otherwise(F.col("_late"))
    reason = F.coalesce(market, decided, early_left, late_left)
    inside = F.coalesce(market, decided).isNull()
    lifted = F.when(inside & keep, F.coalesce(F.col("_early"), F.when(F.col("_late") == "filter:drop_shop", F.col("_late"))))
    hit = F.when(inside & prior & ~keep, F.coalesce("_early", "_late"))
    return x.withColumn("reason", reason).withColumn("lifted", lifted).withColumn("hit", hit).drop("_early", "_late")


def settled_need(need: Column, without_products: Column, research: Column) -> tuple[Column, Column]:
    """(need, conflict): a keyword that shops only by naming a product is judged anew where tools or results show research."""
    again = (need == "shop") & research & (without_products != "shop")
    return F.when(again, without_products).otherwise(need), again


def decided_at_ingest(rows: DataFrame, decisions: DataFrame, markets: tuple[str, ...] = ("us", "uk", "all")) -> tuple[DataFrame, DataFrame]:
    """``rows`` (market, keyword) with action and decision_id of the keep or drop that names them, and a log of all of these.

    A decision names a keyword by its identity key; with a blank market it must
    be found in one market alone, and what is found in none is stale.  A keep and
    a drop of one keyword are both in conflict and neither holds; of several
    alike the first by number does.
    """
    number = F.coalesce(F.regexp_extract("decision_id", r"([0-9]{1,9})", 1).try_cast("long"), F.lit(0))
    wanted = decisions.filter(F.col("action").isin("keep_keyword", "drop_keyword")).select(
        "decision_id", "action", F.lower(F.trim(F.coalesce("market", F.lit("")))).alias("dm"), T.decision_key(F.col("keyword")).alias("_key"),
        number.alias("_no"),
    )
    keyed = rows.withColumn("_key", T.decision_key(F.col("keyword")))
    present = keyed.select("_key", "market").distinct()
    where = wanted.join(present, "_key", "left").filter("market is null or dm = '' or dm = market or market = 'all'")
    # of the market itself and 'all' the market goes first
    own = F.max(F.when(F.col("dm") == F.col("market"), 1).otherwise(0)).over(Window.partitionBy("decision_id"))
    where = where.withColumn("_own", own).filter("dm = '' or _own = 0 or dm = market")
    found = where.groupBy("decision_id", "action", "_key", "_no").agg(F.count("market").alias("n"), F.min("market").alias("market"))
    named = found.filter("n = 1")
    both = F.size(F.collect_set("action").over(Window.partitionBy("market", "_key"))) > 1
    named = named.withColumn("clash", both)
    first = F.row_number().over(Window.partitionBy("market", "_key").orderBy("_no", "decision_id"))
    holding = named.filter("not clash").withColumn("_k", first).filter("_k = 1").select("market", "_key", "action", "decision_id")
    status = F.when(F.col("n") == 0, "stale").when(F.col("n") > 1, "invalid").when(F.col("clash"), "conflict").otherwise("found")
    listed = wanted.join(found.select("decision_id", "n"), "decision_id", "left").join(named.select("decision_id", "clash"), "decision_id", "left")
    log = listed.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("status", status).select("decision_id", "action", "status")
    return keyed.join(holding, ["market", "_key"], "left").drop("_key"), log


def kept_log(scoped_rows: DataFrame, log: DataFrame) -> DataFrame:
    """The log after the rules: what a keep lifted, or that no rule stood against it; outside the facets chosen it is stale."""
    by_decision = scoped_rows.filter("decision_id is not null").groupBy("decision_id").agg(
        F.max(F.col("reason").isNull().cast("int")).alias("kept"), F.array_join(
            F.array_sort(F.collect_set("lifted")), ", ",
        ).alias("lifted"), F.count("*").alias("n")
    )
    x = log.join(by_decision, "decision_id", "left")
    keep = (F.col("action") == "keep_keyword") & (F.col("status") == "found")
    status = (
        F.when(~(F.col("status") == "found"), F.col("status")).when(
            F.col("action") == "drop_keyword", F.when(F.col("n").isNull(), "already_true").otherwise("applied"),
        )
        .when(keep & (F.coalesce("kept", F.lit(0)) == 0), "stale").when(keep & (F.col("lifted") != ""), "applied").otherwise("already_true")
    )
    detail = F.when((status == "applied") & keep, F.concat(F.lit("kept despite "), "lifted")).otherwise("")
    return x.select("decision_id", "action", status.alias("status"), detail.alias("detail"))
