"""Spelling and fluency learnt from the phrases themselves.

Models are count tables; all learning is aggregation and joins.  Fixes are
applied word by word through a map that is bounded by a parameter and checked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import cluster as C


@dataclass(frozen=True)
class Spelling:
    """Thresholds of learning."""

    least_df: int = 30
    share: float = 0.003
    least_length: int = 6
    times_rarer: int = 10
    two_edits_from: int = 9
    joined_length: int = 7


def word_frequency(phrases: DataFrame, words: str) -> DataFrame:
    return phrases.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def pair_frequency(phrases: DataFrame, words: str) -> DataFrame:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return phrases.select(F.explode(F.array_distinct(pairs)).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("df"))


def _inflected(a: Column, b: Column) -> Column:
    """One word is the other with a common ending."""
    return F.rlike(F.concat_ws(" ", a, b), F.lit(r"^(\S+) \1(s|es|d|ed|ing|er|ers|ly)$")) | F.rlike(
        F.concat_ws(" ", b, a), F.lit(r"^(\S+) \1(s|es|d|ed|ing|er|ers|ly)$"),
    )


_LETTERS = r"^\p{L}+$"


def _least(phrases: DataFrame, p: Spelling) -> DataFrame:
    """In how many phrases a common word occurs at least; one row."""
    return phrases.agg(F.greatest(F.lit(p.least_df), F.floor(F.count("*") * p.share)).alias("least"))


def common_words(phrases: DataFrame, words: str, p: Spelling) -> DataFrame:
    """(word, df): words of letters in as many phrases as a fix needs."""
    df = word_frequency(phrases, words).filter(F.rlike("word", F.lit(_LETTERS)))
    return df.crossJoin(F.broadcast(_least(phrases, p))).filter("df >= least").select("word", "df")


def _cuts(text: Column) -> Column:
    """The text without one of its letters, each in turn."""
    return F.transform(
        F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))),
    )


def corrected(words: DataFrame, targets: DataFrame, p: Spelling) -> DataFrame:
    """(word, df, right, right_df): each row's nearest target, then the commonest; none where no target is near and common enough.

    Both sides are indexed with one deletion, targets that allow two edits with two.
    """
    text = F.col("word")
    left = words.select("word", "df", F.explode(F.array_distinct(F.concat(F.array(text), _cuts(text)))).alias("cut"))
    twice = F.when(F.length(text) >= p.two_edits_from, F.flatten(F.transform(_cuts(text), _cuts))).otherwise(F.array().cast("array<string>"))
    right = targets.select(
        text.alias("right"), F.col("df").alias("right_df"), F.explode(F.array_distinct(F.concat(F.array(text), _cuts(text), twice))).alias("cut"),
    )
    pairs = left.join(right, "cut").filter("word <> right").filter(
        F.col("right_df") >= p.times_rarer * F.col("df")
    ).select("word", "df", "right", "right_df").distinct()
    ends = (F.substring("word", 1, 1) == F.substring("right", 1, 1)) | (F.substring("word", -1, 1) == F.substring("right", -1, 1))
    cap = F.when(F.length("right") >= p.two_edits_from, 2).otherwise(1)
    near = pairs.filter(ends & ~_inflected(F.col("word"), F.col("right")) & (F.levenshtein("word", "right") <= 2 * cap))
    near = near.withColumn("distance", T.osa_distance(F.col("word"), F.col("right"), cap)).filter(F.col("distance") <= cap)
    best = F.row_number().over(Window.partitionBy("word", "df").orderBy("distance", F.desc("right_df"), "right"))
    return near.withColumn("_k", best).filter("_k = 1").select("word", "df", "right", "right_df")


def typos(phrases: DataFrame, words: str, p: Spelling | None = None) -> DataFrame:
    """(wrong, right, df_wrong, df_right): rare words near a common one; the nearest, then the commonest."""
    p = p or Spelling()
    targets = common_words(phrases, words, p).filter(F.length("word") >= p.least_length)
    df = word_frequency(phrases, words).filter((F.length("word") >= p.least_length) & F.rlike("word", F.lit(_LETTERS)))
    found = corrected(df.join(targets.select("word"), "word", "left_anti"), targets, p)
    return found.select(F.col("word").alias("wrong"), "right", F.col("df").alias("df_wrong"), F.col("right_df").alias("df_right"))


def joins(phrases: DataFrame, words: str, p: Spelling | None = None) -> DataFrame:
    """(a, b, joined): two words that are written as one far more often."""
    p = p or Spelling()
    pairs = pair_frequency(phrases, words).filter(
        (F.length("a") >= 3) & (F.length("b") >= 3)
    ).withColumn("joined", F.concat("a", "b")).filter(F.rlike("joined", F.lit(_LETTERS)))
    df = word_frequency(phrases, words).select(F.col("word").alias("joined"), F.col("df").alias("joined_df"))
    both = pairs.filter(F.length("joined") >= p.joined_length).join(df, "joined")
    return both.filter(F.col("joined_df") >= F.greatest(F.lit(20), 3 * F.col("df"))).select("a", "b", "joined")


def rejoins(phrases: DataFrame, words: str, fixes: DataFrame, p: Spelling | None = None) -> DataFrame:
    """(a, b, joined): a space typed inside a common word, one side a fragment that is hardly used alone.

    Pairs that :func:`joins` has, and those where a fix of :func:`typos` beside a common word is enough, are left out.
    """
    p = p or Spelling()
    common = common_words(phrases, words, p)
    targets = common.filter(F.length("word") >= p.least_length)
    known = word_frequency(phrases, words).join(common.select("word", F.lit(True).alias("common")), "word", "left").join(
        fixes.select(F.col("wrong").alias("word"), F.lit(True).alias("typo")), "word", "left",
    )
    known = known.select("word", "df", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("common", "typo")])
    side = lambda x: known.select(F.col("word").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("df", "common", "typo")])
    whole = F.concat("a", "b")
    able = F.rlike(whole, F.lit(_LETTERS)) & (F.length(whole) >= p.least_length)
    for x in ("a", "b"):
        able &= (F.length(x) != 2) & ~F.col(x).isin("a", "i")
    pairs = pair_frequency(phrases, words).filter(able).join(side("a"), "a").join(side("b"), "b")
    fragment = lambda x: (F.length(x) == 1) | ((F.length(x) >= 3) & (F.col(f"df_{x}") <= 2) & ~F.col(f"common_{x}"))
    enough = (F.col("typo_a") & F.col("common_b")) | (F.col("typo_b") & F.col("common_a"))
    pairs = pairs.filter((fragment("a") | fragment("b")) & ~enough).select("a", "b", "df", whole.alias("word"))
    pairs = pairs.join(targets.select("word"), "word", "left_anti").join(joins(phrases, words, p).select("a", "b"), ["a", "b"], "left_anti")
    near = corrected(pairs.select("word", "df").distinct(), targets, p).select("word", "df", F.col("right").alias("joined"))
    return pairs.join(near, ["word", "df"]).filter("joined <> a and joined <> b").select("a", "b", "joined")


def _rare(phrases: DataFrame, words: str, p: Spelling) -> DataFrame:
    """(word, df): words of letters in a tenth of the phrases that a common one needs, or fewer."""
    df = word_frequency(phrases, words).filter(F.rlike("word", F.lit(_LETTERS))).crossJoin(F.broadcast(_least(phrases, p)))
    return df.filter(F.col("df") <= F.greatest(F.lit(2), F.floor(F.col("least") / 10))).select("word", "df")


def splits(phrases: DataFrame, words: str, p: Spelling | None = None) -> DataFrame:
    """(word, a, b): a rare word, no typo, whose halves are common and a common pair."""
    p = p or Spelling()
    common = common_words(phrases, words, p).select("word")
    rare = _rare(phrases, words, p).filter(F.length("word") >= 4).join(
        typos(phrases, words, p).select(F.col("wrong").alias("word")), "word", "left_anti",
    )
    pairs = pair_frequency(phrases, words).join(common.withColumnRenamed("word", "a"), "a", "left_semi").join(
        common.withColumnRenamed("word", "b"), "b", "left_semi",
    )
    fit = rare.join(pairs.select("a", "b", F.concat("a", "b").alias("word"), F.col("df").alias("pair_df")), "word").filter(
        F.col("pair_df") >= F.greatest(F.lit(20), 10 * F.col("df"))
    )
    best = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("pair_df"), F.desc("a")))
    return fit.withColumn("_k", best).filter("_k = 1").select("word", "a", "b")


def completions(phrases: DataFrame, words: str, p: Spelling | None = None) -> DataFrame:
    """(a, b, whole): a rare word that begins a common one, by far the most usual after ``a``."""
    p = p or Spelling()
    pairs = pair_frequency(phrases, words)
    cut = pairs.join(_rare(phrases, words, p).filter(F.length("word") >= 2).select(F.col("word").alias("b")), "b", "left_semi")
    begun = pairs.join(common_words(phrases, words, p).filter(F.length("word") > 2).select(F.col("word").alias("b")), "b", "left_semi")
    starts = F.transform(F.sequence(F.lit(2), F.length("b") - 1), lambda i: F.substring(F.col("b"), F.lit(1), i))
    begun = begun.select("a", F.col("b").alias("whole"), F.col("df").alias("whole_df"), F.explode(starts).alias("b"))
    order = Window.partitionBy("a", "b").orderBy(F.desc("whole_df"), F.desc("whole"))
    ranked = begun.withColumn("_k", F.row_number().over(order)).withColumn(
        "second", F.coalesce(F.lead("whole_df").over(order), F.lit(0)),
    ).filter("_k = 1")
    sure = (F.col("whole_df") >= F.greatest(F.lit(20), 10 * F.col("df"))) & (F.col("whole_df") >= 3 * F.col("second"))
    return cut.join(ranked, ["a", "b"]).filter(sure).select("a", "b", "whole")


def respell_all(phrases: DataFrame, row_id: str, words: str, p: Spelling | None = None) -> DataFrame:
    """(row_id, respelled, fixed) by all maps learnt from the phrases.

    From left to right a pair is joined, else a word is split; then typos are
    fixed, and last a cut-off last word is completed by the word before it, as
    typed or as fixed.
    """
    p = p or Spelling()
    fixes = C.checkpointed(typos(phrases, words, p))
    joined = C.checkpointed(joins(phrases, words, p).unionByName(rejoins(phrases, words, fixes, p)))
    halves, whole = C.checkpointed(splits(phrases, words, p)), C.checkpointed(completions(phrases, words, p))
    after = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    steps = F.zip_with(words, after, lambda a, b: F.struct(a.alias("word"), b.alias("next")))
    each = phrases.select(row_id, F.posexplode(steps).alias("at", "s")).select(row_id, "at", "s.word", "s.next")
    each = each.join(
        joined.select(F.col("a").alias("word"), F.col("b").alias("next"), "joined"), ["word", "next"], "left",
    ).join(halves, "word", "left")
    listed = each.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("at", "word", "joined", "a", "b"))).alias("l"))
    none = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"))

    def step(s: Column, x: Column) -> Column:
        here = F.when(x["joined"].isNotNull(), F.array(x["joined"])).when(x["a"].isNotNull(), F.array(x["a"], x["b"])).otherwise(F.array(x["word"]))
        return F.struct(
            F.when(s["skip"], s["out"]).otherwise(F.concat(s["out"], here)).alias("out"), (~s["skip"] & x["joined"].isNotNull()).alias("skip"),
        )

    spaced = listed.select(row_id, F.aggregate("l", none, step)["out"].alias("out"), F.transform("l", lambda x: x["word"]).alias("typed"))
    again = spaced.select(row_id, "typed", F.posexplode("out").alias("at", "word")).join(
        fixes.select(F.col("wrong").alias("word"), "right"), "word", "left",
    )
    fixed = again.groupBy(row_id).agg(
        F.first("typed").alias("typed"), F.array_sort(F.collect_list(F.struct("at", "word", F.coalesce("right", "word").alias("right")))).alias("l"),
    )
    last = lambda i, f: F.when(F.size("l") >= 2, F.get("l", F.size("l") + i)[f])
    ends = fixed.select(
        row_id, "typed", F.transform("l", lambda x: x["right"]).alias("w"), last(-2, "word").alias("a1"), last(-2, "right").alias("a2"),
        last(-1, "word").alias("b"),
    )
    for a, c in (("a1", "c1"), ("a2", "c2")):
        ends = ends.join(whole.select(F.col("a").alias(a), "b", F.col("whole").alias(c)), [a, "b"], "left")
    done = F.coalesce("c1", "c2")
    out = F.when(done.isNull(), F.col("w")).otherwise(F.concat(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.array(done)))
    return ends.withColumn("w", out).select(row_id, F.array_join("w", " ").alias("respelled"), (F.col("w") != F.col("typed")).alias("fixed"))


def respell(phrases: DataFrame, row_id: str, words: str, fixes: DataFrame) -> DataFrame:
    """(row_id, respelled, fixed): words with a fix replaced; a join on the word, so the fix table may be of any size."""
    each = phrases.select(row_id, F.posexplode(words).alias("at", "word"))
    joined = each.join(fixes.select(F.col("wrong").alias("word"), "right"), "word", "left")
    w = joined.groupBy(row_id).agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("right", "word").alias("w")))).alias("l"),
        F.max(F.col("right").isNotNull()).alias("fixed"),
    )
    return w.select(row_id, F.array_join(F.transform("l", lambda x: x["w"]), " ").alias("respelled"), "fixed")


def fluency(train: DataFrame, scored: DataFrame, row_id: str, words: str, weight: float = 0.8) -> DataFrame:
    """(row_id, fluency): mean log probability of the steps of a phrase, bigrams interpolated with add-one unigrams."""
    steps = lambda df, *more: df.select(*more, F.explode(_steps(words)).alias("p")).select(*more, "p.a", "p.b")
    t = steps(train)
    pair, left, right = t.groupBy("a", "b").agg(F.count("*").alias("n_ab")), t.groupBy("a").agg(F.count("*").alias("n_a")), t.groupBy("b").agg(F.count("*").alias("n_b"))
    size = right.agg(F.count("*").alias("vocabulary"), F.sum("n_b").alias("total"))  # one row
    x = steps(scored, row_id).join(pair, ["a", "b"], "left").join(left, "a", "left").join(right, "b", "left").crossJoin(F.broadcast(size))
    uni = (F.coalesce("n_b", F.lit(0)) + 1) / (F.col("total") + F.col("vocabulary") + 1)
    bi = F.when(F.col("n_a").isNotNull(), F.coalesce("n_ab", F.lit(0)) / F.col("n_a")).otherwise(0.0)
    return x.groupBy(row_id).agg(F.round(F.avg(F.log(weight * bi + (1 - weight) * uni)), 6).alias("fluency"))


def _steps(words: str) -> Column:
    marked = F.concat(F.array(F.lit("<s>")), F.col(words), F.array(F.lit("</s>")))
    n = F.size(words) + 1
    return F.zip_with(F.slice(marked, F.lit(1), n), F.slice(marked, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
