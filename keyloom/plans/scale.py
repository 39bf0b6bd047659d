"""The clustering steps over generated keywords, for timing at a stated number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cluster as C
from ..operators import similarity as S

#: Vocabularies and templates of the generator.
OCCASIONS = ("christmas", "halloween", "easter", "thanksgiving", "birthday", "anniversary", "graduation", "wedding", "retirement", "valentines day")
RECIPIENTS = ("mom", "dad", "grandma", "sister", "teacher", "nurse", "boss", "friend", "wife", "husband", "kids", "coworkers")
INTERESTS = (
    "fishing", "gardening", "dogs", "cats", "golf", "camping", "reading", "cooking", "yoga", "hiking", "coffee", "music", "gaming", "running",
)
PRODUCTS = ("mugs", "shirts", "blankets", "candles", "ornaments", "pillows", "posters", "cards", "bags", "hats", "keychains", "notebooks")
STYLES = ("funny", "personalized", "unique", "cheap", "handmade", "vintage", "cute", "luxury", "small", "rustic")
TEMPLATES = (
    "{o} gifts for {r}", "{s} {o} {p}", "{p} for {r}", "{s} gifts for {i} lovers", "{o} {p} for {r}", "best {s} {p} for {i} fans", "{r} {i} {p}",
    "{o} ideas for {r}", "{s} {p} for {r} who love {i}", "what to write in {o} {p} for {r}",
)
WEAK = ["gift", "idea", "best", "for", "the", "in", "to", "who", "what"]


def generated_keywords(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(id, market, keyword, volume, kd): templates filled by hashes of the row number, volumes heavy-tailed."""

    def pick(values: tuple[str, ...], salt: int):
        h = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(values)))
        return F.element_at(F.array(*[F.lit(v) for v in values]), (h + 1).cast("int"))

    parts = {"o": pick(OCCASIONS, 1), "r": pick(RECIPIENTS, 2), "i": pick(INTERESTS, 3), "p": pick(PRODUCTS, 4), "s": pick(STYLES, 5)}
    phrase = pick(TEMPLATES, 6)
    for k, v in parts.items():
        phrase = F.replace(phrase, F.lit("{" + k + "}"), v)
    u = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(7)), F.lit(1_000_000)) + 1) / 1_000_001.0
    volume = F.floor(F.lit(10.0) / F.pow(u, F.lit(0.8))).cast("long")
    kd = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(8)), F.lit(76)) + 5).cast("double")
    return spark.range(n).select("id", F.lit("us").alias("market"), phrase.alias("keyword"), volume.alias("volume"), kd.alias("kd"))


def cluster_keywords(rows: DataFrame, least: float = 0.6) -> DataFrame:
    """Normalise, merge variants, join similar phrases, cluster by leaders: (id, seed, tier, score) by rank of volume."""
    norm = T.normal_form(F.col("keyword"))
    words = rows.select("id", "market", norm.alias("norm"), T.canonical_tokens(norm).alias("t"), "volume")
    variants = words.groupBy("market", T.variant_key(F.col("t")).alias("vkey")).agg(
        F.max_by("norm", F.struct("volume", "norm")).alias("id"), F.sum("volume").alias("volume"), F.first("t").alias("t"),
    )
    named = C.checkpointed(
        variants.select(
            "market", "id", "volume", T.word_set(F.col("t")).alias("words"),
            F.array_join(F.array_sort(F.array_distinct(F.filter("t", lambda x: x.isin(*OCCASIONS)))), "|").alias("guard"),
        )
    )
    ranked = C.checkpointed(C.global_rank(named, [F.desc("volume"), F.asc("id")], "rank").select("rank", "market", "guard", "words"))
    pairs = S.similar_pairs(ranked, "rank", "words", ["market", "guard"], least, WEAK)
    edges = pairs.select("a", "b", F.lit(1).alias("tier"), F.round("similarity", 6).alias("score"))
    return C.leaders(ranked.select(F.col("rank").alias("id"), "rank"), edges)
