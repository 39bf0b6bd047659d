"""The whole keyword pipeline: ingest, spelling, routing, clusters, names, pillars, calendar, links, plan.

Each step is a function of DataFrames; steps between which a result is used
twice are checkpointed.  Configuration is a frozen dataclass.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import cluster as C
from ..operators import links as L
from ..operators import merge as M
from ..operators import planning as P
from ..operators import priors as Pr
from ..operators import scope as Sc
from ..operators import similarity as S
from ..operators import spelling as Sp


@dataclass(frozen=True)
class Config:
    """Options of the pipeline; facets are ordered (value, pattern) lists of one's own taxonomy."""

    similarity: float = 0.6
    overlap: int = 4
    weak: tuple[str, ...] = ("gift", "idea", "best", "for", "the", "in", "to", "a", "of")
    noise: tuple[tuple[str, str], ...] = (("account", r"\b(login|password|refund)\b"), ("local", r"\bnear me\b"), ("url", r"https?://|www\."))
    occasions: tuple[tuple[str, str], ...] = (
        ("christmas", r"\b(christmas|xmas)\b"), ("halloween", r"\bhalloween\b"), ("easter", r"\beaster\b"), ("thanksgiving", r"\bthanksgiving\b"),
    )
    recipients: tuple[tuple[str, str], ...] = (("mom", r"\b(mom|mum|mother)\b"), ("dad", r"\b(dad|father)\b"), ("teacher", r"\bteacher\b"))
    needs: tuple[tuple[str, str], ...] = (
        ("how_to", r"\bhow to\b"), ("copy_ideas", r"\b(what to write|wishes|messages|quotes)\b"), ("choose", r"\b(best|gifts?)\b"),
        ("inspire", r"\bideas?\b"), ("shop", r"\b(buy|cheap|sale|price)\b"),
    )
    max_words: int = 12
    non_ascii: float = 0.3
    min_volume: int = 0
    reach: float = 30.0
    least_pillar: int = 3
    scope: Sc.Scope = field(default_factory=lambda: Sc.Scope(known_class=1))
    max_group: int = 30
    spelling: Sp.Spelling = field(default_factory=Sp.Spelling)


def facet(norm, values: tuple[tuple[str, str], ...]):
    """The value whose pattern matches leftmost, in order of the list on ties; '' where none does."""
    at = [F.when(F.rlike(norm, F.lit(p)), F.struct(F.regexp_instr(norm, F.lit(p)).alias("at"), F.lit(i).alias("i"), F.lit(v).alias("v"))) for i, (v, p) in enumerate(values)]
    best = F.array_min(F.filter(F.array(*at), lambda x: x.isNotNull()))
    return F.coalesce(best["v"], F.lit(""))


def mask(norm, values: tuple[tuple[str, str], ...]):
    """The text without any match of a facet."""
    out = norm
    for _, p in values:
        out = F.regexp_replace(out, p, "  ")
    return out


def ingest(rows: DataFrame, c: Config, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(kept, excluded, log): sources merged, words respelled, facets found; one reason per excluded row; what decisions to keep or drop came to.

    Spelling is learnt from all rows before any filter; the language rule looks
    at the words as they were typed; rules and decisions are :mod:`operators.scope`'s.
    """
    keyed = rows.withColumn("join_key", T.join_key(F.col("keyword"))).withColumn("idx", F.monotonically_increasing_id())
    merged = C.checkpointed(M.merge_sources(keyed, ["market", "join_key"]).withColumn("id", F.xxhash64("market", "join_key")))
    words = merged.withColumn("typed", T.normal_form(F.col("join_key"))).withColumn("words", T.tokens(F.col("typed")))
    spelt = words.join(Sp.respell_all(words, "id", "words", c.spelling), "id", "left")
    x = spelt.withColumn("norm", F.coalesce("respelled", F.lit(""))).withColumn("keyword", F.col("join_key")).withColumn("prior", F.lit(False))
    masked = mask(F.col("norm"), c.occasions)
    x = x.withColumn("occasion", facet(F.col("norm"), c.occasions)).withColumn("recipient", facet(masked, c.recipients)).withColumn(
        "need", F.coalesce(F.nullif(facet(F.col("norm"), c.needs), F.lit("")), F.lit("info")),
    )
    log = None
    if decisions is not None:
        x, log = Sc.decided_at_ingest(x, decisions)
    else:
        x = x.withColumn("action", F.lit(None).cast("string")).withColumn("decision_id", F.lit(None).cast("string"))
    foreign = T.non_ascii_ratio(F.col("join_key")) > c.non_ascii
    noise = F.coalesce(
        F.when(F.col("norm") == "", "empty"), Sc.noise_reason(F.col("join_key"), F.col("typed"), F.col("norm"), list(c.noise), foreign),
        F.when(F.size("words") > c.max_words, "too long"),
    )
    x = Sc.scoped(x, replace(c.scope, min_volume=c.scope.min_volume or c.min_volume or None), noise)
    if log is not None:
        log = Sc.kept_log(x, log)
    kept, excluded = M.kept_and_excluded(x)
    tokens = T.canonical_tokens(F.col("norm"))
    kept = kept.withColumn("tokens", tokens).withColumn("tokset", T.word_set(F.col("tokens"))).withColumn(
        "core", C.core_names(T.canonical_tokens(mask(F.col("norm"), c.occasions)), list(c.weak)),
    )
    return kept.drop("keyword"), excluded.select("market", F.col("join_key").alias("keyword"), "volume", "reason", "src"), log


def clusters(kept: DataFrame, c: Config, results: DataFrame | None = None) -> DataFrame:
    """One row a keyword with its cluster, the cluster's name and roll-up; results (market, keyword, url) outrank words."""
    variants = M.merge_variants(
        kept.withColumn("vkey", T.variant_key(F.col("tokens"))).withColumn("o", F.col("id")), ["market", "vkey", "need", "occasion", "recipient"],
        "norm", "volume", "o",
    )
    base = variants.join(kept.select("id", "tokset", "core", "kd"), variants["o"] == F.col("id")).drop("o")
    base = C.checkpointed(base.withColumn("total", M.distinct_volume(F.col("volume"), F.col("variant_volumes"))))
    ranked = C.checkpointed(C.global_rank(base, [F.desc("total"), F.asc("norm"), F.asc("id")], "rank").select("id", "rank"))
    lexical = S.similar_pairs(base, "id", "tokset", ["market", "need", "occasion", "recipient"], c.similarity, list(c.weak))
    cores = base.select("id", "core")
    lexical = lexical.join(cores.select(F.col("id").alias("a"), F.col("core").alias("ca")), "a").join(cores.select(F.col("id").alias("b"), F.col("core").alias("cb")), "b").filter(
        N.cores_compatible(F.col("ca"), F.col("cb"))
    )
    edges = lexical.select("a", "b", F.lit(1).alias("tier"), F.round("similarity", 6).alias("score"))
    if results is not None:
        urls = results.select("market", T.decision_key(F.col("keyword")).alias("key"), T.canonical_url(F.col("url")).alias("url")).join(
            base.select("id", "market", T.decision_key(F.col("norm")).alias("key")), ["market", "key"],
        ).select("id", "market", "url").distinct()
        have = urls.select("id").distinct()
        shared = S.overlap_pairs(urls, "id", "url", c.overlap, ["market"]).select(
            "a", "b", F.lit(2).alias("tier"), F.col("shared").cast("double").alias("score"),
        )
        # where both sides have results, words don't join them
        both = edges.join(have.select(F.col("id").alias("a")), "a", "left_semi").join(
            have.select(F.col("id").alias("b")), "b", "left_semi",
        ).select("a", "b")
        edges = edges.join(both, ["a", "b"], "left_anti").unionByName(shared)
    placed = edges.join(ranked.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(
        ranked.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b",
    )
    first = F.col("ra") < F.col("rb")
    ordered = placed.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), "tier", "score",
    )
    seeds = C.leaders(ranked, ordered).select("id", "seed", "tier", "score")
    joined = F.when(F.col("tier") == 9, "seed").when(F.col("tier") == 2, F.concat(F.lit("serp:"), F.col("score").cast("long").cast("string"))).otherwise(
        F.concat(F.lit("lexical:"), F.format_number("score", 2))
    )
    return base.join(seeds, "id").withColumn("joined", joined).drop("tier", "score")


def named_clusters(members: DataFrame, c: Config) -> DataFrame:
    """Clusters with name, volumes, difficulty, fit and priority."""
    fluent = Sp.fluency(
        members.select(T.tokens(F.col("norm")).alias("words")), members.select("id", T.tokens(F.col("norm")).alias("words")), "id", "words",
    )
    x = members.join(fluent, "id").withColumn("phrase", F.col("norm")).withColumn("typo", F.lit(False))
    names = C.best_name(x, "seed")
    # a member that wins far more and asks the same names the page in its place
    plain = ~F.rlike("phrase", F.lit(r"[0-9]|\b(what|when|where|who|why|how|which)$"))
    rivals = x.join(names, "seed").select(
        "seed", "id", F.col("phrase").alias("keyword"), F.col("total").alias("volume"), N.winnable(
            F.col("total").cast("double"), F.col("kd"), c.reach,
        ).alias("winnable"), N.fit(F.col("kd"), c.reach).alias("fit"), "fluency", plain.alias("plain"), "core", (F.col("phrase") == F.col("name")).alias("is_seed")
    )
    easier = Pr.easier_seed(rivals, "seed").withColumnRenamed("name", "easier")
    names = names.join(easier, "seed", "left").select("seed", F.coalesce("easier", "name").alias("name"))
    roll = members.groupBy("seed").agg(
        F.first("market").alias("market"), F.first("need").alias("need"), F.first("occasion").alias("occasion"), F.first("recipient").alias("recipient"), F.sum("total").alias("volume"), F.sum(F.size("variants") + 1).alias("keywords"),
        F.min("kd").alias("kd"), F.bround(F.sum(N.winnable(F.col("total").cast("double"), F.col("kd"), c.reach)), 3).alias("winnable"),
    )
    out = roll.join(names, "seed").withColumn("fit", P.need_fit(F.col("need")))
    return out.withColumn("priority", P.priority(F.col("winnable"), F.col("fit"))).withColumn("words", T.word_set(T.canonical_tokens(F.col("name"))))


def plan(named: DataFrame, c: Config) -> DataFrame:
    """Pillars and posts: staged groups, hub by fewest extra facets and most winnable volume, slugs, buckets, numbers."""
    live = named.filter("fit <> 'low'")
    groups = C.staged_groups(live, "seed", [("occasion", ["market", "occasion"]), ("recipient", ["market", "recipient"])], c.least_pillar)
    x = live.join(groups, "seed").withColumn("pillar_id", F.when(F.col("stage") == "rest", "").otherwise(F.concat_ws(":", "stage", "group_key")))
    extra = (F.col("occasion") != "").cast("int") + (F.col("recipient") != "").cast("int")
    hub = F.row_number().over(
        Window.partitionBy("pillar_id").orderBy(
            F.desc((F.col("need").isin("choose", "inspire")).cast("int")), F.asc("extra"), F.desc("winnable"), F.asc("name"),
        )
    )
    x = x.withColumn("extra", extra).withColumn("role", F.when(F.col("pillar_id") == "", "standalone").when(hub == 1, "pillar").otherwise("cluster"))
    x = L.unique_slugs(x.withColumn("slug0", T.slugify(F.col("name"))), "slug0", [F.desc("priority"), F.asc("seed")])
    x = x.withColumn("post_type", P.post_type(F.col("need"), F.col("role") == "pillar", F.col("recipient"), F.lit("")))
    ordered = P.plan_order(x)
    ranked = C.global_rank(ordered, [F.desc("priority"), F.asc("stt")], "_r")
    n = ranked.agg(F.count("*").alias("_n"))
    return ranked.crossJoin(F.broadcast(n)).withColumn("bucket", C.bucket(F.col("_r"), F.col("_n"))).drop("_r", "_n", "slug0", "extra")


def link_rows(posts: DataFrame) -> DataFrame:
    """Internal links of a plan."""
    x = posts.select(
        "market", "slug", F.col("pillar_id").alias("pillar"), (F.col("role") == "pillar").alias("is_pillar"),
        F.col("priority").cast("double").alias("value"), "words", F.array("name").alias("anchors"),
    )
    return L.plan(x)


def run(rows: DataFrame, config: Config | None = None, results: DataFrame | None = None, decisions: DataFrame | None = None) -> dict[str, DataFrame]:
    """All outputs of the pipeline for typed keyword rows (see sources.tabular.typed)."""
    c = config or Config()
    kept, excluded, log = ingest(rows, c, decisions)
    kept = C.checkpointed(kept)
    members = C.checkpointed(clusters(kept, c, results))
    named = C.checkpointed(named_clusters(members, c))
    posts = C.checkpointed(plan(named, c))
    logged = {"decisions": log} if log is not None else {}
    return logged | {
        "keywords": members, "excluded": excluded, "clusters": named, "plan": posts, "links": link_rows(posts),
        "gaps": P.gaps(posts.filter("pillar_id <> ''"), "pillar_id", "need"),
    }
