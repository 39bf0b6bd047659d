"""Topic plan: post types, priorities, order, secondary keywords, limits, published posts, schedule, quality checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from . import similarity as S

#: How well each reader need suits a blog, and its weight in priorities.
NEED_FIT = {"shop": "low", "how_to": "high", "copy_ideas": "high", "choose": "high", "solve": "high", "inspire": "high", "info": "medium"}
FIT_WEIGHT = {"high": 1.0, "medium": 0.6, "low": 0.15}
#: Needs that a complete pillar answers; a bar separates alternatives.
EXPECTED_NEEDS = ("choose|inspire", "how_to", "info", "copy_ideas")


def need_fit(need: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in NEED_FIT.items() for x in kv])
    return F.coalesce(F.try_element_at(table, need), F.lit("medium"))


def priority(winnable: Column, fit: Column) -> Column:
    """Winnable volume times the fit's weight, rounded half to even."""
    weight = F.create_map(*[x for k, v in FIT_WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    return F.bround(winnable * F.coalesce(F.try_element_at(weight, fit), F.lit(0.6)), 1)


def post_type(need: Column, is_pillar: Column, recipient: Column, product: Column) -> Column:
    return (
        F.when(is_pillar, "pillar_hub").when(need == "how_to", "how_to").when(need == "copy_ideas", "copy_ideas").when(need == "solve", "how_to")
        .when(need == "choose", F.when(recipient != "", "gift_guide").otherwise("choose_guide")).when(
            need == "inspire", F.when(product != "", "gift_guide").otherwise("ideas_list"),
        ).otherwise("explainer")
    )


def gaps(posts: DataFrame, pillar: str, need: str) -> DataFrame:
    """(pillar, gaps): expected needs that no post of a pillar answers."""
    have = posts.groupBy(pillar).agg(F.collect_set(need).alias("_h"))  # as many values as there are needs
    wanted = F.array(*[F.lit(e) for e in EXPECTED_NEEDS])
    missing = F.filter(wanted, lambda e: ~F.arrays_overlap(F.split(e, r"\|"), F.col("_h")))
    return have.select(pillar, F.array_join(missing, ", ").alias("gaps"))


def plan_order(posts: DataFrame) -> DataFrame:
    """Pillars by volume, each followed by its posts by priority; loose posts last; ``stt`` numbers the plan."""
    total = F.sum("volume").over(Window.partitionBy("pillar_id"))
    x = posts.withColumn("_loose", (F.coalesce("pillar_id", F.lit("")) == "").cast("int")).withColumn(
        "_v", F.when(F.col("_loose") == 1, 0).otherwise(total),
    )
    from .cluster import global_rank

    order = [F.asc("_loose"), F.desc("_v"), F.asc("pillar_id"), F.desc((F.col("role") == "pillar").cast("int")), F.desc("priority"), F.asc("slug")]
    return global_rank(x, order, "stt").drop("_loose", "_v")


def secondary_keywords(keywords: DataFrame, most: int = 10, rephrasings: int = 3, new_share: float = 0.25) -> DataFrame:
    """(post, keyword, role): keywords by volume; a new angle brings more than a quarter of new content words.

    Columns post, keyword, volume, main, typo, words (content words).  The
    covered words grow along the scan, so a post is one group; a post has
    dozens of keywords.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["volume", "keyword"], ascending=[False, True])
        main = pdf["main"].iloc[0]
        covered = {w for k, ws in zip(pdf["keyword"], pdf["words"]) if k == main for w in ws}
        seen, out, taken, again = {frozenset(covered)}, [], 0, 0
        for k, ws, typo in zip(rows["keyword"], rows["words"], rows["typo"]):
            words = set(ws)
            role = "also covers"
            if k == main:
                role = "main"
            elif taken < most and frozenset(words) not in seen and not typo and len(k.split()) <= 8:
                fresh = words and len(words - covered) / len(words) > new_share
                if fresh or again < rephrasings:
                    role, taken, again = "secondary", taken + 1, again + (not fresh)
                    covered |= words
            seen.add(frozenset(words))
            out.append((pdf["post"].iloc[0], k, role))
        return pd.DataFrame(out, columns=["post", "keyword", "role"])

    return keywords.select("post", "keyword", "volume", "main", "typo", "words").groupBy("post").applyInPandas(
        pick, "post string, keyword string, role string",
    )


def limit_posts(posts: DataFrame, n: int) -> DataFrame:
    """(market, slug, kept): the best ``n`` posts of a market; a cluster whose pillar is not yet in costs two places.

    A plan holds hundreds of posts; the choice depends on what was chosen before, so a market is one group.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["priority", "slug"], ascending=[False, True])
        pillar_of = {p: s for p, s, r in zip(pdf["pillar_id"], pdf["slug"], pdf["role"]) if r == "pillar"}
        kept: set[str] = set()
        for s, p, r in zip(rows["slug"], rows["pillar_id"], rows["role"]):
            need = {s} | ({pillar_of[p]} if r != "pillar" and p in pillar_of else set())
            if len(kept | need) <= n:
                kept |= need
        return pd.DataFrame({"market": pdf["market"], "slug": pdf["slug"], "kept": pdf["slug"].isin(kept)})

    return posts.select("market", "slug", "pillar_id", "role", "priority").groupBy("market").applyInPandas(
        choose, "market string, slug string, kept boolean",
    )


def budgeted_checks(pairs: DataFrame, budget: int) -> DataFrame:
    """(market, a, b): pairs by the smaller volume; a pair is taken while the keywords to look up stay within the budget."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.assign(low=pdf[["va", "vb"]].min(axis=1)).sort_values(["low", "a", "b"], ascending=[False, True, True])
        chosen: set[str] = set()
        out = []
        for a, b in zip(rows["a"], rows["b"]):
            if len(chosen | {a, b}) <= budget:
                chosen |= {a, b}
                out.append((pdf["market"].iloc[0], a, b))
        return pd.DataFrame(out, columns=["market", "a", "b"])

    return pairs.select("market", "a", "b", "va", "vb").groupBy("market").applyInPandas(pick, "market string, a string, b string")


def schedule(posts: DataFrame, today: Column) -> DataFrame:
    """Writing order: due soon, late, on time, without a date rule, evergreen; then bucket, score, number."""
    days = F.datediff("deadline", today)
    state = F.when(
        F.col("deadline").isNull(), F.when(F.col("occasion") != "", "no date rule").otherwise("evergreen"),
    ).when(days < 0, "late").when(days <= 14, "due soon").otherwise("on time")
    rank = F.element_at(
        F.create_map(*[x for i, s in enumerate(("due soon", "late", "on time", "no date rule", "evergreen")) for x in (F.lit(s), F.lit(i))]), state,
    )
    from .cluster import global_rank

    x = posts.withColumn("timing", state).withColumn("_r", rank)
    return global_rank(x, [F.asc("_r"), F.asc("bucket"), F.desc("priority"), F.asc("stt")], "work_order").drop("_r")


def published_matches(posts: DataFrame, published: DataFrame, same: float = 0.75, part: float = 0.75, related: int = 3) -> DataFrame:
    """(slug, url, kind): each published post is ``same`` for one planned post at most; else part or related.

    Columns slug / url and words (array).  Equal word sets or Jaccard from
    ``same`` make a candidate; both sides keep their best; a published post that
    holds enough of a planned one's words is part of it; others are related by
    shared words, the best few.
    """
    a = posts.select("slug", F.col("words").alias("wa"), F.explode("words").alias("w"))
    b = published.select("url", F.col("words").alias("wb"), F.explode("words").alias("w"))
    pairs = a.join(b, "w").groupBy("slug", "url").agg(F.first("wa").alias("wa"), F.first("wb").alias("wb"), F.count("*").alias("shared"))
    x = pairs.withColumn("j", N.jaccard(F.col("wa"), F.col("wb"))).withColumn("inside", F.col("shared") / F.size("wa"))
    best_post = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("j"), "slug"))
    best_url = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("j"), "url"))
    x = x.withColumn("_p", best_post).withColumn("_u", best_url)
    kind = F.when((F.col("j") >= same) & (F.col("_p") == 1) & (F.col("_u") == 1), "same").when(F.col("inside") >= part, "part").otherwise("related")
    x = x.withColumn("kind", kind).withColumn("_k", F.row_number().over(Window.partitionBy("slug", "kind").orderBy(F.desc("j"), "url")))
    return x.filter((F.col("kind") != "related") | (F.col("_k") <= related)).select("slug", "url", "kind", F.round("j", 6).alias("similarity"))


def duplicate_slugs(published: DataFrame) -> DataFrame:
    return published.groupBy(T.url_slug(F.col("url")).alias("slug")).agg(
        F.count("*").alias("posts"), F.min("url").alias("first_url"),
    ).filter("posts > 1")


def quality_checks(
    posts: DataFrame, links: DataFrame, year: int, overlap: float = 0.67, overloaded: int = 100, weak: int = 500, hard: float = 70.0,
) -> DataFrame:
    """(check, slug, detail): overlap of titles, stale years, long slugs, overloaded, weak and hard posts, thin links."""
    pairs = S.similar_pairs(posts.select("slug", "market", "words"), "slug", "words", ["market"], overlap)
    over = pairs.select(F.lit("overlap").alias("check"), F.col("a").alias("slug"), F.col("b").alias("detail"))
    inbound = links.groupBy(F.col("target").alias("slug")).agg(F.countDistinct("source").alias("_in"))
    x = posts.join(inbound, "slug", "left")
    rules = [
        ("stale year", T.stale_year(F.col("keyword"), year), F.col("keyword")), ("long slug", F.length("slug") > 60, F.length("slug").cast("string")), (
            "overloaded", F.col("keywords") > overloaded, F.col("keywords").cast("string"),
        ),
        ("weak", F.col("volume") < weak, F.col("volume").cast("string")), ("hard", F.col("kd") > hard, F.col("kd").cast("string")), (
            "thin links", F.coalesce("_in", F.lit(0)) < 2, F.coalesce("_in", F.lit(0)).cast("string"),
        ),
    ]
    found = F.filter(
        F.array(*[F.when(hit, F.struct(F.lit(n).alias("check"), F.col("slug").alias("slug"), d.alias("detail"))) for n, hit, d in rules]),
        lambda f: f.isNotNull(),
    )
    return over.unionByName(x.select(F.explode(found).alias("f")).select("f.*"))


def research(keywords: DataFrame, themes: list[tuple[str, str]], thin: int = 3) -> DataFrame:
    """(topic, theme, hits, volume, state): whether each topic's keywords cover each theme (a pattern); themes are configuration."""
    rows = F.array(*[F.struct(F.lit(n).alias("theme"), F.rlike("norm", F.lit(p)).alias("hit")) for n, p in themes])
    x = keywords.select("topic", "volume", F.explode(rows).alias("t")).groupBy("topic", F.col("t.theme").alias("theme")).agg(
        F.count_if("t.hit").alias("hits"), F.sum(F.when(F.col("t.hit"), F.col("volume")).otherwise(0)).alias("volume"),
    )
    return x.withColumn("state", F.when(F.col("hits") == 0, "missing").when(F.col("hits") < thin, "thin").otherwise("covered"))


def briefs(posts: DataFrame, links: DataFrame) -> DataFrame:
    """(slug, brief): one Markdown brief a post, from its row, keywords and links; a projection after two joins."""
    out = links.groupBy(F.col("source").alias("slug")).agg(
        F.array_sort(F.collect_list(F.concat(F.lit("- ["), "anchor", F.lit("](/"), "target", F.lit(")")))).alias("_l")
    )
    x = posts.join(out, "slug", "left")
    lines = [
        F.concat(F.lit("# "), F.initcap("keyword")), F.concat(F.lit("Post type: "), "post_type"), F.concat(F.lit("Market: "), "market"), F.concat(
            F.lit("Volume: "), F.col("volume").cast("string"),
        ),
        F.concat(F.lit("## Keywords\n"), F.array_join(F.transform("secondary", lambda s: F.concat(F.lit("- "), s)), "\n")), F.concat(
            F.lit("## Internal links\n"), F.array_join(F.coalesce("_l", F.array().cast("array<string>")), "\n"),
        ),
    ]
    return x.select("slug", F.concat_ws("\n\n", *lines).alias("brief"))


def post_titles(keyword: Column, kind: Column, market: Column) -> Column:
    """Working title of a pillar or post by its type; British spelling of "personalised" in the uk market."""
    name = F.initcap(keyword)
    title = (
        F.when(kind == "pillar_hub", F.concat(name, F.lit(": The Complete Guide"))).when(kind == "how_to", F.concat(F.lit("How To: "), name)).when(
            kind == "gift_guide", F.concat(name, F.lit(" They Will Love")),
        )
        .when(kind == "copy_ideas", F.concat(name, F.lit(": What To Write"))).when(
            kind.isin("choose_guide", "ideas_list"), F.concat(name, F.lit(": Ideas And How To Choose")),
        ).otherwise(F.concat(name, F.lit(" Explained")))
    )
    return F.when(market == "uk", F.regexp_replace(title, "ersonaliz", "ersonalis")).otherwise(title)


def template_sections(texts: DataFrame) -> DataFrame:
    """(post_type, position, section): the second-level headings of Markdown templates, in order."""
    return texts.select("post_type", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^## +(.+?)\s*$"), 1)).alias("position", "section"))


def review_rows(posts: DataFrame, members: DataFrame, issues: DataFrame) -> DataFrame:
    """One row a post: its keywords, owned volume, greatest keyword, share verified, and its open issues."""
    owned = members.groupBy("slug").agg(
        F.count("*").alias("keyword_count"), F.sum("volume").alias("owned_volume"),
        F.max_by("keyword", F.struct("volume", "keyword")).alias("biggest_keyword"),
    )
    found = members.select("slug", "market", F.col("keyword").alias("k")).join(
        issues.select("market", F.col("keyword").alias("k"), "issue_id", "check"), ["market", "k"],
    )
    listed = found.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "issue_id", "check"))), "; ").alias("issues"))  # a post has dozens of keywords
    return posts.join(owned, "slug", "left").join(listed, "slug", "left").na.fill({"keyword_count": 0, "owned_volume": 0, "issues": ""})


def issue_status(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Issues with the decision that answers them: by issue id, else by keyword and target, else by keyword and action."""
    d = decisions.select(
        "decision_id", "source_issue", "market", F.col("keyword").alias("dk"), F.col("target").alias("dt"), F.col("action").alias("da"), "status",
    )
    one = issues.join(d.filter("coalesce(source_issue, '') <> ''").select(F.col("source_issue").alias("issue_id"), F.lit(1).alias("by"), "decision_id", "status"), "issue_id").select(
        "issue_id", "by", "decision_id", "status",
    )
    base = issues.select("issue_id", "market", F.col("keyword").alias("dk"), F.col("other").alias("dt"), F.col("action").alias("da"))
    two = base.join(d, ["market", "dk", "dt"]).select("issue_id", F.lit(2).alias("by"), "decision_id", "status")
    three = base.join(d, ["market", "dk", "da"]).select("issue_id", F.lit(3).alias("by"), "decision_id", "status")
    best = one.unionByName(two).unionByName(three).groupBy("issue_id").agg(
        F.min_by(F.struct("decision_id", "status"), F.struct("by", "decision_id")).alias("d")
    )
    return issues.join(best, "issue_id", "left").select(
        *issues.columns, F.coalesce("d.status", F.lit("open")).alias("state"), F.col("d.decision_id").alias("decision_id"),
    )


def left_out(clusters: DataFrame, scope: DataFrame, posts: DataFrame, most: int = 300) -> DataFrame:
    """Clusters that are not planned with the nearest post, the greatest ``most`` (a report), and one row for what scope excluded."""
    out = clusters.filter(F.col("role").isin("backlog", "skip"))
    near = S.nearest(out, "name", posts, "slug", "words", ["market"]).select(F.col("a").alias("name"), F.col("b").alias("nearest"))
    listed = out.join(near, "name", "left").select(
        "market", "name", "volume", F.col("role").alias("reason"), "nearest",
    ).orderBy(F.desc("volume"), "name").limit(most)
    reasons = scope.groupBy("reason").agg(F.count("*").alias("n"), F.sum("volume").alias("v"))  # as many rows as there are reasons
    total = reasons.agg(
        F.sum("n").alias("n"), F.sum("v").alias("volume"),
        F.array_join(
            F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "reason"))), 1, 4), lambda x: x["reason"]), ", ",
        ).alias("reason"),
    )
    return listed.unionByName(
        total.select(
            F.lit("").alias("market"), F.format_string("%d keywords out of scope", "n").alias("name"), "volume", "reason",
            F.lit(None).cast("string").alias("nearest"),
        )
    )


def given_pillars(clusters: DataFrame, least: int = 1, switch: float = 1.5) -> DataFrame:
    """Pillars taken over from a grouped file: the given hub leads, unless another cluster of the pillar wins 1.5 times as much."""
    w = Window.partitionBy("market", "pillar")
    given = F.max(F.when(F.col("is_given_hub"), F.col("winnable"))).over(w)
    best = F.row_number().over(w.orderBy(F.desc("winnable"), "name"))
    x = clusters.filter("coalesce(pillar, '') <> ''").withColumn("_g", given).withColumn("_k", best).withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= least)
    top = F.max(F.when(F.col("_k") == 1, F.col("winnable"))).over(w)
    x = x.withColumn("_top", top)
    lead = F.when(F.col("_g").isNull() | (F.col("_top") >= switch * F.col("_g")), F.col("_k") == 1).otherwise(F.col("is_given_hub"))
    return x.withColumn("is_hub", lead).drop("_g", "_k", "_n", "_top")


def keep_groups_apart(posts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Merges undone where results told the two apart: a merged post comes back when its target is on its list (a, b)."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    hit = posts.join(both, (F.col("slug") == F.col("a")) & (F.col("merged_into") == F.col("b")), "left")
    return hit.withColumn(
        "merged_into", F.when(F.col("a").isNotNull(), None).otherwise(F.col("merged_into")),
    ).withColumn("kept_apart", F.col("a").isNotNull()).drop("a", "b")
