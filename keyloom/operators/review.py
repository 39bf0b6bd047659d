"""Reviewing a grouping: back-checks with stable ids, audit of an existing grouping, decisions as data."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from . import similarity as S

ISSUE = ["check", "severity", "market", "keyword", "other", "volume", "action"]


def _issue(df: DataFrame, check: str, severity: str, action: str, other: str = "''") -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"), "market", "keyword", F.expr(other).alias("other"),
        F.col("volume").cast("long").alias("volume"), F.lit(action).alias("action"),
    )


def back_check(members: DataFrame, results: DataFrame | None = None, least: int = 4, mixed_share: float = 0.2, main_ratio: float = 2.0) -> DataFrame:
    """Issues of a grouping; ids don't depend on row order.

    Columns of ``members``: market, group, keyword, is_main, volume, kd, need,
    parent, words (array).  Checks: duplicate_across_groups,
    secondary_is_other_main (by shared results, then the parent topic, then
    equal words), weak_member, need_conflict within a group (mixed_intent),
    no_data, main_not_best, shopping_main, same_question_groups,
    ungrouped_high_volume.  ``results`` holds (market, keyword, url).
    """
    m = members.withColumn("key", T.decision_key(F.col("keyword"))).withColumn("wkey", F.array_join("words", " "))
    grouped = m.filter("coalesce(group, '') <> ''")
    mains = grouped.filter("is_main").select(
        "market", F.col("group").alias("mgroup"), F.col("keyword").alias("main"), F.col("key").alias("mkey"), F.col("wkey").alias("mwords"),
        F.col("volume").alias("mvolume"), F.col("need").alias("mneed"),
    )
    # one keyword in several groups: the greatest main keeps it
    several = grouped.groupBy("market", "key").agg(
        F.countDistinct("group").alias("n"), F.min("keyword").alias("keyword"), F.max("volume").alias("volume"),
        F.array_join(F.array_sort(F.collect_set("group")), "|").alias("other"),
    ).filter("n > 1")
    out = [_issue(several, "duplicate_across_groups", "high", "move_keyword", "other")]
    rest = grouped.filter("not is_main").join(several.select("market", "key"), ["market", "key"], "left_anti")
    evidence = []
    if results is not None:
        urls = results.withColumn("key", T.decision_key(F.col("keyword"))).select(
            "market", "key", T.canonical_url(F.col("url")).alias("url"),
        ).distinct()
        own = rest.select("market", "key", "group").join(urls, ["market", "key"])
        other = mains.join(urls.withColumnRenamed("key", "mkey"), ["market", "mkey"]).select("market", "mgroup", "main", "url")
        shared = own.join(other, ["market", "url"]).groupBy("market", "key", "group", "mgroup", "main").agg(F.count("*").alias("n"))
        w = Window.partitionBy("market", "key", "group")
        mine = F.max(F.when(F.col("mgroup") == F.col("group"), F.col("n"))).over(w)
        best = shared.withColumn("mine", F.coalesce(mine, F.lit(0))).filter(F.col("mgroup") != F.col("group")).withColumn(
            "_k", F.row_number().over(w.orderBy(F.desc("n"), "main")),
        ).filter("_k = 1")
        strong = best.filter(F.col("n") >= least).select("market", "key", "group", "main", F.lit(1).alias("rank"))
        weak = best.filter((F.col("mine") < least) & (F.col("n") >= least)).select("market", "key", "group", F.col("main").alias("weak_for"))
        evidence.append(strong)
        out.append(_issue(rest.join(weak, ["market", "key", "group"]), "weak_member", "medium", "move_keyword", "weak_for"))
    by_parent = rest.filter("coalesce(parent, '') <> ''").withColumn("pkey", T.decision_key(F.col("parent"))).join(
        mains.select("market", F.col("mkey").alias("pkey"), "mgroup", "main"), ["market", "pkey"],
    ).filter("mgroup <> group and pkey <> key")
    evidence.append(by_parent.select("market", "key", "group", "main", F.lit(2).alias("rank")))
    by_words = rest.join(
        mains.select("market", F.col("mwords").alias("wkey"), "mgroup", "main"), ["market", "wkey"],
    ).filter("mgroup <> group and wkey <> ''")
    evidence.append(by_words.select("market", "key", "group", "main", F.lit(3).alias("rank")))
    found = evidence[0]
    for e in evidence[1:]:
        found = found.unionByName(e)
    first = found.groupBy("market", "key", "group").agg(F.min_by("main", F.struct("rank", "main")).alias("main"))
    out.append(_issue(rest.join(first, ["market", "key", "group"]), "secondary_is_other_main", "high", "merge", "main"))
    w = Window.partitionBy("market", "group")
    g = grouped.withColumn("gv", F.sum("volume").over(w)).withColumn("top", F.max("volume").over(w)).withColumn("mainneed", F.max(F.when(F.col("is_main"), F.col("need"))).over(w)).withColumn(
        "mainvol", F.max(F.when(F.col("is_main"), F.col("volume"))).over(w),
    )
    mixed = g.groupBy("market", "group").agg(F.sum(F.when(F.col("need") != F.col("mainneed"), F.col("volume")).otherwise(0)).alias("apart"), F.max("gv").alias("gv"), F.max(F.when(F.col("is_main"), F.col("keyword"))).alias("keyword"), F.max("gv").alias("volume")).filter(
        F.col("apart") >= mixed_share * F.col("gv")
    ).filter("gv > 0 and keyword is not null")
    out.append(_issue(mixed, "mixed_intent", "medium", "split"))
    out.append(_issue(g.filter("is_main and gv = 0"), "no_data", "low", ""))
    out.append(
        _issue(
            g.filter(F.col("is_main") & (F.col("top") >= main_ratio * F.col("volume")) & (F.col("top") > 0)), "main_not_best", "medium",
            "rename_main",
        )
    )
    out.append(_issue(g.filter("is_main and need = 'shop'"), "shopping_main", "high", "set_need"))
    same = mains.alias("x").join(mains.alias("y"), ["market", "mwords"]).filter(
        "x.mgroup <> y.mgroup and (x.mvolume > y.mvolume or (x.mvolume = y.mvolume and x.main < y.main)) and mwords <> ''"
    )
    out.append(
        _issue(
            same.select("market", F.col("y.main").alias("keyword"), F.col("x.main").alias("other"), F.col("y.mvolume").alias("volume")),
            "same_question_groups", "high", "merge", "other",
        )
    )
    floor = mains.filter("mvolume > 0").groupBy("market", "mvolume").agg(F.count("*").alias("n"))
    upto = floor.withColumn("upto", F.sum("n").over(Window.partitionBy("market").orderBy("mvolume"))).withColumn(
        "total", F.sum("n").over(Window.partitionBy("market")),
    )
    median = upto.filter(F.col("upto") >= F.floor(F.col("total") / 2) + 1).groupBy("market").agg(F.min("mvolume").alias("floor"))
    loose = m.filter("coalesce(group, '') = ''").join(median, "market").filter("volume >= floor")
    out.append(_issue(loose, "ungrouped_high_volume", "medium", "move_keyword"))
    issues = out[0]
    for o in out[1:]:
        issues = issues.unionByName(o)
    return issues.withColumn(
        "issue_id", N.issue_id(F.col("check"), F.col("market"), F.col("keyword"), F.col("other"), T.decision_key),
    ).dropDuplicates(["issue_id"])


def proposals(issues: DataFrame) -> DataFrame:
    """One proposed decision for each issue that names an action; marked so, and never applied as it is."""
    return issues.filter("action <> ''").select(
        F.concat(F.lit("P-"), "issue_id").alias("decision_id"), "action", "market", "keyword", F.col("other").alias("target"),
        F.lit("").alias("value"), F.lit("proposed").alias("reason"), F.col("check").alias("evidence"), F.col("issue_id").alias("source_issue"),
        F.lit("proposal").alias("author"),
    )


#: The audit's findings, with what each does.
FINDINGS = {
    "same_query": "merged", "serp_apart": "kept_apart", "duplicate": "removed", "shop_member": "split", "main_changed": "main_changed", "segment_modifier": "kept_apart", "tone_variant": "merged",
    "possible_duplicate": "check_serp", "same_question": "merged", "export_topic": "added", "noise_flag": "kept",
}
_YEAR = r"\b(19|20)[0-9]{2}\b"


def _finding(df: DataFrame, name: str, other: str = "''") -> DataFrame:
    return df.select(
        "market", "keyword", "group", F.lit(name).alias("finding"), F.lit(FINDINGS[name]).alias("action"),
        F.expr(other).cast("string").alias("other"),
    )


def better_mains(
    members: DataFrame, volume_ratio: float = 2.0, win_ratio: float = 1.25, win_least: float = 50.0, year_share: float = 0.2, reach: float = 30.0,
) -> DataFrame:
    """Groups whose main another member should be: (market, keyword, group, other), keyword the present main.

    A main with a year gives way to a member that holds all its other words
    without one, from a fifth of its volume on.  Else the first by winnable
    volume of the plain members that ask the same thing (its words hold the
    main's, in the same order, eight at most) with twice the volume, or, where the
    main is hard to rank for, an easier one that wins a quarter more and 50 at least.
    """
    mains = members.filter("is_main").select("market", "group", F.struct("keyword", "volume", "kd", F.col("words").alias("words")).alias("m"))
    x = members.filter("not is_main").join(mains, ["market", "group"])
    words, own = F.col("words"), F.col("m.words")
    undated = lambda w: F.filter(w, lambda t: ~F.rlike(t, F.lit("^(19|20)[0-9]{2}$")))
    dated = F.rlike("m.keyword", F.lit(_YEAR))
    volume, top = F.col("volume"), F.col("m.volume")
    holds = F.size(F.array_except(undated(own), words)) == 0
    plain = ~F.rlike("keyword", F.lit(r"[0-9]")) & (F.size(F.split("keyword", " ")) <= 8)
    evergreen = dated & ~F.rlike("keyword", F.lit(_YEAR)) & holds & (volume >= top * year_share)
    win, won = N.winnable(volume.cast("double"), F.col("kd"), reach), N.winnable(top.cast("double"), F.col("m.kd"), reach)
    larger = volume >= F.greatest(top, F.lit(1)) * volume_ratio
    hard = N.fit_label(F.col("m.kd"), reach) != "easy"
    easier = hard & (N.fit(F.col("kd"), reach) > N.fit(F.col("m.kd"), reach)) & (win >= won * win_ratio) & (win - won >= win_least)
    asks = ~dated & plain & holds & S.shared_order(words, own)
    able = x.withColumn("_win", win).filter(evergreen | (asks & (larger | easier)))
    first = F.row_number().over(Window.partitionBy("market", "group").orderBy(F.desc("_win"), F.desc("volume"), "keyword"))
    return able.withColumn("_k", first).filter("_k = 1").select(
        "market", F.col("m.keyword").alias("keyword"), "group", F.col("keyword").alias("other"),
    )


def closest_groups(mains: DataFrame, close: float) -> DataFrame:
    """For each group that is close to a greater one, the closest (the greater on ties): (market, keyword, group, words, other, other_words, similarity)."""
    ids = mains.withColumn("id", F.concat_ws("|", "market", "group"))
    pairs = S.similar_pairs(
        ids.select("id", "market", F.array_distinct("words").alias("words")), "id", "words", ["market"], close,
    ).filter("similarity < 1").select("a", "b", "similarity")
    both = pairs.select(
        F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "similarity",
    ).select("p.a", "p.b", "similarity")
    side = lambda c, p: ids.select(F.col("id").alias(c), F.struct("market", "keyword", "group", "words", "volume").alias(p))
    x = both.join(side("a", "x"), "a").join(side("b", "y"), "b").filter("x.volume < y.volume or (x.volume = y.volume and x.group > y.group)")
    first = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("similarity", 9)), F.desc("y.volume"), "y.group"))
    return x.withColumn("_k", first).filter("_k = 1").select(
        "x.market", "x.keyword", "x.group", "x.words", F.col("y.keyword").alias("other"), F.col("y.words").alias("other_words"), "similarity",
    )


def audit_grouping(
    members: DataFrame, close: float = 0.6, results: DataFrame | None = None, free: DataFrame | None = None, least: int = 4,
    tones: tuple[str, ...] = (), lists: tuple[str, ...] = (), noise: str | None = None, most_topics: int = 30,
) -> DataFrame:
    """(market, keyword, group, finding, action, other): what an existing grouping gets wrong, from its mains and members.

    Columns of ``members``: market, group, keyword, is_main, volume, kd, need,
    words.  Findings: same_query (two mains with one variant key, or that share
    ``least`` results), serp_apart (mains close in words whose results differ),
    duplicate (a keyword in two groups), shop_member, main_changed
    (:func:`better_mains`), the closest greater group of each as segment_modifier,
    tone_variant or possible_duplicate by what sets them apart, noise_flag (a
    member that the pattern ``noise`` matches), and for keywords in no group
    (``free``: market, keyword, volume, need, words) same_question or, the
    greatest of the rest, export_topic.  ``results`` holds (market, keyword, url).
    """
    m = members.filter("coalesce(group, '') <> ''").withColumn("vkey", T.variant_key(F.col("words")))
    mains = m.filter("is_main")
    w = Window.partitionBy("market", "vkey").orderBy(F.desc("volume"), "keyword", "group")
    ranked = mains.withColumn("_k", F.row_number().over(w)).withColumn("_first", F.first("keyword").over(w))
    out = [_finding(ranked.filter("_k > 1"), "same_query", "_first")]
    lost = ranked.filter("_k > 1").select("market", "group")
    if results is not None:
        urls = results.select("market", "keyword", T.canonical_url(F.col("url")).alias("url")).distinct()
        own = mains.join(urls, ["market", "keyword"]).select("market", "group", "url").distinct()
        ids = own.withColumn("id", F.concat_ws("|", "market", "group"))
        shared = S.overlap_pairs(ids, "id", "url", 1, ["market"]).select("a", "b", "shared")
        side = lambda c, p: mains.select(F.concat_ws("|", "market", "group").alias(c), F.struct("market", "keyword", "group", "volume", "words").alias(p))
        has = ids.select("id").distinct()
        near = S.similar_pairs(
            mains.withColumn("id", F.concat_ws("|", "market", "group")).join(has, "id", "left_semi").select(
                "id", "market", F.array_distinct("words").alias("words"),
            ),
            "id", "words", ["market"], close,
        ).select("a", "b")
        pairs = near.join(shared, ["a", "b"], "full").withColumn(
            "shared", F.coalesce("shared", F.lit(0)),
        ).join(side("a", "x"), "a").join(side("b", "y"), "b")
        smaller = F.when((F.col("x.volume") < F.col("y.volume")) | ((F.col("x.volume") == F.col("y.volume")) & (F.col("x.group") > F.col("y.group"))), F.struct("x", "y")).otherwise(
            F.struct(F.col("y").alias("x"), F.col("x").alias("y"))
        )
        told = pairs.select("shared", smaller.alias("p"), N.close_words(F.col("x.words"), F.col("y.words")).alias("close")).select(
            "shared", "close", "p.x.market", "p.x.keyword", "p.x.group", F.col("p.y.keyword").alias("with"), F.col("p.y.volume").alias("v"),
        )
        merged = told.filter(F.col("shared") >= least).withColumn(
            "_k", F.row_number().over(Window.partitionBy("market", "group").orderBy(F.desc("shared"), F.desc("v"), "with")),
        ).filter("_k = 1").join(lost, ["market", "group"], "left_anti")
        out.append(_finding(merged, "same_query", "with"))
        out.append(_finding(told.filter((F.col("shared") < least) & F.col("close")), "serp_apart", "with"))
        lost = lost.unionByName(merged.select("market", "group"))
    v = Window.partitionBy("market", "vkey").orderBy(F.desc("is_main"), F.desc("volume"), "group", "keyword")
    dup = m.withColumn("_k", F.row_number().over(v)).withColumn("_first", F.first("group").over(v)).filter(F.col("_k") > 1).filter(F.col("group") != F.col("_first"))
    out.append(_finding(dup.filter("not is_main"), "duplicate", "_first"))
    out.append(_finding(m.filter("need = 'shop' and not is_main"), "shop_member"))
    out.append(_finding(better_mains(m), "main_changed", "other"))
    near = closest_groups(mains.join(lost, ["market", "group"], "left_anti").filter("need <> 'shop'"), close)
    near = near.withColumn("kind", N.modifier_kind(F.col("words"), F.col("other_words"), list(tones), list(lists)))
    is_list = F.size(F.array_intersect(F.array_intersect("words", "other_words"), F.array(*[F.lit(x) for x in lists]).cast("array<string>"))) > 0
    tone = (F.col("kind") == "list_tone") | ((F.col("kind") == "tone") & is_list)
    out.append(_finding(near.filter("kind = 'segment'"), "segment_modifier", "other"))
    out.append(_finding(near.filter((F.col("kind") != "segment") & tone), "tone_variant", "other"))
    out.append(_finding(near.filter((F.col("kind") != "segment") & ~tone), "possible_duplicate", "other"))
    if noise:
        out.append(_finding(m.filter(F.rlike("keyword", F.lit(noise))), "noise_flag"))
    if free is not None:
        asks = mains.groupBy("market", "need", "vkey").agg(
            F.min_by(F.struct("group", "keyword"), F.struct(-F.col("volume"), F.col("group"))).alias("g")
        )
        apart = free.filter("need <> 'shop'").withColumn("vkey", T.variant_key(F.col("words"))).join(asks, ["market", "need", "vkey"], "left")
        out.append(
            _finding(
                apart.filter("g is not null").select("market", "keyword", F.col("g.group").alias("group"), F.col("g.keyword").alias("main")),
                "same_question", "main",
            )
        )
        topics = apart.filter("g is null").withColumn("group", F.lit(None).cast("string")).orderBy(F.desc("volume"), "market", "keyword").limit(most_topics)  # the report's feature
        out.append(_finding(topics, "export_topic"))
    return reduce(DataFrame.unionByName, out)


#: What a decision on a grouping can do, in the order of application.
ACTIONS = ("merge", "move_keyword", "split", "keep_apart", "rename_main", "set_need")
LOG = "decision_id string, action string, market string, keyword string, target string, status string, detail string"


def apply_decisions(members: DataFrame, decisions: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Members after the decisions, and a log (status applied, already_true, stale, invalid, conflict).

    Decisions are a few dozen rows that people write; they are read on the
    driver behind a checked bound, ordered and checked against each other.
    What they apply to stays distributed: keywords are found by one join, the
    outcome is a set of column rules.
    """
    rows = decisions.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} decisions")
    listed = sorted(
        (r.asDict() for r in rows), key=lambda r: (ACTIONS.index(r["action"]) if r["action"] in ACTIONS else 99, _natural(r["decision_id"])),
    )
    m = members.withColumn("_key", T.decision_key(F.col("keyword")))
    spark = members.sparkSession
    wanted = spark.createDataFrame(
        [(str(r["market"] or ""), str(n)) for r in listed for n in (r["keyword"], r["target"]) if n] or [("", "")], "market string, name string",
    ).withColumn("_key", T.decision_key(F.col("name")))
    found = m.join(F.broadcast(wanted.select(F.col("market").alias("dm"), "_key", "name")), "_key").filter("dm = '' or dm = market").select(
        "name", "dm", "market", "group", "keyword", "is_main",
    ).distinct().limit(20 * most + 1).collect()
    if len(found) > 20 * most:
        raise ValueError(f"the decisions name more than {20 * most} rows")
    at: dict[tuple[str, str], list] = {}
    for f in found:
        at.setdefault((f["dm"], f["name"]), []).append(f)
    group_to: dict[tuple[str, str], str] = {}
    keyword_to: dict[tuple[str, str], str] = {}
    main_of: dict[tuple[str, str], str] = {}
    need_of: dict[tuple[str, str], str] = {}
    log, used = [], {}
    for r in listed:
        market = str(r["market"] or "")
        hits, target = at.get((market, str(r["keyword"] or "")), []), at.get((market, str(r["target"] or "")), [])
        status, detail = "applied", ""
        key = (r["action"], market, plain_key(r["keyword"]))
        if r["action"] not in ACTIONS or not r.get("reason") or not r.get("evidence"):
            status, detail = "invalid", "unknown action, or no reason or evidence"
        elif r.get("author") == "proposal":
            status, detail = "invalid", "a proposal needs an author"
        elif not hits:
            status, detail = "stale", "keyword not found"
        elif len({h["market"] for h in hits}) > 1:
            status, detail = "invalid", "market is not unique"
        elif r["action"] in ("merge", "move_keyword", "keep_apart") and not target:
            status, detail = "stale", "target not found"
        elif r["action"] == "keep_apart" and (hits[0]["market"], hits[0]["keyword"]) == (target[0]["market"], target[0]["keyword"]):
            status, detail = "invalid", "keyword and target are one"
        elif r["action"] == "keep_apart" and hits[0]["group"] != target[0]["group"]:
            status, detail = "already_true", "they are in different groups"
        elif r["action"] in ("merge", "move_keyword") and hits[0]["group"] == target[0]["group"]:
            status, detail = "already_true", "they are in one group"
        elif key in used:
            status, detail = "conflict", f"with {used[key]}"
        else:
            h = hits[0]
            used[key] = r["decision_id"]
            if r["action"] == "merge":
                group_to[h["market"], h["group"]] = target[0]["group"]
            elif r["action"] == "move_keyword":
                keyword_to[h["market"], h["keyword"]] = target[0]["group"]
            elif r["action"] == "split":
                keyword_to[h["market"], h["keyword"]] = f"{h['group']}/{plain_key(h['keyword'])}"
            elif r["action"] == "keep_apart":
                leaver = h if not h["is_main"] else target[0]  # the group keeps its main
                keyword_to[h["market"], leaver["keyword"]] = f"{leaver['group']}/{plain_key(leaver['keyword'])}"
                main_of[h["market"], f"{leaver['group']}/{plain_key(leaver['keyword'])}"] = leaver["keyword"]
            elif r["action"] == "rename_main":
                main_of[h["market"], h["group"]] = h["keyword"]
            elif r["action"] == "set_need":
                need_of[h["market"], h["keyword"]] = str(r["value"] or "")
        log.append((r["decision_id"], r["action"], market, r["keyword"], r["target"], status, detail))

    def lookup(table: dict[tuple[str, str], str], *columns: str):
        if not table:
            return F.lit(None).cast("string")
        items = F.create_map(*[F.lit(x) for (a, b), v in table.items() for x in (f"{a}\x1f{b}", v)])
        return F.try_element_at(items, F.concat_ws("\x1f", *columns))

    for key in list(group_to):  # chains end at a group that is not merged itself
        seen = {key[1]}
        while (key[0], group_to[key]) in group_to and group_to[key] not in seen:
            seen.add(group_to[key])
            group_to[key] = group_to[key[0], group_to[key]]
    moved = m.withColumn("group", F.coalesce(lookup(keyword_to, "market", "keyword"), lookup(group_to, "market", "group"), F.col("group")))
    named = moved.withColumn("_main", lookup(main_of, "market", "group"))
    out = named.withColumn("is_main", F.when(F.col("_main").isNotNull(), F.col("keyword") == F.col("_main")).otherwise(F.col("is_main"))).withColumn(
        "need", F.coalesce(lookup(need_of, "market", "keyword"), F.col("need")),
    )
    return out.drop("_key", "_main"), spark.createDataFrame(log, LOG)


def _natural(x: str | None) -> list[tuple[int, str]]:
    """Sort key by which d2 comes before d10."""
    return [(int(p), "") if p.isdigit() else (-1, p) for p in re.split(r"(\d+)", x or "")]


def plain_key(x: str | None) -> str:
    return " ".join((x or "").lower().replace("’", "'").replace("'", "").replace("-", " ").replace("_", " ").split())


def choose_group(tags: DataFrame) -> DataFrame:
    """A keyword in several groups belongs where it is main, else to the group whose main shares most words."""
    score = N.jaccard(F.col("words"), F.col("main_words"))
    k = F.row_number().over(Window.partitionBy("market", "keyword").orderBy(F.desc("is_main"), F.desc(score), "group"))
    return tags.withColumn("_k", k).filter("_k = 1").drop("_k")


def follow_targets(rows: DataFrame, node: str, target: str, rounds: int = 32) -> DataFrame:
    """Merge targets followed to the post that is not merged itself, by pointer doubling."""
    x = rows.select(F.col(node).alias("n"), F.col(target).alias("t"))
    from .cluster import checkpointed

    for _ in range(rounds):
        after = checkpointed(
            x.alias("a").join(
                x.select(F.col("n").alias("n2"), F.col("t").alias("t2")), F.col("a.t") == F.col("n2"), "left",
            ).select("n", F.coalesce("t2", "t").alias("t"))
        )
        changed = after.join(x.select("n", F.col("t").alias("old")), "n").filter("t <> old").limit(1).count()
        x = after
        if not changed:
            return x.select(F.col("n").alias(node), F.col("t").alias(target))
    raise ValueError("merge targets form a circle")


#: The cell of a plan that each action fills.
CELLS = {"set_title": "title", "set_note": "note", "set_owner": "owner", "set_status": "status", "set_angle": "angle"}


def fill_cells(plan: DataFrame, decisions: DataFrame, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, log) of decisions on single cells of a plan: only empty cells are filled, and only what a decision wrote is replaced.

    ``plan`` has a row a cell (market, keyword, cell, value; value empty where
    the team wrote nothing).  A decision names keyword and value; of several that
    differ on one cell none holds.  ``previous`` (decision_id, market, keyword,
    cell, value) is what the last run wrote: such a value may be replaced, and is
    cleared when its decision is gone and nobody has edited it since.
    """
    names = F.create_map(*[F.lit(x) for kv in CELLS.items() for x in kv])
    keyed = plan.withColumn("_key", T.decision_key(F.col("keyword"))).withColumn("now", F.trim(F.coalesce("value", F.lit(""))))
    d = decisions.withColumn("cell", F.try_element_at(names, F.lower(F.trim("action")))).withColumn("_key", T.decision_key(F.col("keyword"))).withColumn(
        "want", F.trim(F.coalesce("value", F.lit(""))),
    )
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    invalid = F.when(F.col("cell").isNull(), "unknown action").when(F.lower(F.coalesce("author", F.lit(""))) == "proposal", "a proposal needs an author").when(
        blank("reason") | blank("evidence"), "no reason or evidence",
    ).when(F.col("want") == "", "value is empty")
    d = d.withColumn("why", invalid).select("decision_id", "market", "keyword", "_key", "cell", "want", "why")
    target = keyed.select(F.col("market").alias("tm"), "_key", "cell", "now")
    found = d.filter("why is null").join(target, ["_key", "cell"], "left").filter(
        "tm is null or coalesce(market, '') = '' or tm = market or tm = 'all'"
    )
    per = Window.partitionBy("decision_id")
    found = found.withColumn("n", F.count("tm").over(per))
    per_cell = Window.partitionBy("tm", "_key", "cell")
    one = found.filter("n = 1").withColumn("differ", F.size(F.collect_set("want").over(per_cell)) > 1).withColumn(
        "k", F.row_number().over(per_cell.orderBy("decision_id")),
    )
    if previous is not None:
        mine = previous.select("decision_id", "cell", F.trim("value").alias("mine"))
        one = one.join(mine, ["decision_id", "cell"], "left")
    else:
        one = one.withColumn("mine", F.lit(None).cast("string"))
    status = F.when(F.col("differ"), "conflict").when((F.col("now") == F.col("want")) | (F.col("k") > 1), "already_true").when(
        (F.col("now") != "") & ~F.col("now").eqNullSafe(F.col("mine")), "team_value_kept",
    ).otherwise("applied")
    one = one.withColumn("status", status)
    # a decision that names a keyword in no market, or in several, says so once
    found_log = d.join(one.select("decision_id", "status"), "decision_id", "left").join(
        found.groupBy("decision_id").agg(F.max("n").alias("n")), "decision_id", "left",
    )
    log = found_log.select(
        "decision_id", "keyword", "cell",
        F.when(F.col("why").isNotNull(), "invalid").when(F.coalesce("n", F.lit(0)) == 0, "stale").when(F.col("n") > 1, "invalid").otherwise(F.col("status")).alias("status"),
    )
    writes = one.filter("status = 'applied'").select(F.col("tm").alias("market"), "_key", "cell", F.col("want").alias("new"))
    if previous is not None:
        gone = previous.join(decisions.select("decision_id"), "decision_id", "left_anti").filter("coalesce(value, '') <> ''").withColumn(
            "_key", T.decision_key(F.col("keyword")),
        )
        cleared = gone.join(keyed.select("market", "_key", "cell", "now"), ["market", "_key", "cell"]).filter(F.col("now") == F.trim("value"))
        log = log.unionByName(cleared.select("decision_id", "keyword", "cell", F.lit("withdrawn").alias("status")))
        writes = writes.unionByName(
            cleared.select("market", "_key", "cell", F.lit("").alias("new")).join(
                writes.select("market", "_key", "cell"), ["market", "_key", "cell"], "left_anti",
            )
        )
    cells = keyed.join(writes, ["market", "_key", "cell"], "left").select("market", "keyword", "cell", F.coalesce("new", "now").alias("value"))
    return cells, log


def outline_seeds(posts: DataFrame, light: tuple[str, ...], most: int = 8) -> DataFrame:
    """(post, keyword, place): a post's own keywords that ask something new, the greatest first, at most ``most``.

    New are words beyond the main's and the light ones, or a question where the
    main is none; of keywords with one signature the greatest stands.  Columns
    post, keyword, main, volume, fixed.
    """
    question = lambda c: F.rlike(F.lower(c), F.lit(r"^(what|when|where|who|why|how|which|is|are|do|does|did|can|should)\b"))
    words = lambda c: F.split(T.signature(T.normal_form(c)), " ")
    x = posts.filter((F.col("keyword") != F.col("main")) & ~F.col("fixed")).withColumn("sig", T.signature(T.normal_form(F.col("keyword")))).withColumn(
        "main_sig", T.signature(T.normal_form(F.col("main"))),
    )
    new = F.size(
        F.array_except(F.array_except(words(F.col("keyword")), F.array(*[F.lit(w) for w in light]).cast("array<string>")), words(F.col("main")))
    ) > 0
    asks = new | (question(F.col("keyword")) & ~question(F.col("main")))
    able = x.filter((F.col("sig") != "") & (F.col("sig") != F.col("main_sig")) & asks)
    once = able.withColumn("_s", F.row_number().over(Window.partitionBy("post", "sig").orderBy(F.desc("volume"), "keyword"))).filter("_s = 1")
    place = F.row_number().over(Window.partitionBy("post").orderBy(F.desc("volume"), "keyword"))
    return once.withColumn("place", place).filter(F.col("place") <= most).select("post", "keyword", "place")


def placed_keywords(keywords: DataFrame, topics: DataFrame, posts: DataFrame) -> DataFrame:
    """(market, keyword, stt, post, why): where a keyword is in the plan, through its cluster and what that is merged into.

    Keywords (market, keyword, cluster), topics (cluster, role, slug,
    merged_into), posts (slug, stt, main).  What has no post says why.
    """
    at = topics.select("cluster", "role", F.coalesce(F.nullif("slug", F.lit("")), F.nullif("merged_into", F.lit(""))).alias("slug"))
    x = keywords.join(at, "cluster", "left").join(posts.select("slug", "stt", F.col("main").alias("post")), "slug", "left")
    why = F.when(F.col("stt").isNotNull(), "").when(
        F.col("role") == "skip", "shop pages answer it",
    ).when(F.col("role") == "backlog", "backlog").otherwise("not in the plan")
    return x.select("market", "keyword", "stt", "post", why.alias("why"))


def checked_pairs(pairs: DataFrame, placed: DataFrame, least: int = 4) -> DataFrame:
    """(market, a, b, shared, verdict, follows): whether the plan does what the results of two keywords say.

    ``pairs`` (market, a, b, shared) are those compared, close in words or
    overlapping; one post from ``least`` shared results on.
    """
    side = lambda c, s: placed.select("market", F.col("keyword").alias(c), F.col("stt").alias(s))
    x = pairs.join(side("a", "sa"), ["market", "a"], "left").join(side("b", "sb"), ["market", "b"], "left")
    one, together = F.col("shared") >= least, F.col("sa") == F.col("sb")
    follows = F.when(
        F.col("sa").isNull() | F.col("sb").isNull(), "not in plan",
    ).when(one == together, "yes").when(together, "no: merged").otherwise("no: apart")
    return x.select("market", "a", "b", "shared", F.when(one, "one post").otherwise("two posts").alias("verdict"), follows.alias("follows"))


#: The order of severities.
SEVERITIES = ("high", "medium", "low")


def ranked_issues(issues: DataFrame, most: int = 300) -> DataFrame:
    """The issues in order of severity, falling volume, check and id, the first of each id, at most ``most`` (a report), numbered by ``place``."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    order = [rank, F.desc(F.coalesce("volume", F.lit(0))), F.col("check"), F.col("issue_id")]
    once = issues.withColumn("_k", F.row_number().over(Window.partitionBy("issue_id").orderBy(*order[:3], "keyword"))).filter("_k = 1").drop("_k")
    first = once.orderBy(*order).limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def need_conflicts(keywords: DataFrame) -> DataFrame:
    """Issues of keywords whose need was settled against the rules (column ``need_conflict``: what spoke against what)."""
    found = keywords.filter("coalesce(need_conflict, '') <> ''")
    issues = _issue(found, "need_conflict", "low", "set_need", "need_conflict")
    return issues.withColumn("issue_id", N.issue_id(F.col("check"), F.col("market"), F.col("keyword"), F.col("other"), T.decision_key))


def closest_names(missing: DataFrame, members: DataFrame) -> DataFrame:
    """(keyword, closest): for each name that is not in the data the keyword that shares most words with it; none without a shared word."""
    words = lambda c: F.split(T.decision_key(F.col(c)), " ")
    a = missing.select(F.col("keyword").alias("name"), F.lit("").alias("m"), words("keyword").alias("w")).dropDuplicates(["name"])
    b = members.select(F.col("keyword").alias("known"), F.lit("").alias("m"), words("keyword").alias("w")).dropDuplicates(["known"])
    return S.nearest(a, "name", b, "known", "w", ["m"]).select(F.col("a").alias("keyword"), F.col("b").alias("closest"))
