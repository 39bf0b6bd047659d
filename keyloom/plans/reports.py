"""Queries on reports over clusters, groups and plans, one row a finding, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cover as V
from ..operators import links as L
from ..operators import planning as P
from ..operators import review as R
from ..operators import rollups as U
from .phrases import _KW, _phrases, table

def _one_of(*values: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("id"), F.lit(len(values))) + 1).cast("int"))


def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many part names, and what volume, have results, difficulty, parent and trend."""
    kw = _phrases(spark, sf_dir)
    some = lambda n, value, empty: F.when(F.col("id") % n == 0, value).otherwise(empty)
    rows = kw.select(
        "volume", some(2, F.array(F.lit("u")), F.array().cast("array<string>")).alias("urls"), F.when(F.col("id") % 3 != 0, F.col("kd")).alias("kd"),
        some(5, F.col("type"), F.lit("")).alias("parent"), F.when(F.col("id") % 7 == 0, F.array(F.lit(1.0))).alias("trend"),
    )
    return U.coverage(rows)


EVIDENCE_COVERAGE = _KW + " SELECT " + ", ".join(
    f"count(*) FILTER ({c}) AS {n}_keywords, CAST(coalesce(sum(volume) FILTER ({c}), 0) AS BIGINT) AS {n}_volume" for n, c in (
        ("results", "id % 2 = 0"), ("difficulty", "id % 3 <> 0"), ("parent", "id % 5 = 0"), ("trend", "id % 7 = 0"),
    )
) + " FROM kw"


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    kw = _phrases(spark, sf_dir)
    return kw.select(
        "id", F.concat_ws("|", "market", "type").alias("cluster"), "volume",
        _one_of("seed", "serp:5", "lexical:0.80", "lexical:0.60").alias("joined"),
        F.when(F.col("id") % 17 == 0, F.array(F.lit("d1"))).alias("decision_ids"), F.when(F.col("id") % 11 == 0, "g").otherwise("").alias("group"),
    )


_JOINED = _KW + ", j AS (SELECT id, market || '|' || type AS cluster, volume, ['seed', 'serp', 'lexical', 'lexical'][id % 4 + 1] AS kind, id % 17 = 0 AS d, id % 11 = 0 AS g FROM kw)"


def cluster_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cluster of parts rests on."""
    return U.grouping_basis(_joined(spark, sf_dir), "cluster")


CLUSTER_BASIS = _JOINED + """ SELECT cluster, CASE WHEN bool_or(d) THEN 'decision' WHEN bool_or(g) THEN 'group' WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT kind) FILTER (kind <> 'seed') = 1 THEN min(kind) FILTER (kind <> 'seed') ELSE 'mixed' END AS basis FROM j GROUP BY cluster"""


def verified_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each cluster's volume that shared results vouch for."""
    return U.verified_share(_joined(spark, sf_dir), "cluster")


VERIFIED_SHARES = _JOINED + """, a AS (SELECT *, bool_or(kind = 'serp') OVER (PARTITION BY cluster) AS vouched FROM j)
SELECT cluster, CASE WHEN sum(volume) > 0 THEN round(sum(CASE WHEN kind = 'serp' OR (kind = 'seed' AND vouched) THEN volume ELSE 0 END) / sum(volume), 4) ELSE 0.0 END AS verified FROM a GROUP BY cluster"""


def excluded_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded part names by reason."""
    kw = _phrases(spark, sf_dir)
    return U.excluded_counts(kw.select("volume", _one_of("volume", "language", "too long").alias("reason")))


EXCLUDED_REASONS = _KW + " SELECT ['volume', 'language', 'too long'][id % 3 + 1] AS reason, count(*) AS keywords, CAST(sum(volume) AS BIGINT) AS volume FROM kw GROUP BY 1"


def node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part that names each type: strong by what it wins and owns, weak by extra words."""
    kw = _phrases(spark, sf_dir)
    rows = kw.select(
        "id", "type", (F.col("volume") * (F.col("id") % 9)).alias("winnable"), "volume", (F.size("words") - 1).alias("extra"),
        (F.col("id") % 3).cast("double").alias("fluency"),
    )
    return U.representative(rows, "type")


NODE_NAMES = _KW + """, s AS (SELECT id, type, round(sqrt(CAST(volume * (id % 9) * volume AS DOUBLE)) / (1 + 0.5 * (len(words) - 1)), 6) AS s, id % 3 AS f, volume FROM kw),
k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY s DESC, f DESC, volume DESC, id DESC) AS k FROM s) SELECT type, id AS representative FROM k WHERE k = 1"""


def pillar_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster that leads each brand, and whether it is worth a post of its own."""
    kw = _phrases(spark, sf_dir)
    rows = kw.select(
        "id", F.col("market").alias("pillar"), _one_of("info", "choose", "shop").alias("need"), (F.col("id") % 2).alias("facets"),
        F.size("words").alias("extra"), (F.col("volume") * (F.col("id") % 4)).alias("winnable"), "volume",
    )
    hubs = U.pillar_hub(rows, "pillar")
    flagged = rows.join(hubs, "pillar").withColumn("is_hub", F.col("id") == F.col("hub"))
    own = U.promoted(flagged, "pillar", share=0.02).select("pillar", F.lit(True).alias("own"))
    return hubs.join(own, "pillar", "left").select("pillar", "hub", F.coalesce("own", F.lit(False)).alias("own_post"))


PILLAR_HUBS = _KW + """, r AS (SELECT id, market AS pillar, id % 3 = 1 AS list, id % 2 AS facets, len(words) AS extra, volume * (id % 4) AS winnable, volume, sum(volume) OVER (PARTITION BY market) AS total FROM kw),
k AS (SELECT *, row_number() OVER (PARTITION BY pillar ORDER BY list DESC, facets, extra, winnable DESC, id DESC) AS k FROM r) SELECT pillar, id AS hub, volume >= 50 AND volume >= 0.02 * total AS own_post FROM k WHERE k = 1"""


def cross_pillar_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one type and name under two brands: the one that owns most stays, the others name it."""
    kw = _phrases(spark, sf_dir)
    posts = kw.select(
        "id", F.col("market").alias("pillar"), F.col("type").alias("topic"), F.col("vkey").alias("core"), F.col("volume").alias("owned"), "words",
    )
    return U.across_pillars(posts).select("id", "merged_into")


CROSS_PILLAR_DUPLICATES = _KW + """, w AS (SELECT id, market, first_value(id) OVER w AS f, first_value(market) OVER w AS fm, row_number() OVER w AS k FROM kw WINDOW w AS (PARTITION BY type, vkey ORDER BY volume DESC, id))
SELECT id, CASE WHEN k > 1 AND fm <> market THEN f END AS merged_into FROM w"""


def one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one group of each part name that stands in several: where it is main, else the one whose main shares most words."""
    kw = _phrases(spark, sf_dir)
    mains = kw.groupBy("type").agg(F.min_by("words", "id").alias("main_words"))
    tags = kw.join(mains, "type").select(
        F.lit("us").alias("market"), F.col("norm").alias("keyword"), F.col("type").alias("group"), (F.col("id") % 23 == 0).alias("is_main"), "words",
        "main_words",
    )
    return R.choose_group(tags.dropDuplicates(["keyword", "group", "is_main"])).select("keyword", "group", "is_main")


ONE_GROUP = _KW + """, m AS (SELECT type, arg_min(words, id) AS main_words FROM kw GROUP BY type), t AS (SELECT DISTINCT norm AS keyword, kw.type AS "group", id % 23 = 0 AS is_main, len(list_intersect(words, main_words)) / CAST(len(list_distinct(list_concat(words, main_words))) AS DOUBLE) AS s FROM kw JOIN m ON m.type = kw.type),
k AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY is_main DESC, s DESC, "group") AS k FROM t) SELECT keyword, "group", is_main FROM k WHERE k = 1"""


def post_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, fit, priority and working title of each part as a post."""
    kw = _phrases(spark, sf_dir)
    need, hub, recipient = _one_of(
        "choose", "how_to", "info", "copy_ideas", "inspire", "shop",
    ), F.col("id") % 13 == 0, F.when(F.col("id") % 4 == 0, "mom").otherwise("")
    x = kw.select(
        "id", "norm", F.col("volume").cast("double").alias("v"), need.alias("need"), P.post_type(need, hub, recipient, F.lit("")).alias("post_type"),
    ).withColumn("fit", P.need_fit(F.col("need")))
    return x.select(
        "id", "post_type", "fit", P.priority(F.col("v"), F.col("fit")).alias("priority"),
        P.post_titles(F.col("norm"), F.col("post_type"), F.lit("us")).alias("title"),
    )


POST_PLAN = _KW + """, n AS (SELECT id, norm, volume, ['choose', 'how_to', 'info', 'copy_ideas', 'inspire', 'shop'][id % 6 + 1] AS need FROM kw),
t AS (SELECT *, CASE WHEN id % 13 = 0 THEN 'pillar_hub' WHEN need IN ('how_to', 'copy_ideas') THEN need WHEN need = 'choose' THEN CASE WHEN id % 4 = 0 THEN 'gift_guide' ELSE 'choose_guide' END WHEN need = 'inspire' THEN 'ideas_list' ELSE 'explainer' END AS post_type,
  CASE need WHEN 'shop' THEN 'low' WHEN 'info' THEN 'medium' ELSE 'high' END AS fit, array_to_string(list_transform(string_split(norm, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM n)
SELECT id, post_type, fit, CAST(round_even(CAST(volume AS DOUBLE) * CASE fit WHEN 'high' THEN 1e0 WHEN 'medium' THEN 6e-1 ELSE 15e-2 END, 1) AS DOUBLE) AS priority, CASE post_type WHEN 'pillar_hub' THEN name || ': The Complete Guide' WHEN 'how_to' THEN 'How To: ' || name WHEN 'gift_guide' THEN name || ' They Will Love'
  WHEN 'copy_ideas' THEN name || ': What To Write' WHEN 'explainer' THEN name || ' Explained' ELSE name || ': Ideas And How To Choose' END AS title FROM t"""


def need_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs that no part of a type answers."""
    kw = _phrases(spark, sf_dir)
    return P.gaps(kw.select("type", _one_of("choose", "how_to", "info", "copy_ideas", "inspire").alias("need")), "type", "need")


NEED_GAPS = _KW + """, n AS (SELECT type, list(DISTINCT ['choose', 'how_to', 'info', 'copy_ideas', 'inspire'][id % 5 + 1]) AS h FROM kw GROUP BY type)
SELECT type, array_to_string(list_filter(['choose|inspire', 'how_to', 'info', 'copy_ideas'], lambda e: NOT list_has_any(string_split(e, '|'), h)), ', ') AS gaps FROM n"""


def published_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as planned posts against part names as published ones: same, part or related."""
    names = _phrases(spark, sf_dir).groupBy("norm").agg(F.first("words").alias("words"))
    return P.published_matches(names.select(F.col("norm").alias("slug"), "words"), names.select(F.concat(F.lit("/"), "norm").alias("url"), "words"))


PUBLISHED_MATCHES = _KW + """, n AS (SELECT norm, any_value(words) AS w FROM kw GROUP BY norm), pr AS (SELECT a.norm AS slug, '/' || b.norm AS url, len(list_intersect(a.w, b.w)) AS s, len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) AS j, len(a.w) AS na FROM n a, n b),
q AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY j DESC, slug) AS p, row_number() OVER (PARTITION BY slug ORDER BY j DESC, url) AS u FROM pr WHERE s > 0),
k AS (SELECT *, CASE WHEN j >= 0.75 AND p = 1 AND u = 1 THEN 'same' WHEN s / CAST(na AS DOUBLE) >= 0.75 THEN 'part' ELSE 'related' END AS kind FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY slug, kind ORDER BY j DESC, url) AS r FROM k) SELECT slug, url, kind, round(j, 6) AS similarity FROM r WHERE kind <> 'related' OR r <= 3"""


def given_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hubs of given pillars: the given one unless another wins half as much again."""
    kw = _phrases(spark, sf_dir)
    rows = kw.select(
        "id", "market", F.when(F.col("id") % 5 != 0, F.col("type")).alias("pillar"),
        F.concat_ws(" ", "norm", F.col("id").cast("string")).alias("name"), (F.col("id") % 7 == 0).alias("is_given_hub"),
        (F.col("volume") * (F.col("id") % 3 + 1)).cast("double").alias("winnable"),
    )
    return P.given_pillars(rows).select("id", "is_hub")


GIVEN_HUBS = _KW + """, r AS (SELECT id, market, type AS pillar, norm || ' ' || id AS name, id % 7 = 0 AS given, volume * (id % 3 + 1) AS win FROM kw WHERE id % 5 <> 0),
w AS (SELECT *, max(CASE WHEN given THEN win END) OVER (PARTITION BY market, pillar) AS g, max(win) OVER (PARTITION BY market, pillar) AS top, row_number() OVER (PARTITION BY market, pillar ORDER BY win DESC, name) AS k FROM r)
SELECT id, CASE WHEN g IS NULL OR top >= 1.5 * g THEN k = 1 ELSE given END AS is_hub FROM w"""


def merges_kept_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged parts that come back because results told the two apart."""
    kw = _phrases(spark, sf_dir)
    posts = kw.select(F.col("id").cast("string").alias("slug"), F.when(F.col("id") % 2 == 0, (F.col("id") + 1).cast("string")).alias("merged_into"))
    pairs = kw.filter("id % 6 in (0, 3)").select((F.col("id") + 1).cast("string").alias("a"), F.col("id").cast("string").alias("b"))
    return P.keep_groups_apart(posts, pairs)


MERGES_KEPT_APART = _KW + " SELECT CAST(id AS VARCHAR) AS slug, CASE WHEN id % 2 = 0 AND id % 6 <> 0 THEN CAST(id + 1 AS VARCHAR) END AS merged_into, id % 6 = 0 AS kept_apart FROM kw"


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writing order of parts as posts with deadlines around a day."""
    kw = _phrases(spark, sf_dir)
    day = F.to_date(F.lit("2026-06-01"))
    posts = kw.select(
        F.col("id").alias("stt"), F.when(F.col("id") % 4 != 0, F.date_add(day, (F.col("id") % 61 - 20).cast("int"))).alias("deadline"),
        F.when(F.col("id") % 8 == 0, "easter").otherwise("").alias("occasion"), _one_of("A", "B", "C").alias("bucket"),
        F.col("volume").alias("priority"),
    )
    return P.schedule(posts, day).select("stt", "timing", "work_order")


WORK_ORDERS = _KW + """, d AS (SELECT id AS stt, CASE WHEN id % 4 <> 0 THEN id % 61 - 20 END AS days, id % 8 = 0 AS occ, ['A', 'B', 'C'][id % 3 + 1] AS bucket, volume FROM kw),
t AS (SELECT *, CASE WHEN days IS NULL THEN CASE WHEN occ THEN 'no date rule' ELSE 'evergreen' END WHEN days < 0 THEN 'late' WHEN days <= 14 THEN 'due soon' ELSE 'on time' END AS timing FROM d)
SELECT stt, timing, row_number() OVER (ORDER BY list_position(['due soon', 'late', 'on time', 'no date rule', 'evergreen'], timing), bucket, volume DESC, stt) AS work_order FROM t"""


def theme_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each brand's part names cover given themes."""
    kw = _phrases(spark, sf_dir)
    return P.research(
        kw.select(F.col("market").alias("topic"), "volume", "norm"), [("sizes", "small|large"), ("reds", r"\bred\b"), ("nothing", "zzz")], thin=5,
    )


THEME_RESEARCH = _KW + r""", t(theme, p) AS (VALUES ('sizes', 'small|large'), ('reds', '\bred\b'), ('nothing', 'zzz')),
x AS (SELECT market AS topic, theme, count(*) FILTER (regexp_matches(norm, p)) AS hits, CAST(coalesce(sum(volume) FILTER (regexp_matches(norm, p)), 0) AS BIGINT) AS volume FROM kw, t GROUP BY 1, 2)
SELECT *, CASE WHEN hits = 0 THEN 'missing' WHEN hits < 5 THEN 'thin' ELSE 'covered' END AS state FROM x"""


def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale years, stray letters, letters beyond ASCII, decision and join keys, and list cells of part names written in odd ways."""
    p = table(spark, sf_dir, "part")
    k = F.pmod(F.col("p_partkey"), F.lit(6))
    x = F.when(k == 0, F.concat("p_name", F.lit(" 2019"))).when(k == 1, F.concat(F.lit("k "), "p_name")).when(k == 2, F.concat("p_name", F.lit(" café éé"))).when(k == 3, F.concat(F.lit("  The-"), F.upper("p_name"), F.lit("’s  "))).when(
        k == 4, F.concat("p_name", F.lit("; - x, y\n2) z")),
    ).otherwise(F.concat("p_name", F.lit(", b, c")))
    c = F.col("x")
    return p.select("p_partkey", x.alias("x")).select(
        "p_partkey", T.stale_year(c, 2025).alias("stale"), T.stray_letter(c).alias("stray"), F.round(T.non_ascii_ratio(c), 6).alias("non_ascii"), T.decision_key(c).alias("decision_key"), T.join_key(c).alias("join_key"), F.array_join(T.split_list(c), "/").alias("items")
    )


TEXT_FLAGS = r"""
WITH x AS (SELECT p_partkey, p_partkey % 6 AS k, CASE p_partkey % 6 WHEN 0 THEN p_name || ' 2019' WHEN 1 THEN 'k ' || p_name WHEN 2 THEN p_name || ' café éé' WHEN 3 THEN '  The-' || upper(p_name) || '’s  ' WHEN 4 THEN p_name || '; - x, y' || chr(10) || '2) z' ELSE p_name || ', b, c' END AS x FROM part),
q AS (SELECT *, replace(replace(replace(lower(x), '’', ''''), '‘', ''''), '`', '''') AS s FROM x),
l AS (SELECT p_partkey, list_filter(list_transform(CASE WHEN regexp_matches(x, '[\n;|]') THEN regexp_split_to_array(x, '[\n;|]') ELSE string_split(x, ',') END, lambda v: trim(regexp_replace(v, '^\s*(?:[-*•]|[0-9]+[.)])\s*', ''))), lambda v: v <> '') AS items FROM x)
SELECT q.p_partkey, k = 0 AS stale, k = 1 OR regexp_matches(x, '^[b-hj-su-wyz] | [b-hj-su-wyz]$') AS stray,
  CASE WHEN length(regexp_replace(x, '[^\p{L}]', '', 'g')) > 0 THEN round((length(regexp_replace(x, '[^\p{L}]', '', 'g')) - length(regexp_replace(x, '[^A-Za-z]', '', 'g'))) / length(regexp_replace(x, '[^\p{L}]', '', 'g')), 6) ELSE 0.0 END AS non_ascii,
  trim(regexp_replace(translate(replace(s, '''', ''), '-_', '  '), '\s+', ' ', 'g')) AS decision_key, trim(regexp_replace(s, '\s+', ' ', 'g')) AS join_key, array_to_string(items, '/') AS items FROM q JOIN l USING (p_partkey)
"""


def issue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues on parts with the decision that answers each: by its id, by keyword and target, or by keyword and action."""
    kw = _phrases(spark, sf_dir)
    s = F.col("id").cast("string")
    issues = kw.select(
        F.concat(F.lit("BC-"), s).alias("issue_id"), F.lit("us").alias("market"), F.concat(F.lit("k"), s).alias("keyword"),
        F.concat(F.lit("o"), s).alias("other"), F.lit("merge").alias("action"),
    )
    by = F.pmod(F.col("id"), F.lit(4))
    d = kw.filter("id % 4 <> 3").select(
        F.concat(F.lit("d"), s).alias("decision_id"), F.when(by == 0, F.concat(F.lit("BC-"), s)).alias("source_issue"), F.lit("us").alias("market"),
        F.when(by == 0, "x").otherwise(F.concat(F.lit("k"), s)).alias("keyword"),
        F.when(by == 1, F.concat(F.lit("o"), s)).otherwise("y").alias("target"), F.when(by == 2, "merge").otherwise("split").alias("action"),
        _one_of("applied", "stale").alias("status"),
    )
    return P.issue_status(issues, d).select("issue_id", "state", "decision_id")


ISSUE_STATES = _KW + " SELECT 'BC-' || id AS issue_id, CASE WHEN id % 4 = 3 THEN 'open' ELSE ['applied', 'stale'][id % 2 + 1] END AS state, CASE WHEN id % 4 <> 3 THEN 'd' || id END AS decision_id FROM kw"


def carried_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team columns of an earlier plan brought to a new one, by address, then by signature."""
    kw = _phrases(spark, sf_dir)
    s = F.col("id").cast("string")
    posts = kw.select(
        s.alias("slug"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("/"), s)).otherwise("").alias("url"),
        F.when(F.col("id") % 3 == 1, F.concat(F.lit("sig "), s)).otherwise("").alias("signature"),
        F.when(F.col("id") % 6 == 0, "mine").otherwise("").alias("owner"),
    )
    previous = kw.filter("id % 5 <> 0").select(
        F.concat(F.lit("old"), s).alias("old_slug"), F.concat(F.lit("/"), s).alias("url"), F.concat(F.lit("sig "), s).alias("signature"),
        F.concat(F.lit("team "), s).alias("owner"),
    )
    return U.carry_over(posts, previous, ["owner"]).select("slug", "owner", "carried")


CARRIED_COLUMNS = _KW + """ SELECT CAST(id AS VARCHAR) AS slug, CASE WHEN id % 6 = 0 THEN 'mine' WHEN id % 3 < 2 AND id % 5 <> 0 THEN 'team ' || id WHEN id % 3 < 2 THEN NULL END AS owner, id % 3 < 2 AND id % 5 <> 0 AS carried FROM kw"""

_TYPES = ("economy", "large", "medium", "promo", "small", "standard")


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as posts: types are pillars led by their first part in a brand; two facets by the part's number."""
    kw = _phrases(spark, sf_dir)
    hubs = kw.groupBy("market", "type").agg(F.min("id").alias("hub"))
    x = kw.join(hubs, ["market", "type"])
    later = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.floor(F.col("id") / 6) % 6 + 1).cast("int"))
    return x.select(
        "market", F.concat(F.lit("s"), F.col("id").cast("string")).alias("slug"), F.col("type").alias("pillar"), F.col("type").alias("topic"),
        (F.col("id") == F.col("hub")).alias("is_pillar"), F.lower("type").alias("key"), _one_of(*_TYPES).alias("interest"), later.alias("occasion"),
        "volume",
    )


_POSTS = _KW + """, po AS (SELECT id, market, 's' || id AS slug, type, min(id) OVER (PARTITION BY market, type) = id AS is_pillar, ['economy', 'large', 'medium', 'promo', 'small', 'standard'][id % 6 + 1] AS interest,
  ['economy', 'large', 'medium', 'promo', 'small', 'standard'][id // 6 % 6 + 1] AS occasion, volume FROM kw)"""


def cross_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link of each part to the pillar of another type that one of its facets names."""
    return L.cross_links(_posts(spark, sf_dir))


CROSS_LINKS = _POSTS + """, h AS (SELECT market, lower(type) AS v, type, slug FROM po WHERE is_pillar)
SELECT po.market, po.slug AS source, coalesce(i.slug, o.slug) AS target, CASE WHEN i.slug IS NOT NULL THEN 'interest' ELSE 'occasion' END AS facet FROM po LEFT JOIN h i ON i.market = po.market AND i.v = po.interest AND i.type <> po.type
LEFT JOIN h o ON o.market = po.market AND o.v = po.occasion AND o.type <> po.type WHERE coalesce(i.slug, o.slug) IS NOT NULL"""


def backlink_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published parts to update with a link to a planned one; each part links to the next."""
    posts = _posts(spark, sf_dir)
    n = F.substring("slug", 2, 20).cast("long")
    links = posts.select(F.col("slug").alias("source"), F.concat(F.lit("s"), (n + 1).cast("string")).alias("target"))
    return L.backlink_queue(posts, links, posts.filter(n % 4 == 0).select("slug")).select(
        "market", "source", "target", F.col("place").cast("long").alias("place"),
    )


BACKLINK_QUEUE = _POSTS + """, p AS (SELECT n.market, o.slug AS source, n.slug AS target, CAST(o.interest = n.interest AS INT) + CAST(o.occasion = n.occasion AS INT) AS shared, o.is_pillar, o.volume, n.id % 4 = 1 AS had
  FROM po n JOIN po o ON o.market = n.market AND (o.interest = n.interest OR o.occasion = n.occasion) WHERE n.id % 4 <> 0 AND o.id % 4 = 0 AND o.id + 1 <> n.id),
k AS (SELECT *, row_number() OVER (PARTITION BY market, target ORDER BY shared DESC, is_pillar DESC, volume DESC, source) AS place FROM p2) SELECT market, source, target, place FROM k WHERE place + CAST(had AS INT) <= 3""".replace(", p AS (", ", p2 AS (")

def section_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The post that each merged part becomes a section of, within its type; every fifth part is a post, the first one the hub."""
    kw = _phrases(spark, sf_dir)
    kept = F.col("id") % 5 == 0
    hubs = kw.groupBy("type").agg(F.min(F.when(kept, F.col("id"))).alias("first"))
    rows = kw.join(hubs, "type").select(
        "id", F.col("type").alias("pillar"), F.col("words").alias("core"), "volume", kept.alias("kept"), (F.col("id") == F.col("first")).alias("hub"),
    )
    return V.merge_targets(rows)


SECTION_TARGETS = _KW + """, pa AS (SELECT a.id, b.id AS target, len(list_intersect(a.words, b.words)) AS s, len(list_intersect(a.words, b.words)) = len(b.words) AS held, b.volume FROM kw a JOIN kw b ON a.type = b.type WHERE a.id % 5 <> 0 AND b.id % 5 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY held DESC, s DESC, volume DESC, target) AS k FROM pa WHERE s > 0), h AS (SELECT type, min(id) FILTER (id % 5 = 0) AS hub FROM kw GROUP BY type)
SELECT kw.id, coalesce(k.target, h.hub) AS target, CASE WHEN k.held THEN 'contained' WHEN k.target IS NOT NULL THEN 'overlap' WHEN h.hub IS NOT NULL THEN 'hub' ELSE 'none' END AS how
FROM kw LEFT JOIN k ON k.id = kw.id AND k.k = 1 JOIN h ON h.type = kw.type WHERE kw.id % 5 <> 0"""


def misplaced_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name is that of another type's pillar in their brand; each type's first part names its pillar."""
    kw = _phrases(spark, sf_dir)
    hubs = kw.groupBy("market", "type").agg(F.min("id").alias("hub"))
    rows = kw.join(hubs, ["market", "type"]).select(
        "market", F.col("id").cast("string").alias("slug"), F.col("type").alias("pillar"), "words", (F.col("id") == F.col("hub")).alias("is_pillar"),
    )
    return V.misplaced(rows)


MISPLACED_POSTS = _KW + """, h AS (SELECT market, type, arg_min(words, id) AS w, min(id) AS hub FROM kw GROUP BY ALL)
SELECT CAST(kw.id AS VARCHAR) AS slug, kw.type AS pillar, min(o.type) AS other FROM kw JOIN h ON h.market = kw.market AND h.type = kw.type AND h.hub <> kw.id JOIN h o ON o.market = kw.market AND o.type <> kw.type AND o.w = kw.words GROUP BY ALL"""

QUERIES = {
    f.__name__: f
    for f in (
        evidence_coverage, cluster_basis, verified_shares, excluded_reasons, node_names, pillar_hubs, cross_pillar_duplicates, one_group, post_plan, need_gaps, published_matches, given_hubs, merges_kept_apart, work_orders, theme_research, text_flags, issue_states,
        carried_columns, cross_links, backlink_queue, section_targets, misplaced_posts,
    )
}
ORACLE = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
