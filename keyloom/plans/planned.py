"""Queries on plans and groupings: topic words, categories, label mixes, reviews, published posts, the whole pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import taxonomy as X
from ..functions import text as T
from ..operators import cluster as C
from ..operators import planning as P
from ..operators import review as R
from ..operators import rollups as U
from ..operators import topics as To
from . import pipeline
from .phrases import _KW, _phrases, normal_sql, table, tokens_sql


def topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in at least a tenth of a brand's part names."""
    return U.topic_words(_phrases(spark, sf_dir), "market", "words", share=0.1)


TOPIC_WORDS = (
    _KW
    + """, e AS (SELECT market, unnest(words) AS word FROM kw), n AS (SELECT market, count(*) AS n FROM kw GROUP BY 1)
SELECT e.market, word, count(*) AS names FROM e JOIN n USING (market) GROUP BY e.market, word, n.n HAVING count(*) >= 3 AND count(*) >= 0.1 * n.n
"""
)


def duplicate_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs that several pages share."""
    return P.duplicate_slugs(table(spark, sf_dir, "pages"))


DUPLICATE_SLUGS = r"""
WITH c AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '[?#].*$', ''), '/+$', '') AS c FROM pages),
s AS (SELECT url, regexp_replace(regexp_extract(regexp_replace(c, '^[^/]*/?', ''), '([^/]*)$', 1), '\.[a-z0-9]{1,5}$', '') AS slug FROM c)
SELECT slug, count(*) AS posts, min(url) AS first_url FROM s GROUP BY slug HAVING count(*) > 1
"""

_GROUPS = {"color": ["red", "blue", "green", "black"], "size": ["small", "large"], "other": ["re:[aeiou]{3}"]}


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First custom category of each part name, with phrases and volume."""
    kw = _phrases(spark, sf_dir)
    return kw.groupBy(X.category(F.col("norm"), _GROUPS)["first"].alias("category")).agg(
        F.count("*").alias("keywords"), F.sum("volume").alias("volume"),
    )


CATEGORY_COUNTS = (
    _KW
    + r""", c AS (SELECT volume, CASE WHEN regexp_matches(norm, '(^|[^\p{L}\p{N}_])(red|blue|green|black)($|[^\p{L}\p{N}_])') THEN 'color' WHEN regexp_matches(norm, '(^|[^\p{L}\p{N}_])(small|large)($|[^\p{L}\p{N}_])') THEN 'size' WHEN regexp_matches(norm, '[aeiou]{3}') THEN 'other' ELSE '' END AS category FROM kw)
SELECT category, count(*) AS keywords, CAST(sum(volume) AS BIGINT) AS volume FROM c GROUP BY 1
"""
)


def label_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types inside each brand, largest first, as one text."""
    return C.label_mix(_phrases(spark, sf_dir), "market", "type", "volume")


LABEL_MIX = (
    _KW
    + """, e AS (SELECT market, type AS l, count(*) AS n, CAST(sum(volume) AS BIGINT) AS v FROM kw GROUP BY 1, 2)
SELECT market, string_agg(l || ' ' || n || ' (' || v || ')', '; ' ORDER BY v DESC, l) AS mix FROM e GROUP BY market
"""
)


def bucketed_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types whose rounded sizes are all planner buckets."""
    p = table(spark, sf_dir, "part").select(
        "p_type", F.when(F.col("p_size") > 25, 50).when(F.col("p_size") > 5, 10).otherwise(F.col("p_size")).alias("v"),
    )
    return U.bucketed_volumes(p, "p_type", "v")


BUCKETED_VOLUMES = """
WITH p AS (SELECT p_type, CASE WHEN p_size > 25 THEN 50 WHEN p_size > 5 THEN 10 ELSE p_size END AS v FROM part)
SELECT p_type, bool_and(v IN (0, 10, 50, 100, 500, 1000, 5000, 10000, 50000, 100000, 500000, 1000000)) AND count(v) > 0 AS bucketed FROM p GROUP BY p_type
"""


def plan_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned titles that are the same by signature: how many parts share each, the first of them."""
    p = table(spark, sf_dir, "part")
    return p.groupBy(T.signature(T.normal_form(F.concat_ws(" ", F.lit("the best of"), "p_name"))).alias("signature")).agg(
        F.count("*").alias("titles"), F.min("p_partkey").alias("first"),
    )


PLAN_SIGNATURES = f"""
WITH t AS (SELECT p_partkey, {tokens_sql(normal_sql("'the best of ' || p_name"))} AS w FROM part), f AS (SELECT p_partkey, list_filter(w, lambda x: x NOT IN ('a','an','the','of','for','to','in','on','and','or','is','are','do','does','with','your','my') AND NOT regexp_matches(x, '^(19|20)[0-9]{{2}}$') AND length(x) > 1) AS k FROM t),
s AS (SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(k, lambda x: CASE WHEN length(x) > 3 AND regexp_matches(x, '[^sui]s$') AND x NOT LIKE '%ys' THEN substr(x, 1, length(x) - 1) ELSE x END))), ' ') AS signature FROM f)
SELECT signature, count(*) AS titles, min(p_partkey) AS first FROM s GROUP BY 1
"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    kw = _phrases(spark, sf_dir).withColumn("keyword", F.concat_ws(" ", "norm", "type"))
    first = F.row_number().over(Window.partitionBy("market", "type").orderBy(F.desc("volume"), "id"))
    need = F.element_at(F.array(F.lit("choose"), F.lit("shop"), F.lit("info")), (F.pmod(F.col("id"), F.lit(3)) + 1).cast("int"))
    return kw.select(
        "market", F.col("type").alias("group"), "keyword", (first == 1).alias("is_main"), "volume", "kd", need.alias("need"),
        F.lit("").alias("parent"), "words",
    )


def back_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-check of parts grouped by type within brands: every issue; ids are tested."""
    return R.back_check(_grouped(spark, sf_dir)).select("check", "severity", "market", "keyword", "other", "action")


BACK_CHECK = (
    _KW
    + """, g AS (SELECT id, market, type AS grp, norm || ' ' || type AS keyword, row_number() OVER (PARTITION BY market, type ORDER BY volume DESC, id) = 1 AS is_main, volume, ['choose', 'shop', 'info'][id % 3 + 1] AS need, array_to_string(words, ' ') AS w FROM kw),
m AS (SELECT * FROM g WHERE is_main), o AS (SELECT g.market, g.keyword, min(m.keyword) AS other FROM g JOIN m ON m.market = g.market AND m.w = g.w AND m.grp <> g.grp WHERE NOT g.is_main AND g.w <> '' GROUP BY ALL),
t AS (SELECT market, grp, sum(volume) AS gv, max(volume) AS top FROM g GROUP BY ALL), x AS (SELECT m.market, m.keyword, sum(g.volume) FILTER (g.need <> m.need) AS apart, sum(g.volume) AS gv FROM m JOIN g ON g.market = m.market AND g.grp = m.grp GROUP BY ALL)
SELECT 'secondary_is_other_main' AS "check", 'high' AS severity, market, keyword, other, 'merge' AS action FROM o
UNION ALL SELECT 'mixed_intent', 'medium', market, keyword, '', 'split' FROM x WHERE coalesce(apart, 0) >= 0.2 * gv AND gv > 0
UNION ALL SELECT 'main_not_best', 'medium', m.market, keyword, '', 'rename_main' FROM m JOIN t ON t.market = m.market AND t.grp = m.grp WHERE top >= 2 * volume AND top > 0
UNION ALL SELECT 'no_data', 'low', m.market, keyword, '', '' FROM m JOIN t ON t.market = m.market AND t.grp = m.grp WHERE gv = 0
UNION ALL SELECT 'shopping_main', 'high', market, keyword, '', 'set_need' FROM m WHERE need = 'shop'
UNION ALL SELECT 'same_question_groups', 'high', y.market, y.keyword, x.keyword, 'merge' FROM m x JOIN m y ON x.market = y.market AND x.w = y.w AND x.grp <> y.grp AND (x.volume > y.volume OR (x.volume = y.volume AND x.keyword < y.keyword)) WHERE x.w <> ''
"""
)


def grouping_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the same grouping: every finding, its keyword and group, and what it points to."""
    return R.audit_grouping(_grouped(spark, sf_dir), close=0.5, tones=("small", "large"), lists=("red", "blue"))


_GROUPED = (
    _KW
    + """, gr AS (SELECT *, norm || ' ' || lower(type) AS kwd FROM kw), g AS (SELECT id, market, type AS grp, norm || ' ' || type AS keyword, row_number() OVER (PARTITION BY market, type ORDER BY volume DESC, id) = 1 AS is_main, volume, kd, ['choose', 'shop', 'info'][id % 3 + 1] AS need, words,
  array_to_string(list_sort(words), ' ') AS vkey FROM kw)"""
)
GROUPING_AUDIT = (
    _GROUPED
    + r""", mains AS (SELECT * FROM g WHERE is_main), rk AS (SELECT *, row_number() OVER w AS k, first_value(keyword) OVER w AS other FROM mains WINDOW w AS (PARTITION BY market, vkey ORDER BY volume DESC, keyword, grp)),
dp AS (SELECT *, row_number() OVER w AS k, first_value(grp) OVER w AS other FROM g WINDOW w AS (PARTITION BY market, vkey ORDER BY is_main DESC, volume DESC, grp, keyword)),
bm AS (SELECT x.market, m.keyword, x.grp, x.keyword AS other, row_number() OVER (PARTITION BY x.market, x.grp ORDER BY x.volume * CASE WHEN x.kd <= 30 THEN 1.0 ELSE greatest(0.05, 1.0 - (x.kd - 30) / 30.0) END DESC, x.volume DESC, x.keyword) AS k
  FROM g x JOIN mains m ON m.market = x.market AND m.grp = x.grp WHERE NOT x.is_main AND NOT regexp_matches(x.keyword, '[0-9]') AND len(string_split(x.keyword, ' ')) <= 8 AND len(list_filter(m.words, lambda t: NOT list_contains(x.words, t))) = 0
  AND (x.volume >= greatest(m.volume, 1) * 2.0 OR (m.kd > 30 AND (CASE WHEN x.kd <= 30 THEN 1.0 ELSE greatest(0.05, 1.0 - (x.kd - 30) / 30.0) END) > (CASE WHEN m.kd <= 30 THEN 1.0 ELSE greatest(0.05, 1.0 - (m.kd - 30) / 30.0) END)
    AND x.volume * (CASE WHEN x.kd <= 30 THEN 1.0 ELSE greatest(0.05, 1.0 - (x.kd - 30) / 30.0) END) >= 1.25 * m.volume * (CASE WHEN m.kd <= 30 THEN 1.0 ELSE greatest(0.05, 1.0 - (m.kd - 30) / 30.0) END)
    AND x.volume * (CASE WHEN x.kd <= 30 THEN 1.0 ELSE greatest(0.05, 1.0 - (x.kd - 30) / 30.0) END) - m.volume * (CASE WHEN m.kd <= 30 THEN 1.0 ELSE greatest(0.05, 1.0 - (m.kd - 30) / 30.0) END) >= 50))),
lv AS (SELECT * FROM rk WHERE k = 1 AND need <> 'shop'),
cl AS (SELECT x.market, x.keyword, x.grp, x.words AS a, y.keyword AS other, y.words AS b, row_number() OVER (PARTITION BY x.market, x.grp ORDER BY round(s, 9) DESC, y.volume DESC, y.grp) AS k FROM
  (SELECT x, y, len(list_intersect(x.words, y.words)) / CAST(len(list_distinct(list_concat(x.words, y.words))) AS DOUBLE) AS s FROM lv x JOIN lv y ON x.market = y.market AND x.grp <> y.grp) p WHERE s >= 0.5 AND s < 1 AND (x.volume < y.volume OR (x.volume = y.volume AND x.grp > y.grp))),
kd AS (SELECT *, list_concat(list_filter(a, lambda t: NOT list_contains(b, t)), list_filter(b, lambda t: NOT list_contains(a, t))) AS apart, len(list_filter(a, lambda t: list_contains(b, t) AND t IN ('red', 'blue'))) > 0 AS islist FROM cl WHERE k = 1),
kk AS (SELECT *, len(list_filter(apart, lambda t: t NOT IN ('small', 'large'))) = 0 AS tone, len(list_filter(apart, lambda t: t NOT IN ('small', 'large', 'red', 'blue'))) = 0 AS lists FROM kd)
SELECT market, keyword, grp AS "group", 'same_query' AS finding, 'merged' AS action, other FROM rk WHERE k > 1
UNION ALL SELECT market, keyword, grp, 'duplicate', 'removed', other FROM dp WHERE k > 1 AND grp <> other AND NOT is_main
UNION ALL SELECT market, keyword, grp, 'shop_member', 'split', '' FROM g WHERE need = 'shop' AND NOT is_main
UNION ALL SELECT market, keyword, grp, 'main_changed', 'main_changed', other FROM bm WHERE k = 1
UNION ALL SELECT market, keyword, grp, CASE WHEN len(apart) > 0 AND NOT lists THEN 'segment_modifier' WHEN len(apart) > 0 AND (NOT tone OR islist) THEN 'tone_variant' ELSE 'possible_duplicate' END,
  CASE WHEN len(apart) > 0 AND NOT lists THEN 'kept_apart' WHEN len(apart) > 0 AND (NOT tone OR islist) THEN 'merged' ELSE 'check_serp' END, other FROM kk
"""
)


def pillar_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as pillars, numbered by what their parts own."""
    return To.pillar_numbers(_phrases(spark, sf_dir).select(F.col("market").alias("pillar"), "volume"))


PILLAR_NUMBERS = _KW + " SELECT market AS pillar, 'P' || lpad(CAST(row_number() OVER (ORDER BY sum(volume) DESC, market) AS VARCHAR), 2, '0') AS number FROM kw GROUP BY market"


def need_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets, theme, need and fit of phrases made of parts that the example taxonomy knows."""
    kw = _phrases(spark, sf_dir)
    pick = lambda salt, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.pmod(F.floor(F.col("id") / salt), F.lit(len(v))) + 1).cast("int"))
    phrase = F.trim(
        F.regexp_replace(
            F.concat_ws(
                " ", pick(1, "how to", "best", "buy", "", "what to write"), pick(5, "christmas", "mothers day", ""), pick(15, "funny", ""),
                pick(30, "mugs", "gifts", "facts"), F.lit("for"), pick(90, "dad", "teacher", "dog lovers"),
            ),
            r"\s+", " ",
        )
    )
    x = kw.select("id", phrase.alias("norm"))
    x = x.withColumn("f", X.facets(F.col("norm"), X.EXAMPLE)).withColumn("theme", X.theme(F.col("norm"), F.col("f"), X.EXAMPLE)).withColumn(
        "need", X.need(F.col("norm"), F.col("f"), F.col("theme"), X.EXAMPLE),
    )
    return x.select(
        "id", "norm", "f.occasion", "f.interest", "f.recipient", "f.product", "f.style", "theme", "need", P.need_fit(F.col("need")).alias("fit"),
    )


NEED_ROWS = (
    _KW
    + """, pk AS (SELECT id, id % 5 AS a, id // 5 % 3 AS b, id // 15 % 2 AS c, id // 30 % 3 AS d, id // 90 % 3 AS e FROM kw),
n AS (SELECT *, trim(regexp_replace(['how to', 'best', 'buy', '', 'what to write'][a + 1] || ' ' || ['christmas', 'mothers day', ''][b + 1] || ' ' || ['funny', ''][c + 1] || ' ' || ['mugs', 'gifts', 'facts'][d + 1] || ' for ' || ['dad', 'teacher', 'dog lovers'][e + 1], '\\s+', ' ', 'g')) AS norm FROM pk),
t AS (SELECT *, CASE WHEN a = 4 THEN 'messages' WHEN d = 2 THEN 'facts' WHEN d = 1 THEN 'gifts' ELSE '' END AS theme FROM n),
d AS (SELECT *, CASE WHEN a = 0 THEN 'how_to' WHEN a = 4 THEN 'copy_ideas' WHEN a = 1 THEN 'choose' WHEN a = 2 OR d = 0 THEN 'shop' WHEN theme = 'facts' THEN 'info' WHEN theme = 'gifts' THEN 'inspire' ELSE 'inspire' END AS need FROM t)
SELECT id, norm, ['christmas', 'mothers-day', ''][b + 1] AS occasion, CASE WHEN e = 2 THEN 'dogs' ELSE '' END AS interest, ['dad', 'teacher', ''][e + 1] AS recipient, CASE WHEN d = 0 THEN 'mug' ELSE '' END AS product, ['funny', ''][c + 1] AS style, theme, need,
  CASE need WHEN 'shop' THEN 'low' WHEN 'info' THEN 'medium' ELSE 'high' END AS fit FROM d
"""
)


def keyword_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole keyword pipeline over part names: the plan."""
    p = table(spark, sf_dir, "part")
    text = F.concat_ws(
        " ",
        F.element_at(
            F.array(*[F.lit(x) for x in ("christmas", "best", "how to wrap", "easter gifts for mom", "")]),
            (F.pmod(F.col("p_partkey"), F.lit(5)) + 1).cast("int"),
        ),
        "p_name",
    )
    rows = p.select(
        F.trim(text).alias("keyword"), F.lit("us").alias("market"), F.floor("p_retailprice").cast("long").alias("volume"), F.lit(3).alias("vclass"), F.col("p_size").cast("double").alias("kd"), F.lit(None).cast("double").alias("position"), F.lit("").alias("url"), F.lit("part").alias("src"), F.lit("table").alias("tool"),
    )
    out = pipeline.run(rows)["plan"]
    return out.select("stt", "slug", "pillar_id", "role", "post_type", "need", "volume", "priority", "bucket")


QUERIES = {
    f.__name__: f for f in (
        topic_words, duplicate_slugs, category_counts, label_mix, bucketed_volumes, plan_signatures, back_check, grouping_audit, pillar_numbers,
        need_rows, keyword_pipeline,
    )
}
ORACLE = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
