"""Queries on what a run takes in and why: scope rules, decisions, given groups, months, facets, slugs, plan cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import numbers as N
from ..functions import text as T
from ..operators import links as L
from ..operators import priors as Pr
from ..operators import review as R
from ..operators import scope as Sc
from .phrases import _KW, _phrases, normal_sql, table

SCOPE = Sc.Scope(
    min_volume=950, max_volume=1080, max_kd=45.0, include=("red|blue|small|large|green",), exclude=("tin$", "^old"),
    only=(("size_class", ("small", "medium")),), drop_shop=True,
)


def _pick(values: tuple, n: int, salt: int = 0):
    """One of the values by the part's number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col("id") + salt, F.lit(n)) + 1).cast("int"))


def _offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as offered keywords with market, need, known volume, given group and decision by the part's number."""
    kw = _phrases(spark, sf_dir).drop("market")
    act = F.when(F.col("id") % 13 == 0, "keep_keyword").when(F.col("id") % 29 == 0, "drop_keyword")
    return kw.select(
        "id", "keyword", "norm", _pick(("us", "uk", "all", "fr"), 4).alias("market"), "volume", F.when(F.col("id") % 7 == 0, -1).otherwise(2).alias("vclass"), F.when(F.col("id") % 11 != 0, F.col("kd")).alias("kd"),
        _pick(("choose", "shop", "info"), 3).alias("need"), (F.col("id") % 17 == 0).alias("prior"), act.alias("action"), F.when(
            act.isNotNull(), F.concat(F.lit("d"), F.col("id").cast("string")),
        ).alias("decision_id"),
        F.when(F.col("kd") < 15, "small").when(F.col("kd") < 35, "medium").otherwise("large").alias("size_class"),
    )


def ingest_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name with the one reason it goes for, what a decision lifted, and the rule that a grouped one meets."""
    return Sc.scoped(_offered(spark, sf_dir), SCOPE).select("id", "reason", "lifted", "hit")


_OFFERED = (
    _KW
    + """, o AS (SELECT id, keyword, lower(keyword) AS low, norm, ['us', 'uk', 'all', 'fr'][id % 4 + 1] AS market, volume, CASE WHEN id % 7 = 0 THEN -1 ELSE 2 END AS vclass, CASE WHEN id % 11 <> 0 THEN kd END AS kd,
  ['choose', 'shop', 'info'][id % 3 + 1] AS need, id % 17 = 0 AS prior, CASE WHEN id % 13 = 0 THEN 'keep_keyword' WHEN id % 29 = 0 THEN 'drop_keyword' END AS action,
  CASE WHEN id % 13 = 0 OR id % 29 = 0 THEN 'd' || id END AS decision_id, CASE WHEN kd < 15 THEN 'small' WHEN kd < 35 THEN 'medium' ELSE 'large' END AS size_class FROM kw)"""
)
INGEST_ROUTING = (
    _OFFERED
    + """, e AS (SELECT *, coalesce(CASE WHEN vclass >= 0 AND volume < 950 THEN 'filter:min_volume' WHEN vclass >= 0 AND volume > 1080 THEN 'filter:max_volume' WHEN kd > 45 THEN 'filter:max_kd'
  WHEN NOT (regexp_matches(norm, 'red|blue|small|large|green') OR regexp_matches(low, 'red|blue|small|large|green')) THEN 'filter:include_no_match'
  WHEN regexp_matches(norm, 'tin$') OR regexp_matches(low, 'tin$') THEN 'filter:exclude:tin$' WHEN regexp_matches(norm, '^old') OR regexp_matches(low, '^old') THEN 'filter:exclude:^old' END) AS early,
  CASE WHEN size_class = 'large' THEN 'filter:only' WHEN need = 'shop' THEN 'filter:drop_shop' END AS late, action IS NOT DISTINCT FROM 'keep_keyword' AS keep FROM o),
m AS (SELECT *, CASE WHEN market = 'fr' THEN 'market:fr' WHEN action = 'drop_keyword' THEN 'decision:' || decision_id END AS first FROM e)
SELECT id, coalesce(first, CASE WHEN NOT keep AND NOT prior THEN early END, CASE WHEN prior OR (keep AND late = 'filter:drop_shop') THEN NULL ELSE late END) AS reason,
  CASE WHEN first IS NULL AND keep THEN coalesce(early, CASE WHEN late = 'filter:drop_shop' THEN late END) END AS lifted, CASE WHEN first IS NULL AND prior AND NOT keep THEN coalesce(early, late) END AS hit FROM m
"""
)


def ingest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep and drop decisions on part names, one for every part: found, of several markets, stale or clashing."""
    kw = _phrases(spark, sf_dir)
    rows = kw.select(
        F.col("norm").alias("keyword"),
        F.when(F.length("norm") % 2 == 0, "us").otherwise(F.when(F.col("id") % 2 == 0, "us").otherwise("uk")).alias("market"),
    ).distinct()
    d = kw.select(
        F.concat(F.lit("d"), F.col("id").cast("string")).alias("decision_id"), F.when(F.col("id") % 2 == 0, "keep_keyword").otherwise("drop_keyword").alias("action"), F.when(F.col("id") % 3 == 0, "us").otherwise("").alias("market"),
        F.when(F.col("id") % 5 == 0, F.concat("norm", F.lit(" missing"))).otherwise(F.col("norm")).alias("keyword"),
    )
    return Sc.decided_at_ingest(rows, d)[1]


INGEST_DECISIONS = (
    _KW
    + """, r AS (SELECT DISTINCT norm AS keyword, CASE WHEN length(norm) % 2 = 0 THEN 'us' WHEN id % 2 = 0 THEN 'us' ELSE 'uk' END AS market FROM kw),
d AS (SELECT 'd' || id AS decision_id, CASE WHEN id % 2 = 0 THEN 'keep_keyword' ELSE 'drop_keyword' END AS action, CASE WHEN id % 3 = 0 THEN 'us' ELSE '' END AS dm, CASE WHEN id % 5 = 0 THEN norm || ' missing' ELSE norm END AS keyword FROM kw),
f AS (SELECT d.decision_id, d.action, d.keyword, count(r.market) AS n, min(r.market) AS market FROM d LEFT JOIN r ON r.keyword = d.keyword AND (d.dm = '' OR d.dm = r.market) GROUP BY ALL),
c AS (SELECT market, keyword, count(DISTINCT action) > 1 AS clash FROM f WHERE n = 1 GROUP BY ALL)
SELECT f.decision_id, f.action, CASE WHEN f.n = 0 THEN 'stale' WHEN f.n > 1 THEN 'invalid' WHEN c.clash THEN 'conflict' ELSE 'found' END AS status FROM f LEFT JOIN c ON f.n = 1 AND c.market = f.market AND c.keyword = f.keyword
"""
)


def prior_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts grouped by type and brand's first digit as given groups: each one's place in its cluster, the main first."""
    kw = _phrases(spark, sf_dir)
    rows = kw.select(
        "id", F.when(F.col("id") % 5 != 0, F.col("type")).alias("group"), F.substring("market", 1, 7).alias("market"), "keyword", "volume",
        (F.col("id") % 19 == 0).alias("is_main"),
    )
    return Pr.prior_clusters(rows, "id").select("id", "group", "market", F.col("place").cast("long").alias("place"), "is_seed", "split")


PRIOR_MEMBERS = (
    _KW
    + """, r AS (SELECT id, type AS "group", substr(market, 1, 7) AS market, keyword, volume, id % 19 = 0 AS is_main FROM kw WHERE id % 5 <> 0), s AS (SELECT "group", count(DISTINCT market) > 1 AS split FROM r GROUP BY 1)
SELECT id, "group", market, row_number() OVER w AS place, row_number() OVER w = 1 AS is_seed, split FROM r JOIN s USING ("group") WINDOW w AS (PARTITION BY "group", market ORDER BY is_main DESC, volume DESC, keyword, id)
"""
)


def parent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge candidates by parent topic: a part and the first of its brand, type and size class, in order of volume."""
    kw = _phrases(spark, sf_dir)
    rows = kw.select(
        "id", F.row_number().over(_by_volume()).alias("rank"), "market", F.when(F.col("id") % 4 != 0, F.col("type")).alias("parent"),
        F.when(F.col("kd") < 25, "list").otherwise("info").alias("ngroup"),
    )
    return Pr.parent_hints(rows)


def _by_volume():
    from pyspark.sql import Window

    return Window.partitionBy("market").orderBy(F.desc("volume"), "id")


PARENT_CANDIDATES = (
    _KW
    + """, r AS (SELECT id, row_number() OVER (PARTITION BY market ORDER BY volume DESC, id) AS rank, market, CASE WHEN id % 4 <> 0 THEN type END AS parent, CASE WHEN kd < 25 THEN 'list' ELSE 'info' END AS ngroup FROM kw),
f AS (SELECT market, parent, ngroup, arg_min(id, rank) AS a, min(rank) AS first FROM r WHERE parent IS NOT NULL GROUP BY ALL)
SELECT a, id AS b, parent FROM r JOIN f USING (market, parent, ngroup) WHERE first < rank
"""
)


def month_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of column headers, as planners write them, for every month with orders; five months on; the range of a year's header."""
    months = table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("m")).distinct()
    header = F.concat(F.lit("Searches: "), F.date_format("m", "MMM yyyy"))
    span = F.concat(F.lit("SV trend ("), F.date_format("m", "MM-yyyy"), F.lit(" - "), F.date_format(F.add_months("m", 11), "MM-yyyy"), F.lit(")"))
    x = months.select(header.alias("header"), span.alias("span"))
    month = E.monthly_header(F.col("header"))
    return x.select(
        "header", month.alias("month"), E.month_shift(month, F.lit(5)).alias("later"), E.header_range(F.col("span"))["first"].alias("first"),
        E.header_range(F.col("span"))["last"].alias("last"),
    )


MONTH_HEADERS = """
WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders)
SELECT 'Searches: ' || strftime(m, '%b %Y') AS header, strftime(m, '%Y-%m') AS month, strftime(m + INTERVAL 5 MONTH, '%Y-%m') AS later, strftime(m, '%Y-%m') AS first, strftime(m + INTERVAL 11 MONTH, '%Y-%m') AS last FROM m
"""


def trend_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of part names: exact months where all twelve are there, nothing where some are, else the trend cell, anchored where the header fits."""
    kw = _phrases(spark, sf_dir)
    months = [f"2025-{m:02d}" for m in range(1, 13)]
    k = F.pmod(F.col("id"), F.lit(4))
    keys = F.when(k == 0, F.array(*[F.lit(m) for m in months])).when(
        k == 1, F.array(*[F.lit(m) for m in months[:5]]),
    ).otherwise(F.array().cast("array<string>"))
    monthly = F.map_from_arrays(keys, F.transform(keys, lambda m, i: F.col("volume") + i))
    cell = F.when(
        k == 2, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (F.col("volume") * i).cast("string")), ", "),
    ).when(k == 3, F.lit("[0, 50, 100]"))
    header = F.when(F.col("id") % 8 == 2, "SV trend (01-2025 - 06-2025)").otherwise("Trend")
    got = E.read_trend(monthly, months, cell, header)
    return kw.select(
        "id", F.size(got["values"]).cast("long").alias("n"), F.aggregate(got["values"], F.lit(0.0), lambda a, v: a + v).alias("total"),
        got["scale"].alias("scale"), got["last"].alias("last"),
    )


TREND_READING = (
    _KW
    + """ SELECT id, CAST([12, 0, 6, 3][id % 4 + 1] AS BIGINT) AS n, CAST(CASE id % 4 WHEN 0 THEN 12 * volume + 66 WHEN 1 THEN 0 WHEN 2 THEN 21 * volume ELSE 150 END AS DOUBLE) AS total,
  ['absolute', '', 'absolute', '0-100'][id % 4 + 1] AS scale, CASE WHEN id % 4 = 0 THEN '2025-12' WHEN id % 8 = 2 THEN '2025-06' END AS last FROM kw"""
)


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets that a part names beyond its group's own, those two parts of a brand share, and how specific its words are."""
    kw = _phrases(spark, sf_dir)
    facet = {
        "occasion": F.when(F.col("id") % 2 == 0, "a").otherwise(""), "recipient": F.when(F.col("id") % 3 == 0, "b").otherwise(""),
        "interest": F.when(F.col("id") % 5 == 0, "c"), "product": F.when(F.col("id") % 7 == 0, "d").otherwise(""),
    }
    own = F.element_at(F.array(F.lit("occasion"), F.lit("recipient"), F.lit("product")), (F.col("id") % 3 + 1).cast("int"))
    other = {"occasion": F.lit("a"), "recipient": F.lit("b"), "interest": F.lit("x"), "product": F.lit("")}
    s = N.specificity(F.col("words"), ("small", "large"))
    return kw.select(
        "id", N.narrower_facets(own, facet).cast("long").alias("narrower"),
        N.narrower_facets(own, facet, audiences=None).cast("long").alias("beyond"), N.shared_facets(facet, other).cast("long").alias("shared"),
        s["subject"].cast("long").alias("subject"), s["words"].cast("long").alias("words"),
    )


FACET_COUNTS = (
    _KW
    + """, f AS (SELECT id, words, ['occasion', 'recipient', 'product'][id % 3 + 1] AS own, id % 2 = 0 AS o, id % 3 = 0 AS r, id % 5 = 0 AS i, id % 7 = 0 AS p FROM kw),
n AS (SELECT *, CAST(own <> 'occasion' AND o AS INT) + CAST(own <> 'recipient' AND r AS INT) + CAST(i AS INT) + CAST(own <> 'product' AND p AS INT) AS beyond FROM f)
SELECT id, CAST(CASE WHEN own = 'product' THEN 0 ELSE beyond END AS BIGINT) AS narrower, CAST(beyond AS BIGINT) AS beyond, CAST(CAST(o AS INT) + CAST(r AS INT) AS BIGINT) AS shared,
  CAST(len(list_filter(words, lambda w: w NOT IN ('small', 'large'))) AS BIGINT) AS subject, CAST(len(words) AS BIGINT) AS words FROM n"""
)


def plan_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of part names made unique in order of volume; some names end in a number of their own."""
    kw = _phrases(spark, sf_dir)
    slug = F.concat(T.slugify(F.col("norm")), F.when(F.col("id") % 9 == 0, "-2").when(F.col("id") % 10 == 0, "-3").otherwise(""))
    return L.unique_slugs(kw.select("id", "volume", slug.alias("slug0")), "slug0", [F.desc("volume"), F.asc("id")]).select("id", "slug")


PLAN_SLUGS = (
    _KW
    + r""", s AS (SELECT id, volume, trim(regexp_replace(norm, '[^a-z0-9]+', '-', 'g'), '-') || CASE WHEN id % 9 = 0 THEN '-2' WHEN id % 10 = 0 THEN '-3' ELSE '' END AS base FROM kw),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY volume DESC, id) AS k FROM s),
n AS (SELECT regexp_extract(base, '^(.*)-([0-9]{1,9})$', 1) AS base, list_sort(list(DISTINCT CAST(regexp_extract(base, '^(.*)-([0-9]{1,9})$', 2) AS INT))) AS used FROM k WHERE k = 1 AND regexp_matches(base, '^.+-[1-9][0-9]{0,8}$') GROUP BY 1)
SELECT id, CASE WHEN k = 1 THEN k.base ELSE k.base || '-' || list_reduce(list_concat([CAST(k AS INT)], coalesce(used, [])), lambda a, u: CASE WHEN u >= 2 AND u <= a THEN a + 1 ELSE a END) END AS slug FROM k LEFT JOIN n ON n.base = k.base
"""
)


def plan_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title cells of part names after decisions: empty ones are filled, the team's stay, differing decisions on one cell don't hold."""
    kw = _phrases(spark, sf_dir).groupBy("norm").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    cells = kw.select(
        F.lit("us").alias("market"), F.col("norm").alias("keyword"), F.lit("title").alias("cell"),
        F.when(F.col("id") % 3 == 0, F.lit("ours")).otherwise("").alias("value"),
    )
    d = kw.select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("decision_id"), "norm", "id", F.lit("new").alias("value"))
    again = kw.filter("id % 5 = 0").select(
        F.concat(F.lit("b"), F.col("id").cast("string")).alias("decision_id"), "norm", "id",
        F.when(F.col("id") % 2 == 0, "new").otherwise("other").alias("value"),
    )
    decisions = d.unionByName(again).select(
        "decision_id", F.lit("set_title").alias("action"), F.lit("").alias("market"), F.col("norm").alias("keyword"), "value",
        F.lit("r").alias("reason"), F.when(F.col("id") % 7 == 0, "").otherwise("e").alias("evidence"), F.lit("ann").alias("author"),
    )
    found, _ = R.fill_cells(cells, decisions)
    return found.select("keyword", "value")


PLAN_CELLS = (
    _KW
    + """, n AS (SELECT norm AS keyword, min(id) AS id FROM kw GROUP BY norm)
SELECT keyword, CASE WHEN id % 3 = 0 THEN 'ours' WHEN id % 7 = 0 OR (id % 5 = 0 AND id % 2 <> 0) THEN '' ELSE 'new' END AS value FROM n
"""
)


def name_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each brand's group of a type is named after its first part and not after its greatest."""
    kw = _phrases(spark, sf_dir)
    row = F.struct(
        F.col("norm").alias("keyword"), "volume", (F.col("volume") * N.fit(F.col("kd"))).alias("winnable"),
        (F.col("id") % 5).cast("double").alias("fluency"), (F.col("id") % 4 == 0).alias("fixed"),
    )
    x = kw.withColumn("row", row).groupBy(F.concat_ws("|", "market", "type").alias("cluster")).agg(
        F.min_by("row", "id").alias("seed"), F.max_by("row", F.struct("volume", "id")).alias("top"), (F.min("id") % 6 == 0).alias("given_main"), F.max((F.col("id") % 6 == 0).cast("int")).cast("boolean").alias("given")
    )
    return Pr.seed_basis(x)


NAME_BASIS = (
    _KW
    + """, r AS (SELECT market || '|' || type AS cluster, id, {'keyword': norm, 'volume': volume, 'winnable': volume * CASE WHEN kd <= 30 THEN 1.0 ELSE greatest(0.05, 1.0 - (kd - 30) / 30.0) END, 'fluency': id % 5, 'fixed': id % 4 = 0} AS row FROM kw),
c AS (SELECT cluster, arg_min(row, id) AS s, arg_max(row, row.volume * 1000000000 + id) AS t, min(id) % 6 = 0 AS gm, bool_or(id % 6 = 0) AS g FROM r GROUP BY cluster)
SELECT cluster, CASE WHEN gm THEN 'given main' WHEN g THEN 'better main than the given one' WHEN s.volume >= t.volume THEN 'max_volume' WHEN t.fixed AND NOT s.fixed THEN 'spelled correctly' WHEN s.winnable > t.winnable * 1.2 THEN 'easier to rank'
  WHEN s.fluency > t.fluency THEN 'more natural phrasing' ELSE 'plain phrasing' END AS basis FROM c
"""
)


def keyword_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where part names are in a plan: their type is the cluster, some of which are merged, some in no plan."""
    kw = _phrases(spark, sf_dir)
    types = kw.groupBy("type").agg(F.min("id").alias("k"))
    topics = types.select(
        F.col("type").alias("cluster"), F.when(F.col("k") % 5 == 0, "skip").when(F.col("k") % 5 == 1, "backlog").otherwise("post").alias("role"),
        F.when(F.col("k") % 5 > 2, F.col("type")).otherwise("").alias("slug"),
        F.when(F.col("k") % 5 == 2, F.lit("hub")).otherwise("").alias("merged_into"),
    )
    posts = types.select(F.col("type").alias("slug"), F.col("k").alias("stt"), F.concat(F.lit("main of "), "type").alias("main")).unionByName(
        spark.createDataFrame([("hub", 0, "hub post")], "slug string, stt long, main string")
    )
    return R.placed_keywords(
        kw.select("market", F.concat_ws(" ", "norm", F.col("id").cast("string")).alias("keyword"), F.col("type").alias("cluster")), topics, posts,
    )


KEYWORD_PLACES = (
    _KW
    + """, t AS (SELECT type, min(id) AS k FROM kw GROUP BY type)
SELECT market, norm || ' ' || id AS keyword, CASE WHEN k % 5 > 2 THEN k WHEN k % 5 = 2 THEN 0 END AS stt, CASE WHEN k % 5 > 2 THEN 'main of ' || kw.type WHEN k % 5 = 2 THEN 'hub post' END AS post,
  CASE WHEN k % 5 >= 2 THEN '' WHEN k % 5 = 0 THEN 'shop pages answer it' ELSE 'backlog' END AS why FROM kw JOIN t ON t.type = kw.type
"""
)


def grouped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given groups' rows beside the exports': their own figure loses to an export's, an absent one is volume 0 and estimated."""
    kw = _phrases(spark, sf_dir)
    written = F.when(F.col("id") % 3 == 0, "").when(
        F.col("id") % 3 == 1, F.concat(F.lit("<"), F.col("volume").cast("string")),
    ).otherwise(F.col("volume").cast("string"))
    given = kw.filter("id % 2 = 0").select(
        F.col("type").alias("group"), F.when(F.col("id") % 4 == 0, "US ").otherwise("").alias("market"), "keyword", written.alias("volume"),
        F.col("kd").cast("string").alias("kd"), (F.col("id") % 10 == 0).alias("is_main"),
    )
    exports = kw.filter("id % 5 = 0").select("keyword", F.lit("us").alias("market"), "volume", F.lit(2).alias("vclass"), "kd")
    rows = Pr.with_priors(exports, Pr.prior_rows(given))
    return rows.groupBy("market", "part", "vclass").agg(
        F.count("*").alias("rows"), F.sum("volume").alias("volume"), F.count("group").alias("grouped"),
        F.sum(F.col("is_main").cast("long")).alias("mains"),
    )


GROUPED_ROWS = (
    _KW
    + """, g AS (SELECT CASE WHEN id % 4 = 0 THEN 'us' ELSE 'all' END AS market, 1 AS part, CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END AS vclass, CASE WHEN id % 3 = 0 THEN 0 ELSE volume END AS volume, type AS grp, id % 10 = 0 AS is_main FROM kw WHERE id % 2 = 0
  UNION ALL SELECT 'us', 0, 2, volume, NULL, FALSE FROM kw WHERE id % 5 = 0)
SELECT market, part, vclass, count(*) AS rows, CAST(sum(volume) AS BIGINT) AS volume, count(grp) AS grouped, CAST(sum(CAST(is_main AS INT)) AS BIGINT) AS mains FROM g GROUP BY ALL
"""
)

QUERIES = {
    f.__name__: f for f in (
        ingest_routing, ingest_decisions, prior_members, parent_candidates, month_headers, trend_reading, facet_counts, plan_slugs, plan_cells,
        name_basis, keyword_places, grouped_rows,
    )
}
ORACLE = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
