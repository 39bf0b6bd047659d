"""Queries on phrases: normal forms, tokens, variants, sources, routing, similarity, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import cluster as C
from ..operators import cover as V
from ..operators import merge as M
from ..operators import similarity as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: RE2 form of functions.text.normal_form: decimals are saved before dots go, twice for runs of digits and dots.
def normal_sql(c: str) -> str:
    x = f"replace(replace(replace(lower({c}), '’', ''''), '‘', ''''), '`', '''')"
    x = f"regexp_replace({x}, '''s([^\\p{{L}}\\p{{N}}_]|$)', 's\\1', 'g')"
    x = f"replace({x}, '''', '')"
    x = f"regexp_replace({x}, '[-_/]', ' ', 'g')"
    x = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s&.]', ' ', 'g')"
    x = f"replace({x}, '&', ' and ')"
    for _ in range(2):
        x = f"regexp_replace({x}, '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g')"
    x = f"replace(replace({x}, '.', ' '), chr(1), '.')"
    x = f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}_])(what|when|where|who|how|that|there)s([^\\p{{L}}\\p{{N}}_]|$)', '\\1\\2 is\\3', 'g')"
    x = f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}_])(what|when|where|who|how|that|there)s([^\\p{{L}}\\p{{N}}_]|$)', '\\1\\2 is\\3', 'g')"
    x = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"regexp_replace({x}, '^(?:(?:hey|ok|okay|ask) )?(?:google|alexa|siri|bing|chatgpt) ((?:what|when|where|who|why|how|which|is|are|do|does|did|can)([^\\p{{L}}\\p{{N}}_].*)?)$', '\\1')"


def stem_sql(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN substr({t}, 1, length({t}) - 3) || 'y' "
        f"WHEN length({t}) > 4 AND regexp_matches({t}, '(ches|shes|sses|xes|zes)$') THEN substr({t}, 1, length({t}) - 2) "
        f"WHEN length({t}) > 3 AND {t} LIKE '%s' AND NOT regexp_matches({t}, '(ss|us|is)$') THEN substr({t}, 1, length({t}) - 1) ELSE {t} END"
    )


def tokens_sql(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda t: t <> '')"


def canonical_sql(norm: str) -> str:
    return f"list_transform(list_filter({tokens_sql(norm)}, lambda t: NOT regexp_matches(t, '^(19|20)[0-9]{{2}}$')), lambda t: {stem_sql('t')})"


def phrase_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form of every document's whole text, as a digest, and its number of words."""
    norm = T.normal_form(F.translate(F.col("text"), "’‘`", "'''"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id"), norm.alias("n")).select(
        "doc_id", F.md5("n").alias("norm_md5"), F.size(T.tokens(F.col("n"))).cast("long").alias("n_tokens"),
    )


PHRASE_NORMALIZE = f"""
SELECT doc_id, md5(n) AS norm_md5, CAST(len({tokens_sql('n')}) AS BIGINT) AS n_tokens FROM (SELECT doc_id, {normal_sql('text')} AS n FROM documents)
"""


def token_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names with their stems and how many parts hold them."""
    words = table(spark, sf_dir, "part").select(F.explode(F.array_distinct(T.tokens(T.normal_form(F.col("p_name"))))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("parts")).select("token", T.stem(F.col("token")).alias("stem"), "parts")


TOKEN_STEM = f"""
SELECT t AS token, {stem_sql('t')} AS stem, count(*) AS parts FROM (SELECT unnest(list_distinct({tokens_sql(normal_sql('p_name'))})) AS t FROM part) GROUP BY t
"""


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as keywords: market = brand, volume = whole price, kd = size."""
    p = table(spark, sf_dir, "part")
    norm = T.normal_form(F.col("p_name"))
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("market"), F.col("p_name").alias("keyword"), norm.alias("norm"), T.variant_key(T.canonical_tokens(norm)).alias("vkey"),
        T.word_set(T.canonical_tokens(norm)).alias("words"), F.floor("p_retailprice").cast("long").alias("volume"), F.col("p_size").cast("double").alias("kd"), F.col("p_type").alias("type"),
    )


_KW = f"""
WITH p AS (SELECT p_partkey AS id, p_brand AS market, p_name AS keyword, {normal_sql('p_name')} AS norm, CAST(floor(p_retailprice) AS BIGINT) AS volume, CAST(p_size AS DOUBLE) AS kd, p_type AS type FROM part),
kw AS (SELECT *, array_to_string(list_sort({canonical_sql('norm')}), ' ') AS vkey, list_sort(list_distinct({canonical_sql('norm')})) AS words FROM p)
"""


def variant_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which phrases mean the same thing, and how much volume each group owns: id by volume, A/B/C by rank."""
    rows = _phrases(spark, sf_dir)
    groups = rows.groupBy("market", "vkey").agg(
        F.max_by(
            "keyword", F.struct("volume", -F.col("id")),
        ).alias("main"), F.sum("volume").alias("volume"), F.count("*").alias("phrases"), F.min("kd").alias("kd_min")
    )
    ranked = C.global_rank(groups, [F.desc("volume"), F.asc("market"), F.asc("vkey")], "rank")
    n = groups.agg(F.count("*").alias("_n"))
    out = ranked.crossJoin(F.broadcast(n))
    return out.select(
        F.format_string("C%04d", "rank").alias("cluster_id"), "market", "vkey", "main", "volume", "phrases", "kd_min",
        C.bucket(F.col("rank"), F.col("_n")).alias("bucket"),
    )


VARIANT_DEDUPE = (
    _KW
    + """, g AS (SELECT market, vkey, arg_max(keyword, volume * 10000000000 - id) AS main, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS phrases, min(kd) AS kd_min FROM kw GROUP BY market, vkey),
r AS (SELECT *, row_number() OVER (ORDER BY volume DESC, market, vkey) AS rank, count(*) OVER () AS n FROM g)
SELECT printf('C%04d', rank) AS cluster_id, market, vkey, main, volume, phrases, kd_min, CASE WHEN rank <= n * 0.2 THEN 'A' WHEN rank <= n * 0.5 THEN 'B' ELSE 'C' END AS bucket FROM r
"""
)


def variant_volume_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and distinct volume sums of each variant group."""
    merged = M.merge_variants(_phrases(spark, sf_dir), ["market", "vkey"], "keyword", "volume", "id")
    plain = F.aggregate("variant_volumes", F.col("volume"), lambda a, x: a + x)
    return merged.select(
        "market", "vkey", F.col("keyword").alias("main"), plain.alias("volume"),
        M.distinct_volume(F.col("volume"), F.col("variant_volumes")).alias("volume_distinct"), F.size("variants").cast("long").alias("variants"),
    )


VARIANT_VOLUME_DISTINCT = (
    _KW
    + """SELECT market, vkey, arg_max(keyword, volume * 10000000000 - id) AS main, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(DISTINCT volume) AS BIGINT) AS volume_distinct, count(*) - 1 AS variants FROM kw GROUP BY market, vkey"""
)


def source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and type as rows of one keyword: class by type of value, difficulty and position from the id."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        "user_id", "event_type", F.col("event_id").alias("idx"), F.pmod(F.col("event_id"), F.lit(4)).cast("int").alias("vclass"), F.floor("value").cast("long").alias("volume"),
        F.when(F.pmod(F.col("event_id"), F.lit(3)) == 0, F.lit(None)).otherwise(F.pmod(F.col("event_id"), F.lit(90))).cast("double").alias("kd"),
        F.when(F.pmod(F.col("event_id"), F.lit(5)) == 0, F.lit(None)).otherwise(
            F.pmod(F.col("event_id"), F.lit(50)) + 1
        ).cast("double").alias("position"),
        F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), F.concat(
            F.lit("f"), F.pmod(F.col("event_id"), F.lit(3)).cast("string"),
        ).alias("src"), F.lit("t").alias("tool"),
    )
    m = M.merge_sources(rows, ["user_id", "event_type"])
    return m.select("user_id", "event_type", F.col("vclass").cast("long").alias("vclass"), "volume", "position", "first_seen", "n_rows")


SOURCE_MERGE = """
WITH r AS (SELECT user_id, event_type, event_id AS idx, event_id % 4 AS vclass, CAST(floor(value) AS BIGINT) AS volume, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 50 + 1 AS DOUBLE) END AS position FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY vclass DESC, volume DESC, idx) AS rn FROM r)
SELECT user_id, event_type, max(vclass) FILTER (WHERE rn = 1) AS vclass, max(volume) FILTER (WHERE rn = 1) AS volume, min(position) AS position, min(idx) AS first_seen, count(*) AS n_rows FROM k GROUP BY user_id, event_type
"""

#: Rules with the literals that any match holds.
_NOISE = [
    ("account", r"\b(login|password|refund)\b", ("login", "password", "refund")), ("local", r"\b(near me|nearby)\b", ("near",)),
    ("explicit", r"\b(nude|xxx)\b", ("nude", "xxx")), ("url", r"https?://|www\.", ("http", "www.")),
]


def reason_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is kept or excluded for exactly one reason, the first that applies."""
    low = F.lower(F.coalesce("text", F.lit("")))
    # no text of fewer characters has so many words
    many = (F.length(low) > 10_000) & (F.regexp_count(low, F.lit(r"[^\s]+")) > 5000)
    rules = [
        ("empty", ~F.rlike(low, F.lit(r"[^\s]"))), *[(n, T.matches(low, p, hints)) for n, p, hints in _NOISE], ("too long", many),
        ("language", T.non_ascii_ratio(F.coalesce("text", F.lit(""))) > 0.3),
    ]
    return M.route(table(spark, sf_dir, "documents"), rules).select("doc_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


REASON_ROUTING = r"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, coalesce(text, '') AS x, len(regexp_extract_all(lower(coalesce(text, '')), '[^\s]+')) AS w FROM documents),
r AS (SELECT doc_id, CASE WHEN w = 0 THEN 'empty' WHEN regexp_matches(t, '\b(login|password|refund)\b') THEN 'account' WHEN regexp_matches(t, '\b(near me|nearby)\b') THEN 'local'
  WHEN regexp_matches(t, '\b(nude|xxx)\b') THEN 'explicit' WHEN regexp_matches(t, 'https?://|www\.') THEN 'url' WHEN w > 5000 THEN 'too long'
  WHEN length(regexp_replace(x, '[^\p{L}]', '', 'g')) > 0 AND (length(regexp_replace(x, '[^\p{L}]', '', 'g')) - length(regexp_replace(x, '[^A-Za-z]', '', 'g'))) / CAST(length(regexp_replace(x, '[^\p{L}]', '', 'g')) AS DOUBLE) > 0.3 THEN 'language'
  ELSE 'kept' END AS reason FROM d)
SELECT doc_id, reason FROM r
"""


def noise_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters beyond ASCII by language: documents above the limit, and all."""
    ratio = T.non_ascii_ratio(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(ratio > 0.05).alias("above"), F.count("*").alias("documents"))


NOISE_RATIO = r"""
SELECT lang, count(*) FILTER (WHERE l > 0 AND (l - a) / CAST(l AS DOUBLE) > 0.05) AS above, count(*) AS documents
FROM (SELECT lang, length(regexp_replace(coalesce(text, ''), '[^\p{L}]', '', 'g')) AS l, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS a FROM documents) GROUP BY lang
"""

WEAK = ["small", "large", "red", "blue", "green"]


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names with a guard (first letter), words, volume and difficulty."""
    kw = _phrases(spark, sf_dir)
    d = kw.groupBy("norm").agg(F.sum("volume").alias("volume"), F.min("kd").alias("kd"), F.first("words").alias("words"))
    return d.select(F.col("norm").alias("id"), F.lit("all").alias("guard"), "words", "volume", "kd")


_NAMES = _KW + ", nm AS (SELECT norm AS id, CAST(sum(volume) AS BIGINT) AS volume, min(kd) AS kd, any_value(words) AS words FROM kw GROUP BY norm)"
_WEIGHT = "list_sum(list_transform({s}, lambda t: CASE WHEN t IN ('small', 'large', 'red', 'blue', 'green') THEN 3 ELSE 10 END))"
_PAIRS = (
    ", pr AS (SELECT a.id AS a, b.id AS b, coalesce("
    + _WEIGHT.format(s="list_intersect(a.words, b.words)")
    + ", 0) / CAST("
    + _WEIGHT.format(s="list_distinct(list_concat(a.words, b.words))")
    + " AS DOUBLE) AS similarity FROM nm a JOIN nm b ON a.id < b.id)"
)


def weighted_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part names at weighted Jaccard 0.45 or more, by the prefix join."""
    pairs = S.similar_pairs(_names(spark, sf_dir), "id", "words", ["guard"], 0.45, WEAK)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


WEIGHTED_JACCARD_PAIRS = _NAMES + _PAIRS + " SELECT a, b, round(similarity, 6) AS similarity FROM pr WHERE similarity >= 0.45"


def merge_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge candidates: pairs in the band below the clustering threshold."""
    pairs = S.similar_pairs(_names(spark, sf_dir), "id", "words", ["guard"], 0.34, WEAK, below=0.6)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


MERGE_BAND = _NAMES + _PAIRS + " SELECT a, b, round(similarity, 6) AS similarity FROM pr WHERE similarity >= 0.34 AND similarity < 0.6"


def prefix_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unweighted prefix join over part types as word sets."""
    p = table(spark, sf_dir, "part").select(T.normal_form(F.concat_ws(" ", "p_type", "p_name")).alias("id")).distinct()
    rows = p.select("id", F.lit(1).alias("g"), T.word_set(T.tokens(F.col("id"))).alias("words"))
    return S.similar_pairs(rows, "id", "words", ["g"], 0.75).select("a", "b", F.round("similarity", 6).alias("similarity"))


PREFIX_JOIN_PAIRS = f"""
WITH p AS (SELECT DISTINCT {normal_sql("p_type || ' ' || p_name")} AS id FROM part), w AS (SELECT id, list_distinct({tokens_sql('id')}) AS s FROM p)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE), 6) AS similarity
FROM w a JOIN w b ON a.id < b.id WHERE len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE) >= 0.75
"""


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share at least four parts, as keywords that share results."""
    return S.overlap_pairs(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey", 4)


OVERLAP_PAIRS = """
WITH i AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
SELECT x.s AS a, y.s AS b, count(*) AS shared FROM i x JOIN i y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2 HAVING count(*) >= 4
"""


def keep_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with close words that share fewer than sixty orders, none included."""
    names = _phrases(spark, sf_dir).select("id", F.lit(1).alias("g"), "norm", "words")
    rep = names.groupBy("norm", "g").agg(F.first("words").alias("words")).withColumnRenamed("norm", "nid")
    items = table(spark, sf_dir, "lineitem").join(names, F.col("l_partkey") == F.col("id")).select(
        F.col("norm").alias("nid"), F.col("l_orderkey").alias("item"),
    ).distinct()
    return S.keep_apart(rep, "nid", "words", ["g"], items, "item", 60, close=0.3).select("a", "b", F.col("shared").cast("long").alias("shared"))


KEEP_APART = (
    _KW
    + """, n AS (SELECT norm AS nid, any_value(words) AS s FROM kw GROUP BY norm), i AS (SELECT DISTINCT kw.norm AS nid, l_orderkey AS item FROM lineitem JOIN kw ON l_partkey = kw.id),
h AS (SELECT * FROM n WHERE nid IN (SELECT nid FROM i)), c AS (SELECT x.nid AS a, y.nid AS b, count(*) AS shared FROM i x JOIN i y ON x.item = y.item AND x.nid < y.nid GROUP BY 1, 2)
SELECT x.nid AS a, y.nid AS b, coalesce(c.shared, 0) AS shared FROM h x JOIN h y ON x.nid < y.nid LEFT JOIN c ON c.a = x.nid AND c.b = y.nid
WHERE len(list_intersect(x.s, y.s)) / CAST(len(list_distinct(list_concat(x.s, y.s))) AS DOUBLE) >= 0.3 AND coalesce(c.shared, 0) < 60
"""
)


def leader_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clustering of part names in volume order by weighted Jaccard; tested against the plain loop."""
    names = _names(spark, sf_dir)
    ranked = C.global_rank(names, [F.desc("volume"), F.asc("id")], "rank")
    pairs = S.similar_pairs(names, "id", "words", ["guard"], 0.45, WEAK)
    ranks = ranked.select("id", "rank")
    placed = pairs.join(ranks.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(
        ranks.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b",
    )
    first, later = F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")), F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a"))
    edges = placed.select(first.alias("a"), later.alias("b"), F.lit(1).alias("tier"), F.round("similarity", 6).alias("score"))
    return C.leaders(ranks, edges)


LEADER_CLUSTER = (
    "WITH RECURSIVE"
    + (_NAMES + _PAIRS).lstrip().removeprefix("WITH")
    + """, rk AS (SELECT id, row_number() OVER (ORDER BY volume DESC, id) AS rank FROM nm),
eg AS (SELECT CASE WHEN x.rank < y.rank THEN pr.a ELSE pr.b END AS a, CASE WHEN x.rank < y.rank THEN pr.b ELSE pr.a END AS b, round(similarity, 6) AS score FROM pr JOIN rk x ON x.id = pr.a JOIN rk y ON y.id = pr.b WHERE similarity >= 0.45),
nb AS (SELECT rk.id, rk.rank, coalesce(list(eg.a) FILTER (eg.a IS NOT NULL), []) AS l FROM rk LEFT JOIN eg ON eg.b = rk.id GROUP BY ALL),
st(i, seeds) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) UNION ALL SELECT st.i + 1, CASE WHEN list_has_any(nb.l, st.seeds) THEN st.seeds ELSE list_append(st.seeds, nb.id) END FROM st JOIN nb ON nb.rank = st.i + 1),
sd AS (SELECT unnest(seeds) AS id FROM st WHERE i = (SELECT max(i) FROM st)),
bs AS (SELECT eg.b AS id, eg.a AS seed, score, row_number() OVER (PARTITION BY eg.b ORDER BY score DESC, rk.rank) AS k FROM eg JOIN sd ON sd.id = eg.a JOIN rk ON rk.id = eg.a)
SELECT id, id AS seed, 9 AS tier, CAST(1 AS DOUBLE) AS score FROM sd UNION ALL SELECT id, seed, 1, score FROM bs WHERE k = 1 AND id NOT IN (SELECT id FROM sd)
"""
)


def question_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by brand, type and core words: the greatest one absorbs the others."""
    kw = _phrases(spark, sf_dir).withColumn("core", F.array_join(C.core_names(F.col("words"), WEAK), " "))
    out = C.consolidate(kw.withColumnRenamed("id", "cluster_id"), ["market", "type", "core"], [F.desc("volume"), F.asc("cluster_id")])
    return out.groupBy("owner_id").agg(F.count("*").alias("clusters"), F.sum("volume").alias("volume"))


QUESTION_CONSOLIDATE = (
    _KW
    + """, c AS (SELECT *, array_to_string(list_sort(list_filter(words, lambda t: t NOT IN ('small', 'large', 'red', 'blue', 'green'))), ' ') AS core FROM kw),
o AS (SELECT *, first_value(id) OVER (PARTITION BY market, type, core ORDER BY volume DESC, id) AS owner_id FROM c)
SELECT owner_id, count(*) AS clusters, CAST(sum(volume) AS BIGINT) AS volume FROM o GROUP BY owner_id
"""
)


def winnable_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit of each part's difficulty and the volume that it can win."""
    kd = F.col("kd")
    return _phrases(spark, sf_dir).select(
        "id", N.fit_label(kd).alias("label"), F.round(N.fit(kd), 6).alias("fit"), F.bround(N.winnable(F.col("volume"), kd), 2).alias("winnable"),
    )


WINNABLE_VOLUME = (
    _KW
    + """, f AS (SELECT id, volume, kd, CASE WHEN kd <= 30 THEN 1.0 ELSE greatest(0.05, 1.0 - (kd - 30.0) / 30.0) END AS fit FROM kw)
SELECT id, CASE WHEN kd <= 30 THEN 'easy' WHEN kd <= 45 THEN 'stretch' ELSE 'hard' END AS label, round(CAST(fit AS DOUBLE), 6) AS fit, round_even(CAST(volume * fit AS DOUBLE), 2) AS winnable FROM f
"""
)


def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types and brands as groups: counts, volume, share, top names."""
    kw = _phrases(spark, sf_dir).withColumn("one", F.lit(1)).withColumn("label", F.concat_ws("#", "keyword", "id"))
    return C.roll_up(kw, ["type", "market"], "id", "one", "volume", "label")


GROUP_ROLLUP = (
    _KW
    + """, k AS (SELECT *, keyword || '#' || id AS label, row_number() OVER (PARTITION BY type, market ORDER BY volume DESC, keyword || '#' || id) AS r FROM kw),
t AS (SELECT sum(volume) AS total FROM kw)
SELECT type, market, count(DISTINCT id) AS clusters, count(*) AS keywords, CAST(sum(volume) AS BIGINT) AS volume, round_even(sum(volume) * 100.0 / CAST(any_value(total) AS DOUBLE), 1) AS volume_share_pct,
  string_agg(label, ' | ' ORDER BY r) FILTER (WHERE r <= 5) AS top_clusters
FROM k, t GROUP BY type, market
"""
)


def reach_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty already won: the three-quarter index rule over labelled rows as positions."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("kd"), F.pmod(F.col("p_partkey"), F.lit(25)).alias("position"))
    return C.reach(p, "kd", "position").select(F.col("reach").cast("long").alias("reach"), "measured")


REACH_PERCENTILE = """
WITH p AS (SELECT p_size AS kd, p_partkey % 25 AS pos FROM part), q AS (SELECT kd, row_number() OVER (ORDER BY kd) - 1 AS i, count(*) OVER () AS n FROM p WHERE pos > 0 AND pos <= 10)
SELECT CAST(max(kd) AS BIGINT) AS reach, max(n) AS measured FROM q WHERE n >= 20 AND i = least(n - 1, CAST(floor(0.75 * n) AS BIGINT))
"""


def stage_fallthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as clusters: groups by nation and segment, then by segment, then by nation; the rest falls through."""
    c = table(spark, sf_dir, "customer").withColumn("nation", F.col("c_nationkey").cast("string"))
    sizes = [("both", ["nation", "c_mktsegment"]), ("nation", ["nation"]), ("segment", ["c_mktsegment"])]
    return C.staged_groups(c, "c_custkey", sizes, 14).groupBy("stage", "group_key").agg(F.count("*").alias("members"))


STAGE_FALLTHROUGH = """
WITH c AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS seg FROM customer),
s1 AS (SELECT *, count(*) OVER (PARTITION BY nation, seg) AS n1 FROM c), l1 AS (SELECT * FROM s1 WHERE n1 < 14),
s2 AS (SELECT *, count(*) OVER (PARTITION BY nation) AS n2 FROM l1), l2 AS (SELECT * FROM s2 WHERE n2 < 14),
s3 AS (SELECT *, count(*) OVER (PARTITION BY seg) AS n3 FROM l2)
SELECT 'both' AS stage, nation || '|' || seg AS group_key, count(*) AS members FROM s1 WHERE n1 >= 14 GROUP BY 2
UNION ALL SELECT 'nation', nation, count(*) FROM s2 WHERE n2 >= 14 GROUP BY 2
UNION ALL SELECT 'segment', seg, count(*) FROM s3 WHERE n3 >= 14 GROUP BY 2
UNION ALL SELECT 'rest', '', count(*) FROM s3 WHERE n3 < 14 HAVING count(*) > 0
"""


def theme_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as groups split by type as theme."""
    kw = _phrases(spark, sf_dir)
    return C.split_by_theme(kw, "market", "type", "volume", max_size=30, least=3, max_sub=10)


THEME_SPLIT = (
    _KW
    + """, t AS (SELECT market, type, count(*) AS members, CAST(sum(volume) AS BIGINT) AS volume FROM kw GROUP BY 1, 2),
x AS (SELECT *, sum(members) OVER (PARTITION BY market) AS size, sum(volume) OVER (PARTITION BY market) - max(volume) OVER (PARTITION BY market) AS rest, row_number() OVER (PARTITION BY market ORDER BY volume DESC, type) AS k FROM t),
f AS (SELECT *, members >= 3 AND (k = 1 OR volume >= greatest(500, rest * 0.02)) AS fit FROM x), s AS (SELECT *, sum(CAST(fit AS INT)) OVER (PARTITION BY market ORDER BY volume DESC, type) AS sub FROM f)
SELECT market, type, members, volume, CASE WHEN size <= 30 THEN 'whole' WHEN fit AND sub <= 10 THEN 'pillar' WHEN volume >= greatest(500, rest * 0.02) THEN 'standalone' ELSE 'backlog' END AS placed FROM s
"""
)


def greedy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of each brand by greedy coverage of words; tested for its invariants."""
    kw = _phrases(spark, sf_dir)
    return V.greedy_cover(kw.select(F.col("market").alias("pillar"), "id", "words", "volume"), "pillar")


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each word of letters occurs, whole texts, words in at least five."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), 0)
    each = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(words)).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("df")).filter("df >= 5")


DOCUMENT_FREQUENCY = r"""
SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) AS word FROM documents) GROUP BY word HAVING count(*) >= 5
"""


def bigram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams of each language's documents with markers at both ends, those seen at least ten times."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), 0)
    marked = F.concat(F.array(F.lit("<s>")), words, F.array(F.lit("</s>")))
    docs = table(spark, sf_dir, "documents").select("lang", marked.alias("w"))
    pairs = F.zip_with(
        F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    return docs.select("lang", F.explode(pairs).alias("p")).groupBy("lang", "p.a", "p.b").agg(F.count("*").alias("n")).filter("n >= 10")


BIGRAM_STATS = r"""
WITH w AS (SELECT lang, list_concat(['<s>'], regexp_extract_all(lower(text), '\p{L}+'), ['</s>']) AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT lang, unnest(list_zip(w[:-2], w[2:])) AS p FROM w)
SELECT lang, p[1] AS a, p[2] AS b, count(*) AS n FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 10
"""


def term_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hundred commonest words and word pairs of part names by volume, with their counts (a top-k report)."""
    kw = _phrases(spark, sf_dir).withColumn("t", T.tokens(F.col("norm")))
    pairs = F.zip_with(
        F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b),
    )
    each = kw.select("volume", F.explode(F.array_distinct(F.concat("t", pairs))).alias("term"))
    return each.groupBy("term").agg(
        F.count("*").alias("keywords"), F.sum("volume").alias("volume"),
    ).filter("keywords >= 2").orderBy(F.desc("volume"), "term").limit(200)


TERM_SUGGESTIONS = (
    _KW
    + f""", t AS (SELECT volume, {tokens_sql('norm')} AS t FROM kw), e AS (SELECT volume, unnest(list_distinct(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))) AS term FROM t)
SELECT term, count(*) AS keywords, CAST(sum(volume) AS BIGINT) AS volume FROM e GROUP BY term HAVING count(*) >= 2 ORDER BY 3 DESC, 1 LIMIT 200
"""
)


def typo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare words of documents one edit from a word ten times as common; by deletion neighbourhoods, distance verified."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{6,}"), 0)
    df = table(spark, sf_dir, "documents").select(
        "lang", F.explode(F.array_distinct(words)).alias("word"),
    ).groupBy("lang", "word").agg(F.count("*").alias("df"))
    pairs = S.near_spellings(df, "word", "df", ["lang"]).filter("common_df >= 30 and common_df >= 10 * rare_df")
    same_end = (F.substring("rare", 1, 1) == F.substring("common", 1, 1)) | (F.substring("rare", -1, 1) == F.substring("common", -1, 1))
    close = pairs.filter(same_end & (F.levenshtein("rare", "common") <= 2)).withColumn(
        "distance", T.osa_distance(F.col("rare"), F.col("common"), F.lit(1)),
    ).filter("distance <= 1")
    best = F.row_number().over(Window.partitionBy("lang", "rare").orderBy("distance", F.desc("common_df"), "common"))
    return close.withColumn("k", best).filter("k = 1").select("lang", "rare", "rare_df", "common", "common_df")


#: Words without their accents' bytes: letters beyond ASCII are renamed to one byte each, so that the byte-wise distance counts letters.
TYPO_CANDIDATES = r"""
WITH d AS (SELECT lang, word, count(*) AS df FROM (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}{6,}'))) AS word FROM documents) GROUP BY 1, 2),
t AS (SELECT *, translate(word, 'áàâäãåéèêëíìîïóòôöõúùûüñçßœæøÿ', '0123456789!#$%&()*+,-./:;<=>?@[]') AS w FROM d),
p AS (SELECT r.lang, r.word AS rare, r.df AS rare_df, c.word AS common, c.df AS common_df, damerau_levenshtein(r.w, c.w) AS distance FROM t r JOIN t c ON r.lang IS NOT DISTINCT FROM c.lang AND r.word <> c.word AND c.df >= 30 AND c.df >= 10 * r.df AND abs(length(r.word) - length(c.word)) <= 1),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, rare ORDER BY distance, common_df DESC, common) AS k FROM p WHERE distance <= 1 AND (rare[1] = common[1] OR rare[-1] = common[-1]))
SELECT lang, rare, rare_df, common, common_df FROM k WHERE k = 1
"""


def issue_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable identifiers of findings over part names."""
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", N.issue_id(F.lit("weak_member"), F.col("p_brand"), F.col("p_name"), F.col("p_type"), T.decision_key).alias("issue_id"),
    )


ISSUE_IDS = r"""
SELECT p_partkey, 'BC-' || substr(sha1('weak_member|' || p_brand || '|' || trim(regexp_replace(translate(lower(p_name), '-_', '  '), '\s+', ' ', 'g')) || '|' || trim(regexp_replace(translate(lower(p_type), '-_', '  '), '\s+', ' ', 'g'))), 1, 8) AS issue_id FROM part
"""

QUERIES = {
    f.__name__: f
    for f in (
        phrase_normalize, token_stem, variant_dedupe, variant_volume_distinct, source_merge, reason_routing, noise_ratio, weighted_jaccard_pairs, merge_band, prefix_join_pairs, overlap_pairs, keep_apart,
        leader_cluster, question_consolidate, winnable_volume, group_rollup, reach_percentile, stage_fallthrough, theme_split, greedy_coverage, document_frequency, bigram_stats, term_suggestions, typo_candidates, issue_ids,
    )
}
ORACLE = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
