"""Queries on documents, pages, dates and conversations: checks, links, calendar, forward fill, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import numbers as N
from ..functions import text as T
from ..operators import calendar as Cal
from ..operators import documents as D
from ..operators import links as L
from ..operators import merge as M
from ..operators import similarity as S
from ..operators import spelling as Sp
from .phrases import normal_sql, table, tokens_sql


def easter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Easter Sunday of two centuries."""
    from ..functions.dates import easter

    return Cal.years_between(spark, 1950, 2149).select("year", easter(F.col("year")).alias("easter"))


EASTER_DATES = """
WITH y AS (SELECT CAST(unnest(range(1950, 2150)) AS INT) AS year), a AS (SELECT year, year % 19 AS g, year // 100 AS c FROM y),
h AS (SELECT *, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS h FROM a), i AS (SELECT *, CASE WHEN h = 29 OR (h = 28 AND g > 10) THEN h - 1 ELSE h END AS i FROM h),
j AS (SELECT *, (year + year // 4 + i + 2 - c + c // 4) % 7 AS j FROM i)
SELECT year, CAST(make_date(year, 3, 28) + CAST(i - j AS INT) AS DATE) AS easter FROM j
"""

_EVENTS_SQL = """
y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders), d AS (
  SELECT year, make_date(year, 5, 1) AS may, make_date(year, 6, 1) AS jun, make_date(year, 9, 1) AS sep, make_date(year, 11, 1) AS nov FROM y),
w AS (SELECT year, may + CAST((7 - dayofweek(may)) % 7 + 7 AS INT) AS mothers, jun + CAST((7 - dayofweek(jun)) % 7 + 14 AS INT) AS fathers, sep + CAST((8 - dayofweek(sep)) % 7 AS INT) AS labor,
  nov + CAST((11 - dayofweek(nov)) % 7 + 21 AS INT) AS thanks FROM d),
e AS (SELECT 'mothers-day' AS occasion, year, CAST(mothers AS DATE) AS event_date FROM w UNION ALL SELECT 'fathers-day', year, CAST(fathers AS DATE) FROM w UNION ALL SELECT 'labor-day', year, CAST(labor AS DATE) FROM w
  UNION ALL SELECT 'thanksgiving', year, CAST(thanks AS DATE) FROM w UNION ALL SELECT 'black-friday', year, CAST(thanks + 1 AS DATE) FROM w UNION ALL SELECT 'cyber-monday', year, CAST(thanks + 4 AS DATE) FROM w
  UNION ALL SELECT 'christmas', year, make_date(year, 12, 25) FROM y UNION ALL SELECT 'halloween', year, make_date(year, 10, 31) FROM y)
"""
_US = ["mothers-day", "fathers-day", "labor-day", "thanksgiving", "black-friday", "cyber-monday", "christmas", "halloween"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return Cal.occasions(years).filter(F.col("market") == "us").filter(F.col("occasion").isin(*_US))


def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occasions of all order years with publish dates and their status on a fixed day."""
    x = Cal.with_deadlines(_events(spark, sf_dir), F.to_date(F.lit("1996-06-01")))
    return x.select("occasion", "year", "event_date", "publish_by", "refresh_by", "status")


CALENDAR_EVENTS = f"""
WITH {_EVENTS_SQL}, p AS (SELECT occasion, year, event_date, CAST(event_date - 84 AS DATE) AS publish_by, CAST(event_date - 42 AS DATE) AS refresh_by FROM e)
SELECT *, CASE WHEN publish_by < DATE '1996-06-01' THEN 'overdue' WHEN publish_by <= DATE '1996-06-15' THEN 'due_soon' ELSE 'upcoming' END AS status FROM p
"""


def next_event_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the next occasion on or after their day."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return Cal.next_event(o, "day", _events(spark, sf_dir), []).select("o_orderkey", "next_date", "next_occasion")


NEXT_EVENT_ASOF = f"""
WITH {_EVENTS_SQL}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), days AS (SELECT DISTINCT day FROM o), l AS (SELECT event_date, occasion FROM e ORDER BY event_date DESC, occasion DESC LIMIT 1),
n AS (SELECT day, min(event_date) AS event_date FROM days JOIN e ON event_date >= day GROUP BY day), m AS (SELECT day, n.event_date, min(occasion) AS occasion FROM n JOIN e USING (event_date) GROUP BY 1, 2)
SELECT o_orderkey, coalesce(m.event_date, l.event_date) AS next_date, coalesce(m.occasion, l.occasion) AS next_occasion FROM o LEFT JOIN m USING (day), l
"""


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical address and slug of every page."""
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"), T.url_slug(F.col("url")).alias("slug"))


_CANON = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\.', ''), '[?#].*$', ''), '/+$', '')"
URL_CANONICAL = rf"""
WITH c AS (SELECT page_id, {_CANON} AS canonical FROM pages)
SELECT page_id, canonical, regexp_replace(regexp_extract(regexp_replace(canonical, '^[^/]*/?', ''), '([^/]*)$', 1), '\.[a-z0-9]{{1,5}}$', '') AS slug FROM c
"""


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs and signatures of part titles."""
    p = table(spark, sf_dir, "part")
    title = F.concat_ws(" ", F.lit("The 1998 guide for"), "p_name", "p_brand", "p_type")
    return p.select("p_partkey", T.slugify(title, 30).alias("slug"), T.signature(T.normal_form(title)).alias("signature"))


_TITLE = "'The 1998 guide for ' || p_name || ' ' || p_brand || ' ' || p_type"
SLUGS = rf"""
WITH t AS (SELECT p_partkey, trim(regexp_replace(replace(lower({_TITLE}), '1998', ''), '[^a-z0-9]+', '-', 'g'), '-') AS s, {tokens_sql(normal_sql(_TITLE))} AS w FROM part),
f AS (SELECT *, list_filter(w, lambda x: x NOT IN ('a','an','the','of','for','to','in','on','and','or','is','are','do','does','with','your','my') AND NOT regexp_matches(x, '^(19|20)[0-9]{{2}}$') AND length(x) > 1) AS k FROM t)
SELECT p_partkey, CASE WHEN length(s) > 30 THEN regexp_replace(substr(s, 1, 30), '-[^-]*$', '') ELSE s END AS slug,
  array_to_string(list_sort(list_distinct(list_transform(k, lambda x: CASE WHEN length(x) > 3 AND regexp_matches(x, '[^sui]s$') AND x NOT LIKE '%ys' THEN substr(x, 1, length(x) - 1) ELSE x END))), ' ') AS signature FROM f
"""


def link_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbound and outbound links of all addresses in the pages."""
    return L.degrees(L.extract(table(spark, sf_dir, "pages")))


_LINKS = rf"""
h AS (SELECT page_id, {_CANON} AS source, unnest(regexp_extract_all(html, '(?i)<a href="[^"]*">[^<]*</a>')) AS a FROM pages),
l AS (SELECT page_id, source, regexp_extract(a, '(?i)<a href="([^"]*)">', 1) AS target, trim(regexp_extract(a, '(?i)<a href="[^"]*">([^<]*)</a>', 1)) AS anchor FROM h)
"""
LINK_DEGREES = f"""
WITH {_LINKS}, o AS (SELECT DISTINCT source, target FROM l), b AS (SELECT source AS node, 1 AS o, 0 AS i FROM o UNION ALL SELECT target, 0, 1 FROM o)
SELECT node, CAST(sum(o) AS BIGINT) AS outbound, CAST(sum(i) AS BIGINT) AS inbound FROM b GROUP BY node
"""


def link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on the pages' links, counted by check."""
    edges = L.extract(table(spark, sf_dir, "pages"))
    posts = edges.select(F.col("source").alias("slug")).distinct()
    return L.audit(edges, posts, most_out=5).groupBy("check").agg(F.count("*").alias("findings"))


LINK_AUDIT = f"""
WITH {_LINKS}, o AS (SELECT DISTINCT source, target FROM l), p AS (SELECT DISTINCT source AS slug FROM l),
d AS (SELECT slug, (SELECT count(*) FROM o WHERE o.source = p.slug) AS outbound, (SELECT count(*) FROM o WHERE o.target = p.slug) AS inbound FROM p),
f AS (SELECT 'empty anchor' AS "check" FROM l WHERE anchor = '' UNION ALL
 SELECT 'generic anchor' FROM l WHERE lower(anchor) IN ('here', 'click here', 'read more', 'this', 'link', 'learn more', 'more', 'website', 'this post') UNION ALL
 SELECT 'long anchor' FROM l WHERE len(list_filter(regexp_split_to_array(anchor, '\\s+'), lambda w: w <> '')) > 8 UNION ALL SELECT 'self link' FROM l WHERE source = target UNION ALL
 SELECT 'duplicate link' FROM l GROUP BY source, target HAVING count(*) > 1 UNION ALL SELECT 'reused anchor' FROM l WHERE anchor <> '' GROUP BY lower(anchor) HAVING count(DISTINCT target) > 1 UNION ALL
 SELECT 'orphan' FROM d WHERE inbound = 0 UNION ALL SELECT 'dead end' FROM d WHERE outbound = 0 UNION ALL SELECT 'many outbound' FROM d WHERE outbound > 5 UNION ALL SELECT 'many inbound' FROM d WHERE inbound > 100)
SELECT "check", count(*) AS findings FROM f GROUP BY 1
"""


def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, sentences, vowel groups and reading grade of whole documents."""
    return D.readability(table(spark, sf_dir, "documents"))


READABILITY = r"""
WITH c AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS words, len(regexp_extract_all(coalesce(text, ''), '[^.!?]*[A-Za-z][^.!?]*')) AS sentences, len(regexp_extract_all(lower(coalesce(text, '')), '[aeiouy]+')) AS vowel_groups FROM documents)
SELECT doc_id, words, sentences, vowel_groups, round(0.39 * CAST(words AS DOUBLE) / greatest(sentences, 1) + 11.8 * CAST(vowel_groups AS DOUBLE) / greatest(words, 1) - 15.59, 4) AS grade FROM c
"""


def claim_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim rules over all paragraphs of all documents."""
    return D.claims(
        table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    ).select("doc_id", "paragraph", "rule", "hits")


def _claims_sql() -> str:
    def q(s: str) -> str:
        return s.replace("'", "''")

    rows = " UNION ALL ".join(
        f"SELECT doc_id, paragraph, '{c.name}' AS rule, CAST({'CASE WHEN regexp_matches(body, ' + chr(39) + q(c.excused_by) + chr(39) + ') THEN 0 ELSE ' if c.excused_by else ''}len(regexp_extract_all(body, '{q(c.pattern)}')){' END' if c.excused_by else ''} AS BIGINT) AS hits FROM p"
        for c in D.CLAIMS
    )
    return f"""
WITH s AS (SELECT doc_id, regexp_split_to_array(coalesce(replace(text, chr(10), chr(10) || chr(10)), ''), '\\n[ \\t\\r]*\\n') AS b FROM documents),
p AS (SELECT doc_id, unnest(b) AS body, CAST(generate_subscripts(b, 1) - 1 AS BIGINT) AS paragraph FROM s) SELECT * FROM ({rows}) WHERE hits > 0
"""


CLAIM_FLAGS = _claims_sql()


def draft_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft review of whole documents: score and band; findings as text."""
    r = D.review(table(spark, sf_dir, "documents"))
    return r.select(
        "doc_id", "words", "grade", "score", "band",
        F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["severity"], f["check"])), "; ").alias("findings"),
    )


def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a grouped sheet: a user's turn starts a group, other turns continue it."""
    c = table(spark, sf_dir, "conversations").withColumn("cell", F.when(F.col("role") == "user", F.md5("text")).otherwise(""))
    return M.forward_fill(c, ["conv_id"], "turn", "cell", "group").select("conv_id", "turn", "group")


FORWARD_FILL = """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "group" FROM conversations
"""


def slot_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the assistant as product slots: position in words, gap to the one before, and whether it is too close."""
    c = table(spark, sf_dir, "conversations").withColumn(
        "w", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \n\t]+"), 0)).cast("long"),
    )
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("position", F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    a = c.filter("role = 'assistant'").withColumn("gap", F.col("position") - F.lag("position").over(w))
    return a.select("conv_id", "turn", "position", "gap", (F.col("gap") < 60).alias("too_close"))


SLOT_SPACING = r"""
WITH c AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^ \n\t]+')) AS w FROM conversations), p AS (SELECT *, CAST(coalesce(sum(w) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM c),
a AS (SELECT conv_id, turn, position, position - lag(position) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM p WHERE role = 'assistant') SELECT *, gap < 60 AS too_close FROM a
"""


def cosine_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar suppliers of each by the parts' brands that they deliver."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    bags = l.groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n")).withColumn("g", F.lit(1))
    return S.cosine_top(bags, "l_suppkey", "p_brand", "n", ["g"], 0.2, 3).select(
        "a", "b", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"),
    )


COSINE_RELATED = """
WITH n AS (SELECT l_suppkey AS s, p_brand AS w, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), m AS (SELECT s, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM n GROUP BY s),
d AS (SELECT x.s AS a, y.s AS b, sum(x.n * y.n) AS dot FROM n x JOIN n y ON x.w = y.w AND x.s <> y.s GROUP BY 1, 2),
c AS (SELECT a, b, round(dot / (p.norm * q.norm), 9) AS cosine FROM d JOIN m p ON p.s = a JOIN m q ON q.s = b), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM c WHERE cosine >= 0.2)
SELECT a, b, round(cosine, 6) AS cosine, rank FROM r WHERE rank <= 3
"""


def number_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part prices written as export tools write them, parsed back."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.floor("p_retailprice").cast("long").alias("n"))
    k = F.pmod(F.col("p_partkey"), F.lit(6))
    s = F.col("n").cast("string")
    cell = F.when(k == 0, F.concat(F.lit("<"), s)).when(k == 1, F.concat(s, F.lit("K"))).when(k == 2, F.concat(s, F.lit(" – "), (F.col("n") + 10).cast("string"))).when(
        k == 3, F.concat(F.lit("$"), s, F.lit(",50")),
    ).when(k == 4, F.lit("n/a")).otherwise(s)
    v = N.parse_number(cell)
    return p.select("p_partkey", v["value"].alias("value"), v["estimate"].alias("estimate"))


NUMBER_PARSING = """
WITH p AS (SELECT p_partkey, CAST(floor(p_retailprice) AS DOUBLE) AS n FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN n WHEN 1 THEN n * 1000 WHEN 2 THEN n WHEN 3 THEN n + 0.5 WHEN 4 THEN NULL ELSE n END AS value, p_partkey % 6 IN (0, 2) AS estimate FROM p
"""


def intent_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of events by type: letters parsed, counted and summed."""
    e = table(spark, sf_dir, "events").select(
        "event_type", F.floor("value").cast("long").alias("volume"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("I, N", "commercial", "T|branded", "")]), (F.pmod(F.col("event_id"), F.lit(4)) + 1).cast("int"),
        ).alias("cell"),
    )
    x = e.select("event_type", "volume", F.explode_outer(E.intents(F.col("cell"))["intents"]).alias("intent"))
    return x.groupBy("event_type", F.coalesce("intent", F.lit("no label")).alias("intent")).agg(
        F.count("*").alias("keywords"), F.sum("volume").alias("volume"),
    )


INTENT_MIX = """
WITH e AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS v, unnest(CASE event_id % 4 WHEN 0 THEN ['informational', 'navigational'] WHEN 1 THEN ['commercial'] WHEN 2 THEN ['transactional'] ELSE ['no label'] END) AS intent FROM events)
SELECT event_type, intent, count(*) AS keywords, CAST(sum(v) AS BIGINT) AS volume FROM e GROUP BY 1, 2
"""


def peak_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak month of each part brand's shipped quantity in each year of monthly values."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    m = l.groupBy("p_brand", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("m")).agg(F.sum("l_quantity").alias("q"))
    series = m.groupBy("p_brand", "year").agg(F.map_from_entries(F.collect_list(F.struct("m", "q"))).alias("x"))
    values = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.coalesce(F.try_element_at("x", i), F.lit(0.0)))
    return series.select("p_brand", F.col("year").cast("long").alias("year"), E.peak_month(values, F.lit(12)).alias("peak"))


PEAK_MONTHS = """
WITH m AS (SELECT p_brand, year(l_shipdate) AS year, month(l_shipdate) AS m, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, year ORDER BY q DESC, m DESC) AS k FROM m)
SELECT p_brand, year, ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][m] AS peak FROM r WHERE k = 1
"""


def serp_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results in long form (part = keyword, order date = check date): the latest check's ten best positions."""
    from ..sources.serp import latest_results

    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    rows = l.select(
        F.col("l_partkey").cast("string").alias("keyword"), F.lit("us").alias("market"), F.to_date("l_shipdate").cast("string").alias("checked_at"),
        F.col("l_linenumber").alias("position"), F.concat(F.lit("https://www.s"), F.col("l_suppkey").cast("string"), F.lit(".com/?q=1")).alias("url"),
        F.lit("").alias("title"),
    )
    r = latest_results(rows)
    return r.select("keyword", "checked_at", F.array_join("urls", " ").alias("urls"))


SERP_LATEST = """
WITH r AS (SELECT CAST(l_partkey AS VARCHAR) AS keyword, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS checked_at, l_linenumber AS position, 's' || l_suppkey || '.com' AS url FROM lineitem),
m AS (SELECT keyword, max(checked_at) AS checked_at FROM r GROUP BY keyword), d AS (SELECT keyword, checked_at, url, min(position) AS position FROM r JOIN m USING (keyword, checked_at) GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY position, url) AS n FROM d)
SELECT keyword, checked_at, string_agg(url, ' ' ORDER BY position, url) AS urls FROM k WHERE n <= 10 GROUP BY 1, 2
"""


def phrase_fluency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fluency of part names under a model learnt from them."""
    p = table(spark, sf_dir, "part").select("p_partkey", T.tokens(T.normal_form(F.col("p_name"))).alias("words"))
    return Sp.fluency(p, p, "p_partkey", "words")


PHRASE_FLUENCY = f"""
WITH w AS (SELECT p_partkey, list_concat(['<s>'], {tokens_sql(normal_sql('p_name'))}, ['</s>']) AS w FROM part), s AS (SELECT p_partkey, unnest(list_zip(w[:-2], w[2:])) AS p FROM w), t AS (SELECT p_partkey, p[1] AS a, p[2] AS b FROM s),
ab AS (SELECT a, b, count(*) AS n FROM t GROUP BY 1, 2), na AS (SELECT a, count(*) AS n FROM t GROUP BY 1), nb AS (SELECT b, count(*) AS n FROM t GROUP BY 1), z AS (SELECT count(*) AS v, sum(n) AS total FROM nb)
SELECT p_partkey, round(avg(ln(0.8 * (CAST(ab.n AS DOUBLE) / na.n) + (1 - 0.8) * ((nb.n + 1) / CAST(total + v + 1 AS DOUBLE)))), 6) AS fluency FROM t JOIN ab USING (a, b) JOIN na USING (a) JOIN nb USING (b), z GROUP BY p_partkey
"""


def link_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link plan over part names as posts, a market per brand; tested for its invariants."""
    p = table(spark, sf_dir, "part")
    norm = T.normal_form(F.col("p_name"))
    base = p.select(
        F.col("p_brand").alias("market"), F.concat_ws("-", T.slugify(F.col("p_name")), F.col("p_partkey").cast("string")).alias("slug"),
        F.col("p_type").alias("pillar"), F.col("p_retailprice").alias("value"), T.tokens(norm).alias("words"), F.array(norm).alias("anchors"),
    )
    first = F.row_number().over(Window.partitionBy("market", "pillar").orderBy(F.desc("value"), "slug"))
    return L.plan(base.withColumn("is_pillar", first == 1))


QUERIES = {
    f.__name__: f
    for f in (
        easter_dates, calendar_events, next_event_asof, url_canonical, slugs, link_degrees, link_audit, readability, claim_flags, draft_review, forward_fill, slot_spacing, cosine_related, number_parsing, intent_mix, peak_months,
        serp_latest, phrase_fluency, link_plan,
    )
}
ORACLE = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
