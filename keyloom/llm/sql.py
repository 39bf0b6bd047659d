"""DuckDB SQL for the results of the corpus queries, where SQL can state them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = "'[^\\x20\\x09-\\x0D]+'"
_ALNUM = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, min(doc_id) OVER (PARTITION BY s) AS first FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
m AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, CASE WHEN n.n > 0 THEN n.first ELSE n.doc_id END AS class_id, CAST(coalesce(m.n_links, 0) AS BIGINT) AS n_links
FROM n JOIN c ON c.a = n.doc_id LEFT JOIN m ON m.a = n.doc_id
"""



def _rest(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"


def _host(rest: str) -> str:
    return f"translate(regexp_extract({rest}, '(?s)^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"


def _attr(tag: str, name: str) -> str:
    pattern = rf"""(?is)(?:^|[^\w-]){name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    value = " || ".join(f"regexp_extract({tag}, '{pattern}', {k})" for k in (1, 2, 3))
    return f"trim(replace({value}, '&amp;', '&'))"


#: Canonical links and redirects, whose targets are absolute or begin with a slash or a segment; of entities only
#: ``&amp;`` and no ``base`` element or dot segments: the tables' pages hold none, and tests hold the query against
#: the standard library on pages that do.
OP2 = f"""
WITH RECURSIVE p AS (SELECT CAST(page_id AS BIGINT) AS page_id, url, {_rest('url')} AS rest, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g') AS html FROM pages),
h AS (SELECT page_id, url, {_host('rest')} AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path, {_host('rest')} || regexp_extract(rest, '(?s)^[^/?#]*([^#]*)', 1) AS alias, html FROM p),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
t AS (SELECT url, host, path, alias, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM h),
g AS (SELECT url, host, path, alias, CASE WHEN regexp_matches(tag, '(?is)^<link') AND list_contains(regexp_split_to_array(lower({_attr('tag', 'rel')}), '\\s+'), 'canonical') THEN {_attr('tag', 'href')}
  WHEN regexp_matches(tag, '(?is)^<meta') AND lower({_attr('tag', 'http-equiv')}) = 'refresh' THEN trim(regexp_extract({_attr('tag', 'content')}, '(?is)url\\s*=\\s*["\'\']?([^"\'\']+)', 1)) END AS target FROM t),
f AS (SELECT alias AS a, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
  WHEN target = '' OR starts_with(target, '#') THEN url WHEN starts_with(target, '?') THEN 'http://' || host || path || target WHEN starts_with(target, '/') THEN 'http://' || host || target
  ELSE 'http://' || host || '/' || regexp_extract(path, '(?s)^/(.*/)', 1) || target END AS full_url FROM g WHERE target IS NOT NULL),
e AS (SELECT a, {_host('rest')} || regexp_extract(rest, '(?s)^[^/?#]*([^#]*)', 1) AS b FROM (SELECT a, {_rest('full_url')} AS rest FROM f WHERE full_url IS NOT NULL)),
u AS (SELECT a, b FROM e WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM e WHERE a <> '' AND b <> '' AND a <> b),
c(a, b) AS (SELECT a, a FROM u UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a),
k AS (SELECT host, path, {{best}} FROM (SELECT host, path FROM h UNION SELECT regexp_extract(b, '(?s)^([^/?#]*)', 1), regexp_extract(b, '(?s)^[^/?#]*([^?#]*)', 1) FROM c) x LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
v AS (SELECT c.a AS alias, max(CAST(k.verdict = 'allow' AS INT)) AS allows, max(CAST(k.verdict = 'block' AS INT)) AS blocks
  FROM c JOIN k ON k.host = regexp_extract(c.b, '(?s)^([^/?#]*)', 1) AND k.path = regexp_extract(c.b, '(?s)^[^/?#]*([^?#]*)', 1) GROUP BY c.a),
j AS (SELECT h.page_id, coalesce(h.host, '') AS host, coalesce(h.path, '') AS path, k.rule, k.verdict AS own, CASE WHEN v.allows = 1 THEN 'allow' WHEN v.blocks = 1 THEN 'block' END AS passed
  FROM h LEFT JOIN k ON k.host = h.host AND k.path = h.path LEFT JOIN v ON v.alias = h.alias)
SELECT page_id, host, path, rule, coalesce(own, passed, 'allow') AS verdict, CASE WHEN own IS NOT NULL THEN 'rule' WHEN passed IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by FROM j
""".replace("{best}", "arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict")

OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, o, substr(h, 2 * o + 1, 498) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 200)) AS o FROM d)),
w AS (SELECT doc_id, o + j AS i, md5(substr(s, 2 * j + 1, 100)) AS m FROM (SELECT doc_id, o, s, unnest(range(0, length(s) // 2 - 49)) AS j FROM q)),
f AS (SELECT m, min(doc_id) AS first FROM w GROUP BY m HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i FROM w JOIN f USING (m) WHERE doc_id > first),
g AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, TRUE) AS new FROM c),
k AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
u AS (SELECT t.doc_id, count(*) AS n_spans, sum(b - a) AS gone, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last FROM t JOIN d USING (doc_id) GROUP BY t.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN u USING (doc_id)
"""

OP5 = """
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, text, string_split(text, chr(10)) AS l FROM documents
), w AS (
  SELECT doc_id, i, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS win
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM d WHERE len(l) >= 3)
), s AS (
  SELECT doc_id, i, md5(win) AS win FROM w WHERE regexp_matches(win, '[^\\x20\\x09-\\x0D]')
), k AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM s
), c AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 3)))) AS gone FROM k WHERE n > 1 GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(c.gone), 0) AS BIGINT) AS n_lines_removed,
       sha256(CASE WHEN c.gone IS NULL THEN d.text ELSE
              coalesce(array_to_string(list_transform(list_filter(range(0, len(d.l)), lambda j: NOT list_contains(c.gone, j)), lambda j: d.l[j + 1]), chr(10)), '') END) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

OP7 = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents),
z AS (SELECT DISTINCT n FROM i),
x AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, z WHERE len(w) >= n)),
h AS (SELECT doc_id, k, x.n, item FROM x JOIN i ON x.win = i.win AND x.n = i.n),
c AS (SELECT doc_id, len(list_distinct(flatten(list(range(k, k + n))))) AS n_hit, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
x AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d)),
f AS (SELECT m, min(doc_id) AS first FROM x GROUP BY m HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, list_distinct(flatten(list(range(k, k + 50)))) AS gone FROM x JOIN f USING (m) WHERE doc_id > first GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

_BITS = "array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(sha1(p), i, 1))]), '')"
_VALUE = "16 * CAST(substr(bits, 5 * j + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * j + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * j + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * j + 4, 1) AS INT) + CAST(substr(bits, 5 * j + 5, 1) AS INT) + 1"
OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS p FROM pages), b AS (SELECT page_id, p, {_BITS} AS bits FROM p),
d AS (SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {_VALUE}, 1)), '') AS payload_digest, min(page_id) OVER (PARTITION BY p) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, length(h) // 2), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"""
#: Weights are equal, so the greatest score is that of the greatest hash.
OP8 = f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, key, CAST(length(h) // 2 + 8 AS BIGINT) AS size, CAST({_CRC} AS BIGINT) AS text_crc32, list_transform(range(0, 25), lambda s: CAST(('0x' || substr(md5(key || ':' || s), 1, 13)) AS BIGINT)) AS u FROM d, crc),
w AS (SELECT *, CAST(list_last(list_filter(range(0, 24), lambda s: u[s + 1] = list_max(u[1:24]))) AS INT) AS shard, CAST(list_last(list_filter(range(0, 25), lambda s: u[s + 1] = list_max(u))) AS INT) AS grown_shard,
  CAST(('0x' || substr(md5(key || '#' || text_crc32), 1, 8)) AS BIGINT) % 4096 AS block FROM x)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM w
"""

ORACLE = {
    "op1_ngram_jaccard": OP1,
    "op2_url_filters": OP2,
    "op4_suffix_array_dedup": OP4,
    "op5_line_windows": OP5,
    "op7_decontamination": OP7,
    "op8_rendezvous_sharding": OP8,
    "op9_substring_sketch": OP9,
    "op10_warc_transactions": OP10,
}
