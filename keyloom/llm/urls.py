"""URL filters: host and path rules, carried over redirect equivalence.

A rule names a host, which stands for all its subdomains too, and the beginning
of a path; of the rules that fit, the longest decides.  A url that no rule fits
takes the decision of its aliases: pages that name each other as canonical link
or redirect target form components, found distributedly, and a block in the
component reaches every alias, unless an alias is explicitly allowed.  With no
decision in reach the default stands.

Only DataFrame functions are used.  Attribute values are unescaped and relative
targets resolved as RFC 3986 says, against the page's first ``base`` element with
a href if there is one, else against its url.  What stands in comments, scripts
and styles names nothing.

Nulls and edge cases: a null url or one without ``://`` has an empty host and
path, fits no rule and takes the default; a null or empty html has no links;
repeated pages give repeated result rows; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains and a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def alias_key(url: Column) -> Column:
    """What names a page: host, path and query; scheme and fragment don't matter."""
    return F.concat(host_of(url), F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^#]*)", 1))


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The rule (struct of rule and verdict) that decides, or null; the list is ordered longest first once, on the driver."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def unescaped(text: Column) -> Column:
    """The text with its character references (those that end in a semicolon) replaced, each once."""
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(&#?[A-Za-z0-9]{1,32};|&|[^&]+)"), 1)

    def plain(x: Column) -> Column:
        number = F.regexp_extract(x, r"^&#([0-9]{1,7});$", 1)
        digits = F.when(number != "", F.conv(number, 10, 16)).otherwise(F.regexp_extract(x, r"^&#[xX]([0-9A-Fa-f]{1,6});$", 1))
        code = F.conv(digits, 16, 10).cast("long")
        named = F.element_at(names, F.regexp_extract(x, r"^&([A-Za-z0-9]+);$", 1))
        valid = (digits != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(~F.startswith(x, F.lit("&")), x).when(
            valid, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"),
        ).otherwise(F.coalesce(named, x))

    return F.when(F.instr(text, "&") > 0, F.array_join(F.transform(parts, plain), "")).otherwise(text)


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(unescaped(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])))


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<{name}\b[^>]*>)"), 1)


def markup(html: Column) -> Column:
    """The page without comments, scripts and styles, or empty where it cannot name an alias."""
    some = F.rlike(html, F.lit("(?i)canonical|refresh"))
    return F.when(some, F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)", " ")).otherwise("")


def base_target(html: Column) -> Column:
    """The href of the first ``base`` element that has one, or null."""
    hrefs = F.transform(F.filter(_tags(html, "base"), lambda t: F.rlike(t, F.lit(r"(?is)(?<![\w-])href\s*="))), lambda t: _attribute(t, "href"))
    return F.get(hrefs, F.lit(0))


def link_targets(html: Column) -> Column:
    """Urls that a page names as its canonical address or redirects to, as they are written."""
    canonical_rel = lambda t: F.array_contains(F.split(ascii_lower(_attribute(t, "rel")), r"\s+"), "canonical")
    links = F.filter(_tags(html, "link"), canonical_rel)
    canonical = F.transform(links, lambda t: _attribute(t, "href"))
    metas = F.filter(_tags(html, "meta"), lambda t: ascii_lower(_attribute(t, "http-equiv")) == "refresh")
    redirects = F.transform(metas, lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), r"""(?is)url\s*=\s*["']?([^"']+)""", 1)))
    return F.filter(F.concat(canonical, redirects), lambda t: t.isNotNull())


def without_dots(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)), none, lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x))),
    )
    # a dot segment at the end stands for the folder
    return F.concat(
        F.lit("/"), F.array_join(F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"),
    )


def resolved(url: Column, target: Column) -> Column:
    """The target as an absolute address, seen from the page at ``url``; null where it is none (``mailto:`` and the like)."""
    root = F.concat(F.regexp_extract(url, r"(?s)^(.*?://)", 1), host_of(url))
    path, query = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/(.*/)", 1))
    return (
        F.when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), F.lit(None))
        .when((target == "") | F.startswith(target, F.lit("#")), url)
        .when(F.startswith(target, F.lit("?")), F.concat(root, path_of(url), query))
        .when(F.startswith(target, F.lit("/")), F.concat(root, without_dots(path), query))
        .otherwise(F.concat(root, without_dots(F.concat(folder, path)), query))
    )


def edges(pages: DataFrame) -> DataFrame:
    """(a, b): the alias keys of a page and of a target it names, relative targets seen from the page."""
    marked = pages.select("url", markup(F.col("html")).alias("m")).filter("m <> ''")
    based = marked.select("url", "m", base_target(F.col("m")).alias("base"))
    # a column of its own, so that the address is not spelt out wherever a target is resolved against it
    placed = based.select(
        "url", "m",
        F.when(F.col("base").isNull(), F.col("url")).otherwise(F.coalesce(resolved(F.col("url"), F.col("base")), F.col("url"))).alias("page"),
    )
    found = placed.select("url", "page", F.explode(link_targets(F.col("m"))).alias("target"))
    full = resolved(F.col("page"), F.col("target"))
    return found.select(alias_key(F.col("url")).alias("a"), alias_key(full).alias("b")).filter("a <> '' and b <> '' and a <> b")


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """Every row of ``pages`` (page_id, url, html) with host, path, its rule, the verdict and where that comes from."""
    url = F.col("url").cast("string")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"))
    judged = base.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.coalesce(alias_key(F.col("url")), F.lit("")).alias("alias"),
    )
    judged = judged.withColumn("hit", matched(F.col("host"), F.col("path"), rules))
    judged = judged.select("page_id", "host", "path", "alias", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("own"))
    linked = components(edges(base))
    # each alias once; the targets' own rules count, whether or not they were crawled
    hosts = linked.withColumn("host", F.regexp_extract("node", r"(?s)^([^/?#]*)", 1)).withColumn(
        "path", F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1),
    )
    votes = hosts.select("component", matched(F.col("host"), F.col("path"), rules)["verdict"].alias("vote"))
    decided = votes.groupBy("component").agg(
        F.max((F.col("vote") == "allow").cast("int")).alias("allows"), F.max((F.col("vote") == "block").cast("int")).alias("blocks"),
    )
    inherited = linked.join(decided, "component").select(
        F.col("node").alias("alias"), F.when(F.col("allows") == 1, "allow").when(F.col("blocks") == 1, "block").alias("passed"),
    )
    both = judged.join(inherited.filter("passed is not null"), "alias", "left")
    verdict = F.coalesce("own", "passed", F.lit(default))
    by = F.when(F.col("own").isNotNull(), "rule").when(F.col("passed").isNotNull(), "alias").otherwise("default")
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), by.alias("decided_by"))
