"""Text functions as columns: normal forms, tokens, keys, urls, slugs, sentences.

Patterns spell Unicode classes out (``\\p{L}\\p{N}_``), since Java's ``\\w`` is ASCII.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Question words whose "s" stands for "is"; assistants that a spoken query may begin with; question
# words that must follow an assistant's name.
CONTRACTED = "what|when|where|who|how|that|there"
ASSISTANTS = "google|alexa|siri|bing|chatgpt"
GREETINGS = "hey|ok|okay|ask"
QUESTION_WORDS = "what|when|where|who|why|how|which|is|are|do|does|did|can"

WORD = r"\p{L}\p{N}_"


def straight_quotes(c: Column) -> Column:
    """Curly quotes and back-ticks to the apostrophe."""
    return F.translate(c, "’‘`", "'''")


def normal_form(c: Column) -> Column:
    """The matching form of a phrase, before repeated phrases are collapsed.

    Lower case, possessives joined, punctuation to blanks (decimal points stay),
    ``&`` to "and", contracted question words opened, an assistant's name before
    a question dropped, white space collapsed.
    """
    x = straight_quotes(F.lower(c))
    x = F.regexp_replace(x, rf"'s(?![{WORD}])", "s")
    x = F.regexp_replace(x, "'", "")
    x = F.regexp_replace(x, "[-_/]", " ")
    x = F.regexp_replace(x, rf"[^{WORD}\s&.]", " ")
    x = F.regexp_replace(x, "&", " and ")
    x = F.regexp_replace(x, r"\.(?![0-9])|(?<![0-9])\.", " ")
    x = F.regexp_replace(x, rf"(?<![{WORD}])({CONTRACTED})s(?![{WORD}])", "$1 is")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.regexp_replace(x, rf"^(?:(?:{GREETINGS}) )?(?:{ASSISTANTS}) (?=(?:{QUESTION_WORDS})(?![{WORD}]))", "")


def collapse(words: list[str]) -> list[str]:
    """Drop immediate repeats of phrases of three, two or one words, trying again at the same place."""
    out = list(words)
    at = 0
    while at < len(out):
        size = next((n for n in (3, 2, 1) if at + 2 * n <= len(out) and out[at : at + n] == out[at + n : at + 2 * n]), 0)
        if size:
            out[at + size : at + 2 * size] = []
        else:
            at += 1
    return out


def collapse_repeats(c: Column) -> Column:
    """Immediate repeats of short phrases collapsed; the retry at the same place has no regular expression."""

    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else " ".join(collapse(x.split())))

    return F.pandas_udf(each, "string")(c)


def tokens(norm: Column) -> Column:
    """Words of a normal form; no words for an empty one."""
    return F.filter(F.split(norm, " "), lambda t: t != "")


def stem(t: Column) -> Column:
    """Light plural stem."""
    n = F.length(t)
    return (
        F.when((n > 4) & F.endswith(t, F.lit("ies")), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & F.rlike(t, F.lit("(ches|shes|sses|xes|zes)$")), F.substring(t, F.lit(1), n - 2))
        .when((n > 3) & F.endswith(t, F.lit("s")) & ~F.rlike(t, F.lit("(ss|us|is)$")), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def is_year(t: Column) -> Column:
    return F.rlike(t, F.lit("^(19|20)[0-9]{2}$"))


def canonical_tokens(norm: Column, variants: dict[str, str] | None = None) -> Column:
    """Stemmed words without years; ``variants`` maps spellings to one of them first."""
    words = F.filter(tokens(norm), lambda t: ~is_year(t))
    if variants:
        table = F.create_map(*[F.lit(x) for kv in variants.items() for x in kv])
        words = F.transform(words, lambda t: F.coalesce(F.try_element_at(table, t), t))
    return F.transform(words, stem)


def variant_key(words: Column) -> Column:
    """Words as a multiset: sorted, repeats kept."""
    return F.array_join(F.array_sort(words), " ")


def word_set(words: Column) -> Column:
    """Words as a set, in a fixed order."""
    return F.array_sort(F.array_distinct(words))


def join_key(c: Column) -> Column:
    """Light identity of a keyword across files: lower case, straight quotes, single blanks."""
    return F.trim(F.regexp_replace(straight_quotes(F.lower(c)), r"\s+", " "))


def decision_key(c: Column) -> Column:
    """Identity in decision tables: apostrophes dropped, hyphens and underscores to blanks."""
    x = F.regexp_replace(straight_quotes(F.lower(c)), "'", "")
    return F.trim(F.regexp_replace(F.translate(x, "-_", "  "), r"\s+", " "))


def canonical_url(c: Column) -> Column:
    """Scheme, www., query, fragment and the last slash dropped; lower case."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"^https?://", "")
    x = F.regexp_replace(x, r"^www\.", "")
    return F.regexp_replace(F.regexp_replace(x, r"[?#].*$", ""), r"/+$", "")


def url_slug(c: Column) -> Column:
    """Last part of an address's path without its extension."""
    path = F.regexp_replace(canonical_url(c), r"^[^/]*/?", "")
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(last, r"\.[a-z0-9]{1,5}$", "")


def slugify(c: Column, most: int = 60) -> Column:
    """Address form of a title: years dropped, other characters to hyphens, cut at a hyphen."""
    x = F.regexp_replace(straight_quotes(F.lower(c)), "'", "")
    x = F.regexp_replace(x, r"(^|[^0-9a-z])(19|20)[0-9]{2}(?![0-9a-z])", "$1")
    x = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(x, 1, most), "-[^-]*$", "")
    return F.when(F.length(x) > most, cut).otherwise(x)


#: Words that don't tell two titles apart.
LIGHT_WORDS = ("a", "an", "the", "of", "for", "to", "in", "on", "and", "or", "is", "are", "do", "does", "with", "your", "my")


def signature(norm: Column) -> Column:
    """Word set by which two planned titles are the same: light words, years and letters dropped, plural s stripped."""
    kept = F.filter(tokens(norm), lambda t: ~t.isin(*LIGHT_WORDS) & ~is_year(t) & (F.length(t) > 1))
    bare = F.transform(
        kept,
        lambda t: F.when(
            (F.length(t) > 3) & F.rlike(t, F.lit("[^sui]s$")) & ~F.endswith(t, F.lit("ys")), F.substring(t, F.lit(1), F.length(t) - 1),
        ).otherwise(t),
    )
    return F.array_join(word_set(bare), " ")


def stale_year(c: Column, year: int) -> Column:
    """Whether a phrase names a year before ``year``."""
    return F.exists(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1), lambda y: y.cast("int") < year)


def stray_letter(c: Column) -> Column:
    """A lone letter at either end, but for a, i, t, v and x."""
    return F.rlike(c, F.lit("^(?![aitvx] )[a-z] | (?![aitvx]$)[a-z]$"))


def matches(c: Column, pattern: str, hints: tuple[str, ...]) -> Column:
    """Whether a text matches; ``hints`` are literals of which any match holds one, so that most texts need no pattern."""
    some = F.contains(c, F.lit(hints[0]))
    for h in hints[1:]:
        some = some | F.contains(c, F.lit(h))
    return some & F.rlike(c, F.lit(pattern))


def non_ascii_ratio(c: Column) -> Column:
    """Share of letters beyond ASCII; 0 where there are no letters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    ascii_letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return F.when(F.octet_length(c) == F.length(c), 0.0).when(letters > 0, (letters - ascii_letters) / letters).otherwise(F.lit(0.0))


def clean_markdown(c: Column) -> Column:
    """Running text of a Markdown draft: code, markers, images, links, HTML, tables, headings and emphasis removed."""
    x = F.regexp_replace(c, r"(?s)```.*?```", " ")
    x = F.regexp_replace(x, r"\[\[.*?\]\]|\{\{.*?\}\}", " ")
    x = F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", " ")
    x = F.regexp_replace(x, r"\[([^\]]*)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"<[^>\n]*>", " ")
    x = F.regexp_replace(x, r"(?m)^[ \t]*\|.*$", "")
    x = F.regexp_replace(x, r"(?m)^[ \t]*#{1,6}[ \t].*$", "")
    x = F.regexp_replace(x, r"(?m)^[ \t]*(?:[-*+]|[0-9]+\.)[ \t]+", "")
    return F.regexp_replace(x, r"[*_`]+", "")


def sentences(body: Column) -> Column:
    """Sentences of running text: lines, cut after . ! ? and blanks before a capital, digit or quote."""
    parts = F.flatten(F.transform(F.split(body, "\n"), lambda line: F.split(line, r"(?<=[.!?])\s+(?=[\p{Lu}0-9\"'])")))
    return F.filter(F.transform(parts, lambda v: F.trim(v)), lambda s: s != "")


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent e; at least one."""
    groups = F.size(F.regexp_extract_all(F.lower(word), F.lit("[aeiouy]+"), 0))
    silent = F.rlike(F.lower(word), F.lit("[^aeiouyl]e$"))
    return F.greatest(F.lit(1), groups - F.when(silent & (groups > 1), 1).otherwise(0))


def osa(a: str, b: str, cap: int) -> int:
    """Optimal string alignment distance (a neighbouring swap costs one); cap + 1 as soon as it exceeds ``cap``."""
    if abs(len(a) - len(b)) > cap:
        return cap + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > cap:
            return cap + 1
        before, last = last, row
    return min(last[-1], cap + 1)


def osa_distance(a: Column, b: Column, cap: Column) -> Column:
    """Exact :func:`osa`; put ``levenshtein(a, b) <= 2 * cap`` before it, which loses nothing."""

    def each(a: pd.Series, b: pd.Series, cap: pd.Series) -> pd.Series:
        return pd.Series([osa(x, y, int(c)) for x, y, c in zip(a, b, cap)])

    return F.pandas_udf(each, "int")(a, b, cap)


def front_matter(text: Column) -> Column:
    """Map of the ``key: value`` lines between two ``---`` lines at the start of a draft."""
    head = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(
        lines,
        lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value")),
    )
    return F.map_from_entries(
        F.aggregate(
            pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda seen, p: F.when(F.exists(seen, lambda q: q["key"] == p["key"]), seen).otherwise(F.concat(seen, F.array(p))),
        )
    )


def product_slot(raw: Column) -> Column:
    """``name | key: value | ...`` as (name, fields)."""
    parts = F.transform(F.split(raw, r"\|"), lambda v: F.trim(v))
    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.instr(p, ":") > 1)
    fields = F.map_from_entries(
        F.transform(
            rest,
            lambda p: F.struct(
                F.lower(F.trim(F.regexp_extract(p, "^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract(p, "^[^:]*:(.*)$", 1)).alias("value"),
            ),
        )
    )
    return F.struct(F.element_at(parts, 1).alias("name"), fields.alias("fields"))


def split_list(cell: Column) -> Column:
    """A cell's items: by newline, semicolon or bar, by comma only where none of these occurs; bullets dropped."""
    strong = F.rlike(cell, F.lit(r"[\n;|]"))
    parts = F.when(strong, F.split(cell, r"[\n;|]")).otherwise(F.split(cell, ","))
    clean = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|[0-9]+[.)])\s*", "")))
    return F.filter(clean, lambda x: x != "")
