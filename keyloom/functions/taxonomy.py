"""Facets, themes, reader needs and noise as columns over an injected taxonomy.

A taxonomy is configuration: ordered lists of values with patterns.  None ships
with the library beyond a small example; structure and precedence are what the
functions give.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: People whom a phrase may name as giver ("from daughter").
GIVERS = "mom|mum|mother|dad|father|daughter|son|kids?|children|wife|husband|granddaughter|grandson|grandkids?|girlfriend|boyfriend|sister|brother|friends?|coworkers?|team|class|students?"
ORDER = ("occasion", "interest", "recipient", "product", "style", "craft")
#: Where a theme that can't stand alone goes.
THEME_FALLBACK = {
    "facts": "meaning", "food": "activities", "events": "activities", "printables": "activities", "images": "messages", "humor": "messages",
}


@dataclass(frozen=True)
class Value:
    """A facet value: patterns without anchors; ``requires`` must match too unless a product was found."""

    name: str
    patterns: tuple[str, ...]
    requires: str = ""
    seasonal: bool = False

    @property
    def pattern(self) -> str:
        return rf"(?<![{T.WORD}])(?:{'|'.join(self.patterns)})(?![{T.WORD}])"


@dataclass(frozen=True)
class Theme:
    name: str
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    generic: tuple[str, ...] = ()
    need: str = ""


@dataclass(frozen=True)
class Taxonomy:
    facets: dict[str, tuple[Value, ...]] = field(default_factory=dict)
    themes: tuple[Theme, ...] = ()
    needs: tuple[tuple[str, str], ...] = ()
    variants: dict[str, str] = field(default_factory=dict)
    phrases: dict[str, str] = field(default_factory=dict)
    synonyms: dict[str, str] = field(default_factory=dict)
    stop: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    us_terms: tuple[str, ...] = ()
    uk_terms: tuple[str, ...] = ()
    year_theme: str = "dates"
    product_theme: str = ""

    def extended(self, more: dict) -> Taxonomy:
        """Merge an extension: pattern lists are appended, scalars replaced, term lists united, need rules put first."""
        facets = dict(self.facets)
        for name, values in more.get("facets", {}).items():
            have = {v.name: v for v in facets.get(name, ())}
            for v in values:
                old = have.get(v.name)
                have[v.name] = replace(old, patterns=old.patterns + v.patterns, requires=v.requires or old.requires) if old else v
            facets[name] = tuple(have.values())
        united = {k: tuple(dict.fromkeys([*getattr(self, k), *more.get(k, ())])) for k in ("stop", "weak", "us_terms", "uk_terms")}
        tables = {k: {**getattr(self, k), **more.get(k, {})} for k in ("variants", "phrases", "synonyms")}
        return replace(
            self, facets=facets, needs=tuple(more.get("needs", ())) + self.needs, themes=self.themes + tuple(more.get("themes", ())), **united,
            **tables,
        )


def first_value(text: Column, values: tuple[Value, ...], allowed=None) -> Column:
    """The value that matches leftmost, the earlier of the list on ties; '' where none does."""
    options = []
    for i, v in enumerate(values):
        hit = F.rlike(text, F.lit(v.pattern))
        if allowed is not None:
            hit = hit & allowed(v)
        options.append(
            F.when(hit, F.struct(F.regexp_instr(text, F.lit(v.pattern)).alias("at"), F.lit(i).alias("order"), F.lit(v.name).alias("name")))
        )
    best = F.array_min(F.filter(F.array(*options), lambda x: x.isNotNull())) if options else None
    return F.coalesce(best["name"], F.lit("")) if options else F.lit("")


def blanked(text: Column, values: tuple[Value, ...]) -> Column:
    """The text with every match of a facet blanked out."""
    for v in values:
        text = F.regexp_replace(text, v.pattern, "  ")
    return text


def facets(norm: Column, t: Taxonomy) -> Column:
    """Struct of all facets.  Occasion and interest consume what they match; a giver is dropped before the recipient."""
    get = lambda n: t.facets.get(n, ())
    occasion = first_value(norm, get("occasion"))
    rest = blanked(norm, get("occasion"))
    interest = first_value(rest, get("interest"))
    rest = blanked(rest, get("interest"))
    people = F.regexp_replace(rest, rf"(?<![{T.WORD}])from (?:(?:a|an|the|my|your|our) )?(?:{GIVERS})(?![{T.WORD}])", " ")
    product = first_value(rest, get("product"))
    gate = lambda v: (product != "") | F.rlike(norm, F.lit(v.requires)) if v.requires else F.lit(True)
    return F.struct(
        occasion.alias("occasion"), interest.alias("interest"), first_value(people, get("recipient")).alias("recipient"), product.alias("product"), first_value(rest, get("style"), gate).alias("style"), first_value(rest, get("craft"), gate).alias("craft")
    )


def theme(norm: Column, found: Column, t: Taxonomy) -> Column:
    """Sub-topic: none for crafts; strong patterns in order; the product's theme; weak patterns; a lone year."""
    masked = blanked(norm, t.facets.get("occasion", ()))
    rule = lambda p: rf"(?<![{T.WORD}])(?:{'|'.join(p)})(?![{T.WORD}])"
    out = F.when(found["craft"] != "", "")
    for x in t.themes:
        if x.strong:
            out = out.when(F.rlike(masked, F.lit(rule(x.strong))), x.name)
    if t.product_theme:
        out = out.when(found["product"] != "", t.product_theme)
    for x in t.themes:
        if x.weak:
            out = out.when(F.rlike(masked, F.lit(rule(x.weak))), x.name)
    only_year = (found["occasion"] != "") & F.rlike(F.trim(masked), F.lit(r"^(19|20)[0-9]{2}$"))
    return out.when(only_year, t.year_theme).otherwise("")


def need(norm: Column, found: Column, theme_: Column, t: Taxonomy) -> Column:
    """Reader need: rules in order; a product means shopping; the theme's need; an audience means inspiration; else information."""
    out = F.when(F.lit(False), "")
    for name, pattern in t.needs:
        out = out.when(F.rlike(norm, F.lit(pattern)), name)
    out = out.when(found["product"] != "", "shop")
    for x in t.themes:
        if x.need:
            out = out.when(theme_ == x.name, x.need)
    return out.when((found["recipient"] != "") | (found["interest"] != ""), "inspire").otherwise("info")


def core_words(norm: Column, theme_: Column, t: Taxonomy) -> Column:
    """What a phrase is about: without occasion, generic words of its theme, stop words, ordinals and numbers; synonyms united."""
    masked = blanked(norm, t.facets.get("occasion", ()))
    for x in t.themes:
        if x.generic:
            masked = F.when(
                theme_ == x.name, F.regexp_replace(masked, rf"(?<![{T.WORD}])(?:{'|'.join(x.generic)})(?![{T.WORD}])", " "),
            ).otherwise(masked)
    words = T.canonical_tokens(masked, t.variants)
    if t.synonyms:
        table = F.create_map(*[F.lit(x) for kv in t.synonyms.items() for x in kv])
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return T.word_set(F.filter(words, lambda w: ~w.isin(*t.stop, "") & ~F.rlike(w, F.lit(r"^[0-9]+(st|nd|rd|th)?$"))))


def phrased(norm: Column, t: Taxonomy) -> Column:
    """Phrases rewritten, longest first."""
    for k in sorted(t.phrases, key=lambda x: (-len(x), x)):
        norm = F.regexp_replace(norm, rf"(?<![{T.WORD}]){k}(?![{T.WORD}])", t.phrases[k])
    return norm


def market_terms(norm: Column, t: Taxonomy) -> Column:
    """us, uk, mixed or '' by the spelling used."""
    has = lambda terms: F.rlike(norm, F.lit(rf"(?<![{T.WORD}])(?:{'|'.join(terms)})(?![{T.WORD}])")) if terms else F.lit(False)
    us, uk = has(t.us_terms), has(t.uk_terms)
    return F.when(us & uk, "mixed").when(us, "us").when(uk, "uk").otherwise("")


@dataclass(frozen=True)
class Noise:
    """Ordered exclusion rules (name, "norm" or "raw", pattern) and limits."""

    rules: tuple[tuple[str, str, str], ...] = ()
    max_words: int = 12
    max_chars: int = 120
    non_ascii: float = 0.3

    def reason(self, raw: Column, norm: Column) -> Column:
        """Name of the first rule that a phrase breaks, or null."""
        checks = [F.when(F.rlike(F.lower(raw) if on == "raw" else norm, F.lit(p)), F.lit(name)) for name, on, p in self.rules]
        limits = [
            F.when(F.size(T.tokens(norm)) > self.max_words, "too many words"), F.when(F.length(raw) > self.max_chars, "too long"),
            F.when(T.non_ascii_ratio(raw) > self.non_ascii, "non-ascii"),
        ]
        return F.coalesce(*checks, *limits)


def category(norm: Column, groups: dict[str, list[str]]) -> Column:
    """(first, all) of custom categories: words, or patterns after ``re:``; the first in order wins."""
    pattern = lambda words: "|".join(w[3:] if w.startswith("re:") else rf"(?<![{T.WORD}]){w}(?![{T.WORD}])" for w in words)
    hits = F.filter(F.array(*[F.when(F.rlike(norm, F.lit(pattern(words))), F.lit(name)) for name, words in groups.items()]), lambda x: x.isNotNull())
    return F.struct(F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit("")).alias("first"), hits.alias("all"))


#: A small example of our own; a real one is injected.
EXAMPLE = Taxonomy(
    facets={
        "occasion": (
            Value("mothers-day", ("mothers? day", "mothering sunday")), Value("fathers-day", ("fathers? day",)),
            Value("christmas", ("christmas", "xmas")), Value("thanksgiving", ("thanksgiving",)),
        ),
        "interest": (Value("dogs", ("dogs?", "puppy")), Value("fishing", ("fishing", "angler")), Value("gardening", ("gardening", "plants?"))),
        "recipient": (
            Value("mom", ("mom", "mum", "mother")), Value("dad", ("dad", "father")), Value("daughter", ("daughter",)),
            Value("teacher", ("teachers?",)),
        ),
        "product": (Value("mug", ("mugs?", "cups?")), Value("shirt", ("shirts?", "tees?")), Value("blanket", ("blankets?",))),
        "style": (Value("funny", ("funny",)), Value("personalized", ("personali[sz]ed", "custom"))),
        "craft": (Value("print", ("printing", "sublimation"), requires="diy|how to"),),
    },
    themes=(
        Theme("messages", strong=("what to write", "wishes", "quotes"), need="copy_ideas"), Theme("facts", strong=("facts",), need="info"),
        Theme("history", strong=("history", "origin"), generic=("history", "origin", "of")),
        Theme("dates", strong=("when is", "date of"), weak=("date", "day"), generic=("when", "is", "date")),
        Theme("gifts", weak=("gifts?", "presents?"), need="inspire"),
    ),
    needs=(("how_to", r"\bhow to\b"), ("copy_ideas", r"\bwhat to write\b"), ("choose", r"\bbest\b"), ("shop", r"\b(buy|cheap|sale)\b")),
    variants={"mum": "mom", "personalised": "personalized"}, synonyms={"present": "gift"}, stop=(
        "the", "a", "for", "to", "in", "of", "from",
    ), weak=("gift", "idea", "best"), us_terms=("mom", "color"), uk_terms=("mum", "colour"),
)
