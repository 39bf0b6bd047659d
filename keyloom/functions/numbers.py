"""Numbers as columns: tolerant parsing, difficulty fit, set similarities, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that mean "not available"; spellings of the two markets.
NOT_AVAILABLE = ("", "-", "--", "n/a", "na", "none", "null", "nan")
MARKETS = {
    "us": "us", "usa": "us", "en-us": "us", "united states": "us", "uk": "uk", "gb": "uk", "en-gb": "uk", "united kingdom": "uk",
    "great britain": "uk",
}


def _plain(x: Column, integer: bool) -> Column:
    """A number without a range: bounds, currency, blanks and percent stripped; k and m multiply; separators resolved."""
    estimate = F.rlike(x, F.lit("^[<>~≤≥≈]"))
    bare = F.regexp_replace(F.regexp_replace(x, r"^[<>~≤≥≈=]+", ""), r"[\s\p{Sc} ]", "")
    bare = F.regexp_replace(bare, "%$", "")
    unit = F.lower(F.regexp_extract(bare, "([kKmM])$", 1))
    digits = F.regexp_replace(bare, "[kKmM]$", "")
    grouped_comma = F.rlike(digits, F.lit("^[+-]?[0-9]{1,3}(,[0-9]{3})+$"))
    grouped_dot = F.rlike(digits, F.lit("^[+-]?[0-9]{1,3}(\\.[0-9]{3})+$"))
    has_comma, has_dot = F.instr(digits, ",") > 0, F.instr(digits, ".") > 0
    comma_last = F.instr(F.reverse(digits), ",") < F.instr(F.reverse(digits), ".")
    english, continental = F.regexp_replace(digits, ",", ""), F.translate(F.regexp_replace(digits, "\\.", ""), ",", ".")
    chosen = (
        F.when(has_comma & has_dot, F.when(comma_last, continental).otherwise(english))
        .when(has_comma, F.when(grouped_comma, english).otherwise(F.translate(digits, ",", ".")))
        .when(has_dot & F.lit(integer) & grouped_dot, F.regexp_replace(digits, "\\.", ""))
        .otherwise(digits)
    )
    number = F.when(F.rlike(chosen, F.lit(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")), chosen.try_cast("double"))
    times = F.when(unit == "k", 1000.0).when(unit == "m", 1000000.0).otherwise(1.0)
    return F.struct((number * times).alias("value"), estimate.alias("estimate"))


def parse_number(c: Column, integer: bool = False, range_mode: str = "low") -> Column:
    """(value, estimate) of a cell as export tools write numbers; null value where there is none.

    A range takes its ``low``, ``mid`` or ``high`` end and is an estimate; so is a bound such as ``<10``.
    """
    x = F.trim(F.translate(c, "–—", "--"))
    missing = c.isNull() | F.lower(x).isin(*NOT_AVAILABLE)
    ends = r"^([^-]*[0-9][^-]*)-([^-]*[0-9][^-]*)$"
    low, high = (_plain(F.trim(F.regexp_extract(x, ends, i)), integer)["value"] for i in (1, 2))
    of_range = {"low": low, "high": high, "mid": (low + high) / 2}[range_mode]
    plain = _plain(x, integer)
    is_range = F.rlike(x, F.lit(ends))
    value = F.when(missing, F.lit(None).cast("double")).when(is_range, of_range).otherwise(plain["value"])
    return F.struct(
        value.alias("value"),
        F.when(missing, False).when(is_range, value.isNotNull()).otherwise(plain["estimate"] & value.isNotNull()).alias("estimate"),
    )


def market(c: Column) -> Column:
    """Code of a market; unknown ones are kept as written, in lower case."""
    x = F.lower(F.trim(c))
    table = F.create_map(*[F.lit(v) for kv in MARKETS.items() for v in kv])
    return F.coalesce(F.try_element_at(table, x), x)


def fit(kd: Column, reach: float = 30.0, span: float = 30.0, floor: float = 0.05, unknown: float = 0.8) -> Column:
    """How far a site can win a keyword: 1 up to its reach, then falling in a line to the floor; unknown difficulty apart."""
    return F.when(kd.isNull(), F.lit(unknown)).when(kd <= reach, F.lit(1.0)).otherwise(F.greatest(F.lit(floor), 1.0 - (kd - reach) / span))


def fit_label(kd: Column, reach: float = 30.0, stretch: float = 15.0) -> Column:
    return F.when(kd.isNull(), "unknown").when(kd <= reach, "easy").when(kd <= reach + stretch, "stretch").otherwise("hard")


def winnable(volume: Column, kd: Column, reach: float = 30.0) -> Column:
    return volume * fit(kd, reach)


def weighted_jaccard(a: Column, b: Column, weak: list[str], strong_weight: int = 10, weak_weight: int = 3) -> Column:
    """Weighted Jaccard of two word sets; integer weights, so that no order of summing can turn a threshold."""
    inter, union = F.array_intersect(a, b), F.array_union(a, b)
    w = lambda s: word_weight(s, weak, strong_weight, weak_weight)
    return F.when(F.size(union) == 0, 0.0).otherwise(w(inter) / w(union))


def word_weight(words: Column, weak: list[str], strong_weight: int = 10, weak_weight: int = 3) -> Column:
    """Sum of the words' integer weights."""
    light = F.filter(words, lambda t: t.isin(*weak)) if weak else F.array().cast("array<string>")
    return F.size(words) * strong_weight - F.size(light) * (strong_weight - weak_weight)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def cores_compatible(a: Column, b: Column, least: float = 0.5) -> Column:
    """Core words that allow a merge: equal sets, or both given and overlapping enough."""
    return (a == b) | ((F.size(a) > 0) & (F.size(b) > 0) & (jaccard(a, b) >= least))


def close_words(a: Column, b: Column, least: float = 0.6) -> Column:
    """One set holds the other, or they overlap enough."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0) | (jaccard(a, b) >= least)


def modifier_kind(a: Column, b: Column, tones: list[str], lists: list[str]) -> Column:
    """What sets two phrases apart: nothing but tone words, list words and tones, or a segment of its own."""
    apart = F.concat(F.array_except(a, b), F.array_except(b, a))
    tone, other = F.forall(apart, lambda t: t.isin(*tones)), F.forall(apart, lambda t: t.isin(*tones, *lists))
    return F.when(F.size(apart) == 0, "same").when(tone, "tone").when(other, "list_tone").otherwise("segment")


def issue_id(check: Column, market_: Column, keyword: Column, other: Column, key) -> Column:
    """Stable identifier of a finding; ``key`` brings both phrases to their identity."""
    return F.concat(F.lit("BC-"), F.substring(F.sha1(F.encode(F.concat_ws("|", check, market_, key(keyword), key(other)), "UTF-8")), 1, 8))


def reading_grade(words: Column, sentence_count: Column, syllable_count: Column) -> Column:
    """Flesch-Kincaid grade."""
    return 0.39 * words / F.greatest(sentence_count, F.lit(1)) + 11.8 * syllable_count / F.greatest(words, F.lit(1)) - 15.59


def narrower_facets(
    own: Column, facets: dict[str, Column], counted: tuple[str, ...] = ("occasion", "recipient", "interest", "product", "craft"),
    audiences: tuple[str, ...] | None = ("occasion", "recipient", "interest"),
) -> Column:
    """How many facets a cluster names beyond its group's own; none counts in a group that no audience keys (``audiences`` None: counted anywhere)."""
    n = sum(((F.lit(f) != own) & (F.coalesce(facets[f], F.lit("")) != "")).cast("int") for f in counted if f in facets)
    return n if audiences is None else F.when(own.isin(*audiences), n).otherwise(0)


def shared_facets(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How many facets two rows have in common."""
    return sum(((F.coalesce(a[f], F.lit("")) != "") & (a[f] == b[f])).cast("int") for f in a if f in b)


def specificity(words: Column, modifiers: tuple[str, ...]) -> Column:
    """(subject words, words) of a topic; structs of it compare in that order."""
    return F.struct(F.size(F.filter(words, lambda w: ~w.isin(*modifiers))).alias("subject"), F.size(words).alias("words"))
