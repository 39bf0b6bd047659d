"""Evidence columns of keyword exports: intents, result features, trends, bucketed volumes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intent names by word, letter and number; result features by the name that tools give them.
INTENTS = {
    "informational": "informational", "i": "informational", "1": "informational", "navigational": "navigational", "n": "navigational",
    "2": "navigational", "commercial": "commercial", "c": "commercial", "0": "commercial", "transactional": "transactional", "t": "transactional",
    "3": "transactional",
}
FEATURES = {
    "featured_snippet": ("featured snippet", "featured snippets"), "paa": ("people also ask",), "ai_overview": ("ai overview", "ai overviews"), "image_pack": (
        "image pack", "images", "image", "featured images",
    ),
    "video": ("video", "videos", "video carousel", "video preview", "short videos", "featured video"), "shopping": (
        "popular products", "shopping ads", "shopping", "shopping results",
    ), "local_pack": ("local pack", "local results"), "top_stories": ("top stories",),
    "knowledge_panel": ("knowledge panel", "knowledge graph", "knowledge card"), "discussions": ("discussions and forums", "discussions"), "ads": (
        "ads top", "ads bottom", "adwords top", "adwords bottom", "top ads", "bottom ads", "ads", "paid",
    ),
    "sitelinks": ("sitelinks", "site links"), "things_to_know": ("things to know",), "reviews": ("reviews",), "instant_answer": ("instant answer",), "thumbnail": ("thumbnail", "thumbnails"),
}
#: Features by which a result page answers questions.
RESEARCH_FEATURES = ("paa", "featured_snippet", "ai_overview")
NO_VALUE = ("", "-", "--", "n/a", "na", "null", "none", "nan", "—")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def intents(c: Column, flags: dict[str, Column] | None = None) -> Column:
    """(intents, branded, local) of an intent cell and of true / false columns; branded and local are null where nothing says so.

    ``flags`` maps an intent's name, ``branded`` or ``local`` to its column; a
    flag outweighs the cell.  ``non-branded`` and ``non-local`` say no.
    """
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\bnon[\s_-]*", "non-")
    parts = F.filter(F.split(text, r"[,;|/\s]+"), lambda x: ~x.isin(*NO_VALUE))
    known = F.filter(F.transform(parts, lambda x: F.try_element_at(_table(INTENTS), x)), lambda x: x.isNotNull())
    said = {}
    for name, cell in (flags or {}).items():
        low = F.lower(F.trim(cell.cast("string")))
        said[name] = F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)
    marked = [F.when(v, F.lit(n)) for n, v in said.items() if n not in ("branded", "local")]
    both = F.concat(known, F.filter(F.array(*marked), lambda x: x.isNotNull())) if marked else known
    flag = lambda n: F.coalesce(said.get(n, F.lit(None).cast("boolean")), F.when(F.array_contains(parts, n), True).when(F.array_contains(parts, f"non-{n}"), False))
    return F.struct(F.array_sort(F.array_distinct(both)).alias("intents"), flag("branded").alias("branded"), flag("local").alias("local"))


def result_features(c: Column) -> Column:
    """Sorted slugs of a cell's result features; unknown ones as ``other:name``; organic results are no feature."""
    names = {name: slug for slug, all_ in FEATURES.items() for name in all_}
    cells = F.split(F.translate(F.lower(F.coalesce(c, F.lit(""))), "_", " "), r"[,;|\n]")
    parts = F.filter(
        F.transform(cells, lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"\s+", " "), '"', ""))), lambda x: ~x.isin(*NO_VALUE, "organic"),
    )
    return F.array_sort(F.array_distinct(F.transform(parts, lambda x: F.coalesce(F.try_element_at(_table(names), x), F.concat(F.lit("other:"), x)))))


#: Months as headers write them, three letters or more.
_MONTH = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def month_number(name: Column) -> Column:
    """1-12 of a month's name or its first three letters; null for anything else."""
    at = F.array_position(F.array(*[F.lit(m) for m in _MONTH.split("|")]), F.substring(F.lower(F.trim(name)), 1, 3))
    return F.when(at > 0, at.cast("int"))


def monthly_header(header: Column) -> Column:
    """``2025-05`` for a header like ``Searches: May 2025``; null for any other."""
    pattern = rf"(?i)^\s*searches:\s*({_MONTH})[a-z]*\s+((?:19|20)[0-9]{{2}})\s*$"
    number = month_number(F.regexp_extract(header, pattern, 1))
    return F.when(number.isNotNull(), F.concat_ws("-", F.regexp_extract(header, pattern, 2), F.lpad(number.cast("string"), 2, "0")))


def header_range(header: Column) -> Column:
    """(first, last) month of a header like ``SV trend (09-2024 - 08-2026)``; null where it names none."""
    pattern = r"([0-9]{1,2})-((?:19|20)[0-9]{2})\s*[-–]\s*([0-9]{1,2})-((?:19|20)[0-9]{2})"
    part = lambda m, y: F.concat_ws("-", F.regexp_extract(header, pattern, y), F.lpad(F.regexp_extract(header, pattern, m), 2, "0"))
    return F.when(F.rlike(header, F.lit(pattern)), F.struct(part(1, 2).alias("first"), part(3, 4).alias("last")))


def month_shift(month: Column, n: Column) -> Column:
    """A month ``2025-05`` so many months on."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), n), "yyyy-MM")


def read_trend(monthly: Column, months: list[str], cell: Column, header: Column) -> Column:
    """(values, scale, last month): exact monthly columns first, else the trend cell.

    ``monthly`` is a map from month to volume; its series counts when every month
    of the file has a value, and whatever it has keeps the trend cell out.  A
    trend cell is anchored in time only where its length is that of the months
    that its header names.
    """
    listed = F.filter(
        F.transform(F.array(*[F.lit(m) for m in months]), lambda m: F.try_element_at(monthly, m).cast("double")), lambda v: v.isNotNull(),
    )
    whole = F.size(listed) == len(months)
    got, span = trend(cell), header_range(header)
    ends = F.when((got["scale"] == "absolute") & (month_shift(span["first"], F.size(got["values"]) - 1) == span["last"]), span["last"])
    none = F.array().cast("array<double>")
    row = lambda v, s, e: F.struct(v.alias("values"), s.alias("scale"), e.alias("last"))
    nothing = row(none, F.lit(""), F.lit(None).cast("string"))
    by_month = F.when(whole, row(listed, F.lit("absolute"), F.lit(months[-1]))).otherwise(nothing) if months else nothing
    return F.when(F.coalesce(F.size(F.map_keys(monthly)), F.lit(0)) > 0, by_month).otherwise(
        F.when(F.coalesce(cell, F.lit("")) != "", row(got["values"], got["scale"], ends)).otherwise(nothing)
    )


def trend(c: Column) -> Column:
    """(values, scale) of a trend cell: bracketed series are 0-100, values up to 1 relative, others absolute."""
    text = F.coalesce(c, F.lit(""))
    values = F.transform(F.regexp_extract_all(text, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), 0), lambda x: x.cast("double"))
    top = F.array_max(values)
    scale = F.when(F.size(values) == 0, "").when(F.instr(text, "[") > 0, "0-100").when(top <= 1, "relative").when(top.isNotNull(), "absolute").otherwise("unknown")
    return F.struct(values.alias("values"), scale.alias("scale"))


def peak_month(values: Column, last_month: Column) -> Column:
    """Name of the month of the greatest value, the latest on a tie; ``last_month`` (1-12) is that of the last value."""
    top = F.array_max(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    month = F.pmod(last_month - 1 - (F.size(values) - 1 - top["i"]), F.lit(12)) + 1
    return F.when(
        (F.size(values) > 0) & last_month.isNotNull() & (top["v"] > 0), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month.cast("int")),
    )
