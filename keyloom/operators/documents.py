"""Checks of draft documents: readability, draft review, claims, product slots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T


def readability(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, sentences (runs up to . ! ?), vowel groups and the Flesch-Kincaid grade of each document."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.regexp_extract_all(body, F.lit("[A-Za-z]+"), 0)).cast("long")
    ends = F.size(F.regexp_extract_all(body, F.lit("[^.!?]*[A-Za-z][^.!?]*"), 0)).cast("long")
    groups = F.size(F.regexp_extract_all(F.lower(body), F.lit("[aeiouy]+"), 0)).cast("long")
    counted = docs.select(doc_id, words.alias("words"), ends.alias("sentences"), groups.alias("vowel_groups"))
    return counted.withColumn("grade", F.round(N.reading_grade(F.col("words"), F.col("sentences"), F.col("vowel_groups")), 4))


#: Thresholds of the draft review.
LIMITS = {
    "long_text": 800, "min_h2": 3, "intro_words": 150, "grade": 10, "mean_sentence": 22, "long_sentence": 30, "long_share": 10.0,
    "passive_share": 25.0, "density": 2.0, "cliches": 2.0,
}
CLICHES = "in today's fast-paced world|look no further|game.?changer|unlock the|elevate your|dive into|it's important to note|whether you're|without further ado|the perfect way"
COST = {"high": 8.0, "medium": 4.0, "low": 1.5}


def review(docs: DataFrame, keyword: str | None = None) -> DataFrame:
    """One row a document: metrics, findings (severity, check), score and band."""
    t = F.coalesce(F.col("text"), F.lit(""))
    body = T.clean_markdown(F.regexp_replace(t, r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", ""))
    x = docs.withColumn("_t", t).withColumn("_b", body).withColumn("_s", T.sentences(F.col("_b")))
    x = x.withColumn("_w", F.regexp_extract_all(F.lower("_b"), F.lit(r"[\p{L}\p{N}']+"), 0)).withColumn("words", F.size("_w"))
    lengths = F.transform("_s", lambda s: F.size(F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}']+"), 0)))
    x = x.withColumn("_n", lengths).withColumn("sentences", F.greatest(F.size("_s"), F.lit(1)))
    x = x.withColumn("h1", F.size(F.regexp_extract_all("_t", F.lit(r"(?m)^# \S"), 0))).withColumn(
        "h2", F.size(F.regexp_extract_all("_t", F.lit(r"(?m)^## \S"), 0)),
    )
    levels = F.transform(F.regexp_extract_all("_t", F.lit(r"(?m)^(#{1,6}) \S"), 1), F.length)
    x = x.withColumn("_l", levels).withColumn(
        "jumps",
        F.size(
            F.filter(
                F.zip_with(
                    F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), F.slice("_l", 1, F.greatest(F.size("_l") - 1, F.lit(0))), lambda b, a: b - a,
                ),
                lambda d: d > 1,
            )
        ),
    )
    syll = F.aggregate(F.transform("_w", T.syllables), F.lit(0), lambda a, s: a + s)
    x = x.withColumn("grade", F.round(N.reading_grade(F.col("words"), F.col("sentences"), syll), 1))
    x = x.withColumn("mean_sentence", F.round(F.col("words") / F.col("sentences"), 1))
    x = x.withColumn("long_pct", F.round(F.size(F.filter("_n", lambda n: n > LIMITS["long_sentence"])) * 100.0 / F.col("sentences"), 1))
    passive = F.filter(
        "_s", lambda s: F.rlike(s, F.lit(_whole(r"(?:is|are|was|were|be|been|being)\s+(?:[a-z]+ed|made|given|known|shown|done|sent|kept)"))),
    )
    x = x.withColumn("passive_pct", F.round(F.size(passive) * 100.0 / F.col("sentences"), 1))
    unsupported = F.filter(
        "_s",
        lambda s: F.rlike(s, F.lit(r"[0-9]+(\.[0-9]+)?\s?(%|percent|million|billion)")) & ~F.rlike(
            s, F.lit(r"(?i)according to|source|survey|study|report"),
        ),
    )
    x = x.withColumn("unsupported", F.size(unsupported)).withColumn("cliches", F.size(F.regexp_extract_all(F.lower("_b"), F.lit(CLICHES), 0)))
    rules = [
        ("high", "h1", F.col("h1") != 1),
        ("medium", "few headings", (F.col("words") > LIMITS["long_text"]) & (F.col("h2") < LIMITS["min_h2"])),
        ("low", "heading jump", F.col("jumps") > 0),
        ("medium", "grade", F.col("grade") > LIMITS["grade"]),
        ("medium", "sentence length", F.col("mean_sentence") > LIMITS["mean_sentence"]),
        ("low", "long sentences", F.col("long_pct") > LIMITS["long_share"]),
        ("low", "passive", F.col("passive_pct") > LIMITS["passive_share"]),
        ("high", "unsupported numbers", F.col("unsupported") >= 3),
        ("medium", "cliches", F.col("cliches") * 1000.0 > LIMITS["cliches"] * F.col("words")),
    ]
    if keyword:
        density = F.size(F.filter("_w", lambda w: w == keyword.lower())) * 100.0 / F.greatest("words", F.lit(1))
        rules.append(("medium", "density", density > LIMITS["density"]))
    found = F.filter(
        F.array(*[F.when(hit, F.struct(F.lit(sev).alias("severity"), F.lit(name).alias("check"))) for sev, name, hit in rules]),
        lambda f: f.isNotNull(),
    )
    cost = F.aggregate(
        F.col("findings"), F.lit(0.0), lambda a, f: a + F.when(f["severity"] == "high", COST["high"]).when(f["severity"] == "medium", COST["medium"]).otherwise(COST["low"]),
    )
    x = x.withColumn("findings", found).withColumn("score", F.greatest(F.lit(0.0), 100.0 - cost))
    x = x.withColumn("band", F.when(F.col("score") >= 85, "ready").when(F.col("score") >= 70, "revise").otherwise("rework"))
    return x.select(
        "doc_id", "words", "sentences", "h1", "h2", "jumps", "grade", "mean_sentence", "long_pct", "passive_pct", "unsupported", "cliches",
        "findings", "score", "band",
    )


@dataclass(frozen=True)
class Claim:
    """A rule on paragraphs: a pattern, its severity, and a pattern that excuses it."""

    name: str
    severity: str
    pattern: str
    excused_by: str = ""


def _whole(words: str) -> str:
    """Any of the words as whole words, in any case; spelt without look-around or ``\\b``, whose reach differs between engines."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{words})(?:[^\p{{L}}\p{{N}}_]|$)"


#: Claim rules.
CLAIMS = [
    Claim("superlative", "medium", _whole(r"best|perfect|ultimate|number one|guaranteed")),
    Claim("price", "high", r"[$£€][0-9]+(\.[0-9]+)?", _whole(r"under|budget|below")),
    Claim("health", "high", _whole(r"cures?|heals?|treats?|prevents?")),
    Claim("first hand", "high", _whole(r"we tested|i tried|in our tests"), r"(?i)(?:^|[^\p{L}])(?:evidence|experience|data):"),
    Claim("urgency", "medium", _whole(r"limited time|last chance|hurry|act now")),
    Claim("shipping", "medium", _whole(r"free shipping|next day delivery|ships today")),
    Claim("sustainability", "high", _whole(r"eco.?friendly|carbon neutral|sustainable|organic")),
]


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, body): parts between blank lines, numbered from 0."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n[ \t\r]*\n")).alias("paragraph", "body"))


def claims(docs: DataFrame, rules: list[Claim] | None = None, approval: str = r"\[approved[^\]]*\]") -> DataFrame:
    """One row per paragraph and rule that it breaks, with the number of hits; approved paragraphs are waived."""
    rules = rules or CLAIMS
    hits = lambda r: F.size(F.regexp_extract_all("body", F.lit(f"({r.pattern})"), 1)).cast("long")
    rows = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"),
                F.when(
                    F.rlike("body", F.lit(r.excused_by)) if r.excused_by else F.lit(False), F.lit(0).cast("long"),
                ).otherwise(hits(r)).alias("hits"),
            ) for r in rules
        ]
    )
    found = paragraphs(docs).select("doc_id", "paragraph", F.rlike("body", F.lit(approval)).alias("waived"), F.explode(rows).alias("c"))
    return found.select(
        "doc_id", F.col("paragraph").cast("long").alias("paragraph"), "c.rule", "c.severity", F.col("c.hits").cast("long").alias("hits"), "waived",
    ).filter("hits > 0")


def brand_hits(rows: DataFrame, text: Column, names: list[str]) -> DataFrame:
    """Rows whose normal form holds a watched name, with an optional plural; the list is configuration, bounded by its file."""
    pattern = r"(?<![\p{L}\p{N}])(" + "|".join(sorted(names, key=len, reverse=True)) + r")s?(?![\p{L}\p{N}])"
    return rows.withColumn(
        "brands", F.array_sort(F.array_distinct(F.regexp_extract_all(T.normal_form(text), F.lit(pattern), 1))),
    ).filter(F.size("brands") > 0)


def slots(
    docs: DataFrame, marker: str = r"\[\[slot:([^\]]*)\]\]", required: tuple[str, ...] = ("why", "price"), intro_words: int = 100, spacing: int = 60,
) -> DataFrame:
    """One row a product slot: its fields, word position, gap to the slot before, and what is wrong with it."""
    t = F.coalesce(F.col("text"), F.lit(""))
    found = F.regexp_extract_all(t, F.lit(marker), 1)
    parts = F.split(t, marker)
    each = docs.select(
        "doc_id", F.posexplode(F.arrays_zip(found.alias("raw"), F.slice(parts, F.lit(1), F.size(found)).alias("before"))).alias("slot", "x"),
    )
    w = Window.partitionBy("doc_id").orderBy("slot")
    each = each.withColumn("gap", F.size(F.filter(F.split("x.before", r"\s+"), lambda v: v != ""))).withColumn(
        "position", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    each = each.withColumn("s", T.product_slot(F.col("x.raw")))
    missing = F.filter(F.array(*[F.lit(r) for r in required]), lambda r: F.coalesce(F.try_element_at("s.fields", r), F.lit("")) == "")
    problems = [
        ("missing field", F.size(missing) > 0), ("url in slot", F.rlike("x.raw", F.lit("https?://"))), ("in intro", F.col("position") < intro_words),
        ("too close", (F.col("slot") > 0) & (F.col("gap") < spacing)),
    ]
    wrong = F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in problems]), lambda p: p.isNotNull())
    return each.select(
        "doc_id", F.col("slot").cast("long").alias("slot"), "s.name", "s.fields", F.col("position").cast("long").alias("position"),
        F.col("gap").cast("long").alias("gap"), wrong.alias("problems"),
    )
