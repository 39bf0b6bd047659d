"""Facets, needs and roll-ups on small cases of our own."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import taxonomy as X
from keyloom.operators import rollups as R


def test_facets_and_needs(spark):
    cases = ["dog mom mug", "mothers day gifts from daughter", "sublimation shirts", "sublimation paper", "how to write christmas history", "thanksgiving 2025", "funny gifts for dad", "buy it"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i long, norm string").withColumn("f", X.facets(F.col("norm"), X.EXAMPLE))
    df = df.withColumn("t", X.theme(F.col("norm"), F.col("f"), X.EXAMPLE)).withColumn("need", X.need(F.col("norm"), F.col("f"), F.col("t"), X.EXAMPLE)).withColumn("core", X.core_words(F.col("norm"), F.col("t"), X.EXAMPLE))
    r = {x["norm"]: x for x in df.collect()}
    dog = r["dog mom mug"]["f"]
    assert (dog["interest"], dog["recipient"], dog["product"]) == ("dogs", "mom", "mug") and r["dog mom mug"]["need"] == "shop"
    day = r["mothers day gifts from daughter"]["f"]
    assert (day["occasion"], day["recipient"]) == ("mothers-day", "")
    assert r["sublimation shirts"]["f"]["craft"] == "print" and r["sublimation paper"]["f"]["craft"] == ""
    assert r["thanksgiving 2025"]["t"] == "dates" and r["how to write christmas history"]["need"] == "how_to"
    assert r["how to write christmas history"]["t"] == "history" and "history" not in r["how to write christmas history"]["core"]
    assert r["funny gifts for dad"]["need"] == "inspire" and r["buy it"]["need"] == "shop"


def test_extension_merges():
    more = X.EXAMPLE.extended({"facets": {"product": (X.Value("mug", ("tumblers?",)), X.Value("hat", ("hats?",)))}, "needs": (("solve", r"\bfix\b"),), "stop": ("the", "an")})
    assert more.facets["product"][0].patterns == ("mugs?", "cups?", "tumblers?") and more.facets["product"][-1].name == "hat"
    assert more.needs[0][0] == "solve" and more.stop.count("the") == 1


def test_noise_and_categories(spark):
    noise = X.Noise(rules=(("url", "raw", r"www\."), ("local", "norm", r"\bnear me\b")))
    df = spark.createDataFrame([("www.x.com near me", "www x com near me"), ("shops near me", "shops near me"), ("größe äöü", "größe äöü"), ("fine", "fine"), ("a " * 13, "a " * 13)], "raw string, norm string")
    assert [r[0] for r in df.select(noise.reason(F.col("raw"), F.col("norm"))).collect()] == ["url", "local", "non-ascii", None, "too many words"]
    c = df.select(X.category(F.col("norm"), {"shops": ["shop", "re:shops?"], "near": ["near me"]}).alias("c")).collect()
    assert (c[1]["c"]["first"], c[1]["c"]["all"], c[3]["c"]["first"]) == ("shops", ["shops", "near"], "")


def test_rollups(spark):
    m = spark.createDataFrame([("c", "seed", 10, None, None), ("c", "serp:4", 30, None, None), ("c", "lexical:0.70", 60, None, None), ("d", "seed", 5, None, "g")], "cluster string, joined string, volume long, decision_ids array<string>, `group` string")
    assert {r["cluster"]: r["verified"] for r in R.verified_share(m, "cluster").collect()} == {"c": 0.4, "d": 0.0}
    assert {r["cluster"]: r["basis"] for r in R.grouping_basis(m, "cluster").collect()} == {"c": "mixed", "d": "group"}
    posts = spark.createDataFrame([("p", 1, ["mug"]), ("p", 2, ["mug", "dad"]), ("p", 3, ["mug", "mom"]), ("p", 4, ["hat"])], "pillar string, id long, words array<string>")
    assert [(r["word"], r["hub"], r["posts"]) for r in R.sub_hubs(posts, "pillar").collect()] == [("mug", 1, "2|3")]
    assert {r["word"] for r in R.topic_words(posts, "pillar", "words").collect()} == {"mug"}
    a = spark.createDataFrame([(1, "p1", "t", "c", 9, ["x", "y"]), (2, "p2", "t", "c", 5, ["x", "y"]), (3, "p3", "t", "d", 5, ["x"])], "id long, pillar string, topic string, core string, owned long, words array<string>")
    assert {r["id"]: r["merged_into"] for r in R.across_pillars(a).collect()} == {1: None, 2: 1, 3: None}
    new = spark.createDataFrame([("s1", "u1", "x", ""), ("s2", "", "sig", ""), ("s3", "", "none", "own")], "slug string, url string, signature string, writer string")
    old = spark.createDataFrame([("o1", "u1", "q", "ann"), ("o2", "u9", "sig", "bob")], "old_slug string, url string, signature string, writer string")
    assert {r["slug"]: (r["writer"], r["carried"]) for r in R.carry_over(new, old, ["writer"]).collect()} == {"s1": ("ann", True), "s2": ("bob", True), "s3": ("own", False)}
    t = spark.createDataFrame([("25 Best Mugs for Dad (2024): our picks",)], "t string")
    assert t.select(R.anchor_from_title(F.col("t"))).first()[0] == "best mugs for dad"
