"""Keyword functions and operators on small cases of our own."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import dates as D
from keyloom.functions import evidence as E
from keyloom.functions import numbers as N
from keyloom.functions import text as T
from keyloom.operators import cluster as C
from keyloom.operators import documents as Doc
from keyloom.operators import links as L
from keyloom.operators import merge as M
from keyloom.operators import similarity as S
from keyloom.operators import spelling as Sp
from keyloom.sources import serp


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_normal_form(spark):
    cases = {
        "Mother’s Day GIFTS": "mothers day gifts", "what's new": "what is new", "whats up": "what is up", "top-10_ideas/list": "top 10 ideas list", "salt & pepper": "salt and pepper", "1.5 kg bag.": "1.5 kg bag",
        "sale.2025": "sale 2025", "hey siri what is lent": "what is lent", "google maps": "google maps", "  a   b ": "a b", "Über-Größe!": "über größe", "": "",
    }
    assert column(spark, list(cases), T.normal_form) == list(cases.values())


def test_collapse_repeats(spark):
    assert T.collapse("labor day labor day labor day".split()) == ["labor", "day"]
    assert T.collapse("a b c a b c".split()) == ["a", "b", "c"]
    assert column(spark, ["x x x", None, "a b"], T.collapse_repeats) == ["x", None, "a b"]


def test_stem(spark):
    cases = {"cities": "city", "ties": "tie", "watches": "watch", "boxes": "box", "glass": "glass", "cats": "cat", "bus": "bus", "this": "this", "gas": "gas"}
    assert column(spark, list(cases), T.stem) == list(cases.values())


def test_parse_number(spark):
    cells = ["1,234", "1.234,5", "10K", "<10", "1K – 10K", "$5.50", "n/a", None, "12%", "abc", "1.234"]
    got = column(spark, cells, N.parse_number)
    assert [tuple(x) for x in got] == [(1234.0, False), (1234.5, False), (10000.0, False), (10.0, True), (1000.0, True), (5.5, False), (None, False), (None, False), (12.0, False), (None, False), (1.234, False)]
    assert column(spark, ["1K – 10K"], lambda c: N.parse_number(c, range_mode="mid"))[0]["value"] == 5500.0
    whole = column(spark, ["1.234"], lambda c: N.parse_number(c, integer=True))
    assert whole[0]["value"] == 1234.0


def test_similarity_numbers(spark):
    df = spark.createDataFrame([(["gift", "mug", "dad"], ["gift", "mug", "mom"])], "a array<string>, b array<string>")
    assert df.select(N.weighted_jaccard(F.col("a"), F.col("b"), ["gift"])).first()[0] == pytest.approx(13 / 33)
    assert df.select(N.modifier_kind(F.col("a"), F.col("b"), ["dad", "mom"], [])).first()[0] == "tone"


def test_fit(spark):
    assert column(spark, [10.0, 30.0, 45.0, 90.0, None], N.fit, "double") == [1.0, 1.0, 0.5, 0.05, 0.8]


def test_easter(spark):
    from dateutil.easter import easter

    years = list(range(1900, 2200))
    assert column(spark, years, D.easter, "int") == [easter(y) for y in years]


def test_weekday_rules(spark):
    one = spark.range(1).select(D.nth_weekday(F.lit(2026), 5, "SUN", 2), D.nth_weekday(F.lit(2026), 11, "THU", 4), D.last_weekday(F.lit(2026), 5, "MON")).first()
    assert list(one) == [datetime.date(2026, 5, 10), datetime.date(2026, 11, 26), datetime.date(2026, 5, 25)]


def test_evidence(spark):
    got = column(spark, ["I, C", "transactional|Branded", "non-branded local", "", None], E.intents)
    assert [(x["intents"], x["branded"], x["local"]) for x in got] == [(["commercial", "informational"], None, None), (["transactional"], True, None), ([], False, True), ([], None, None), ([], None, None)]
    assert column(spark, ["Image pack, Organic, Odd box"], E.result_features) == [["image_pack", "other:odd box"]]
    df = spark.createDataFrame([([1.0, 5.0, 5.0], 12)], "v array<double>, m int")
    assert df.select(E.peak_month(F.col("v"), F.col("m"))).first()[0] == "December"


def test_merge_sources_folds_in_order(spark):
    rows = [("k", 1, 1, 100, None, 7.0, "u1", "a", "t"), ("k", 2, 2, 50, 40.0, 3.0, "u2", "b", "t"), ("k", 3, 2, 50, 10.0, None, "u3", "a", "t")]
    df = spark.createDataFrame(rows, "key string, idx long, vclass int, volume long, kd double, position double, url string, src string, tool string")
    r = M.merge_sources(df, ["key"]).first()
    assert (r["vclass"], r["volume"], r["kd"], r["position"], r["url"], r["src"], r["n_rows"]) == (2, 50, 40.0, 3.0, "u2", "a|b", 3)


def test_merge_variants_prefers_no_year(spark):
    df = spark.createDataFrame([("g", "cards 2024", 100, 1), ("g", "cards", 30, 2), ("g", "card", 30, 3)], "g string, p string, v long, o long")
    r = M.merge_variants(df, ["g"], "p", "v", "o").first()
    assert (r["p"], r["variants"], r["variant_volumes"]) == ("cards", ["cards 2024", "card"], [100, 30])


def test_routing_is_a_partition(spark):
    df = spark.range(100)
    routed = M.route(df, [("even", F.col("id") % 2 == 0), ("three", F.col("id") % 3 == 0)])
    kept, excluded = M.kept_and_excluded(routed)
    assert kept.count() + excluded.count() == 100 and excluded.filter("reason = 'three'").count() == 17


def test_prefix_join_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, "g", sorted(set(rng.choices("abcdefghij", k=rng.randint(1, 6))))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, words array<string>")
    for least in (0.34, 0.6, 0.75):
        got = {(r["a"], r["b"]) for r in S.similar_pairs(df, "id", "words", ["g"], least, ["a", "b"]).collect()}
        weight = lambda s: sum(3 if t in "ab" else 10 for t in s)
        want = {(a, b) for a, _, x in rows for b, _, y in rows if a < b and weight(set(x) & set(y)) / weight(set(x) | set(y)) >= least}
        assert got == want


def test_leaders_equal_the_loop(spark):
    rng = random.Random(5)
    n = 80
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(160)) if a != b})
    scored = [(a, b, rng.randint(1, 2), round(rng.random(), 2)) for a, b in edges]
    nodes = spark.createDataFrame([(i, i) for i in range(n)], "id long, rank long")
    df = spark.createDataFrame(scored, "a long, b long, tier int, score double")
    assert {r["id"]: r["seed"] for r in C.leaders(nodes, df).collect()} == C.leaders_by_loop(list(range(n)), scored)


def test_global_rank_is_gapless(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    got = [(r["rank"], r["v"], r["id"]) for r in C.global_rank(df, [F.desc("v"), F.asc("id")], "rank").orderBy("rank").collect()]
    want = sorted(((i % 7, i) for i in range(500)), key=lambda x: (-x[0], x[1]))
    assert got == [(k + 1, v, i) for k, (v, i) in enumerate(want)]


def test_best_name(spark):
    rows = [("c", "gifts 2024", 100, False, -1.0), ("c", "gifts for dad", 90, False, -2.0), ("c", "dad gifts", 80, False, -1.0), ("c", "gfits", 95, True, -9.0)]
    df = spark.createDataFrame(rows, "cluster string, phrase string, volume long, typo boolean, fluency double")
    assert C.best_name(df, "cluster").first()["name"] == "dad gifts"


def test_spelling(spark):
    rows = [(i, ["personal", "blanket"]) for i in range(60)] + [(100, ["personl", "blanket"])]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    fixes = Sp.typos(df, "words")
    assert [(r["wrong"], r["right"]) for r in fixes.collect()] == [("personl", "personal")]
    assert Sp.respell(df.filter("id = 100"), "id", "words", fixes).first()["respelled"] == "personal blanket"


def test_all_spelling_maps(spark):
    texts = ["thanksgiving day"] * 60 + ["when is thanksgiving"] * 50 + ["thanksgiving costume"] * 40
    odd = {
        "thnksgving day": "thanksgiving day", "thanks giving day": "thanksgiving day", "thanksgivi g costume": "thanksgiving costume", "whenis thanksgiving": "when is thanksgiving",
        "thanksgiving da": "thanksgiving day", "thanksgivng da": "thanksgiving day", "thanksgving": "thanksgiving", "thanksgivign costme": "thanksgiving costume", "day": "day", "is real": "is real",
    }
    rows = [(i, t.split()) for i, t in enumerate([*texts, *odd, ""])]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    got = {r["id"]: (r["respelled"], r["fixed"]) for r in Sp.respell_all(df, "id", "words").collect()}
    assert {t: got[len(texts) + i] for i, t in enumerate(odd)} == {t: (w, t != w) for t, w in odd.items()}
    assert all(got[i] == (t, False) for i, t in enumerate(texts))


def test_osa(spark):
    assert T.osa("abcd", "abdc", 2) == 1 and T.osa("abc", "xyz", 1) == 2 and T.osa("a", "abcd", 2) == 3


def test_documents(spark):
    text = "# Title\n\nWe tested the best mug. It costs $20.\n\nUnder $30 it is fine. [[slot: Mug | why: warm | price: 20]]"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert {(r["paragraph"], r["rule"]) for r in Doc.claims(df).collect()} == {(1, "superlative"), (1, "price"), (1, "first hand")}
    assert Doc.review(df).count() == 3
    s = Doc.slots(df).first()
    assert (s["name"], s["fields"]["why"], "in intro" in s["problems"]) == ("Mug", "warm", True)


def test_link_plan_invariants(spark):
    rows = [("us", f"p{i}", "a" if i < 20 else "b", i in (0, 20), float(100 - i), ["x", f"w{i % 4}"], [f"anchor {i}", f"other {i % 3}"]) for i in range(40)]
    df = spark.createDataFrame(rows, "market string, slug string, pillar string, is_pillar boolean, value double, words array<string>, anchors array<string>")
    links = [r.asDict() for r in L.plan(df).collect()]
    assert all(x["source"] != x["target"] for x in links) and len({(x["source"], x["target"]) for x in links}) == len(links)
    assert sum(x["source"] == "p0" and x["kind"] == "down" for x in links) == 12
    assert {x["target"] for x in links} == {x["source"] for x in links} == {f"p{i}" for i in range(40)}


def test_link_plan_of_a_large_market():
    import time

    import pandas as pd

    n = 6000
    rows = [("us", f"p{i:04d}", f"t{i % 6}", i < 6, float(i * 7919 % n), [f"a{i % 8}", f"b{i // 8 % 8}"], [f"a{i % 8} b{i // 8 % 8}"]) for i in range(n)]
    began = time.process_time()
    links = L.plan_market(pd.DataFrame(rows, columns=["market", "slug", "pillar", "is_pillar", "value", "words", "anchors"]))
    assert time.process_time() - began < 20  # by comparing all posts with all: more than a minute
    words, names = {r[1]: set(r[5]) for r in rows}, [r[1] for r in rows]
    assert set(links["target"]) == set(names) == set(links["source"])
    assert (links[links["source"] == "p0000"].groupby("kind").size() <= 12).all()
    for kind, s in [*links[links["kind"] == "related"].groupby("source").head(1).iloc[::500][["kind", "source"]].itertuples(index=False)]:
        mine = [t for t in names if t != s and int(t[1:]) % 6 == int(s[1:]) % 6 and int(t[1:]) >= 6]
        best = sorted(mine, key=lambda t: (-len(words[s] & words[t]), t))[:3]
        assert links[(links["source"] == s) & (links["kind"] == kind)]["target"].tolist() == best


def test_serp_and_variants(spark):
    rows = [("Dad gifts", "us", "2026-01-01", 1, "https://www.a.com/x/", ""), ("dad gifts", "us", "2026-02-01", 2, "https://b.com", "B"), ("dad gifts", "us", "2026-02-01", 1, "http://a.com/?q", "A")]
    df = spark.createDataFrame(rows, "keyword string, market string, checked_at string, position int, url string, title string")
    latest = serp.latest_results(df)
    assert latest.first()["urls"] == ["a.com", "b.com"]
    kw = spark.createDataFrame([(1, "gifts for dad", ["dad-gifts"], "us"), (2, "none", None, "us")], "id long, keyword string, variants array<string>, market string")
    assert {r["id"]: r["urls"] for r in serp.apply_results(kw, latest, "id", "keyword", "variants", "market").collect()} == {1: ["a.com", "b.com"], 2: None}


def test_text_helpers(spark):
    assert column(spark, ["a, b", "a; b, c", "- x\n2) y"], T.split_list) == [["a", "b"], ["a", "b, c"], ["x", "y"]]
    assert column(spark, ["---\ntitle: A: b\nk: v\n---\nbody", "none"], T.front_matter) == [{"title": "A: b", "k": "v"}, {}]
    assert column(spark, ["One two. Three 1.5 four! five"], T.sentences) == [["One two.", "Three 1.5 four! five"]]
    assert column(spark, ["x mugs", "a mugs", "mugs q"], T.stray_letter) == [False, False, True]
    assert column(spark, ["cake", "banana", "the"], T.syllables) == [1, 3, 1]
