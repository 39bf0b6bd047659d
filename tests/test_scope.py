"""What a run takes in, given groups, sub-topics, slugs, cells and audits: against plain statements and by hand."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from keyloom.functions import evidence as E
from keyloom.operators import cluster as C
from keyloom.operators import cover as V
from keyloom.operators import links as L
from keyloom.operators import priors as Pr
from keyloom.operators import review as R
from keyloom.operators import scope as Sc

MEMBERS = "market string, group string, keyword string, is_main boolean, volume long, kd double, need string, parent string, words array<string>"


def test_leaders_with_topics_equal_the_loop(spark):
    rng = random.Random(11)
    for seed in range(3):
        n = 60
        edges = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(70)) if a != b})
        scored = [(a, b, rng.randint(1, 2), round(rng.random(), 2)) for a, b in edges]
        topics = {i: rng.choice([None, "t1", "t2", "t3", "t4"]) for i in range(n)}
        nodes = spark.createDataFrame([(i, i, topics[i]) for i in range(n)], "id long, rank long, parent string")
        df = spark.createDataFrame(scored, "a long, b long, tier int, score double")
        got = {r["id"]: r["seed"] for r in C.leaders(nodes, df, topic="parent").collect()}
        assert got == C.leaders_by_loop(list(range(n)), scored, topics)


def naive_cover(cores, volumes, hub, p):
    light = frozenset(p.modifiers)
    spec = lambda n: (len(n - light), len(n))
    nodes = [n for n in {frozenset(c) for c in cores if c} | {frozenset([w]) for c in cores for w in c} if not n <= hub]
    owner, picked = [hub] * len(cores), {}
    floor = max(p.least, p.share * sum(volumes))
    bar = max(p.least, min(floor, p.always))
    while True:
        options = []
        for n in nodes:
            g = sum(v for c, v, o in zip(cores, volumes, owner) if n <= c and spec(n) > spec(o))
            if n not in picked and g >= bar and not any(q < n and (n - q <= light or g < p.of_wider * h) for q, h in picked.items()):
                options.append((g, -len(n), sorted(n), n))
        if not options:
            break
        g, _, _, n = max(options)
        if not picked:
            bar = max(p.least, min(max(floor, p.of_strongest * g), p.always))
        picked[n] = g
        owner = [n if n <= c and spec(n) > spec(o) else o for c, o in zip(cores, owner)]
    return owner, {n for n in picked if any(o == n for o in owner) and 2 * sum(v for o, v in zip(owner, volumes) if o == n) >= bar}


def test_sub_topics_equal_the_plain_choice(spark):
    rng = random.Random(2)
    words = ["books", "story", "kids", "games", "week", "food", "facts", "trivia", "family"]
    for _ in range(60):
        cores = [frozenset(rng.sample(words, rng.randint(0, 3))) for _ in range(rng.randint(1, 25))]
        volumes = [rng.choice([10, 50, 100, 300, 900, 2500]) for _ in cores]
        hub = frozenset(rng.sample(words, rng.randint(0, 1)))
        limits = V.Limits(least=rng.choice([50, 300]), always=rng.choice([400, 2000]))
        assert V.choose(cores, volumes, hub, limits) == naive_cover(cores, volumes, hub, limits)
    rows = [("p", 1, ["books"], 900, False), ("p", 2, ["books", "kids"], 500, False), ("p", 3, [], 9000, True), ("p", 4, ["odd"], 1, False)]
    df = spark.createDataFrame(rows, "pillar string, id long, words array<string>, volume long, hub boolean")
    got = {r["id"]: (r["node"], r["kept"]) for r in V.greedy_cover(df, "pillar", hub="hub").collect()}
    assert got == {1: ("books", True), 2: ("books", True), 4: ("", False)}
    assert V.greedy_cover(df, "pillar", V.Limits(small=12), hub="hub").filter("not kept").count() == 0


def test_adopted(spark):
    clusters = spark.createDataFrame([(1, "us", ["name", "turkey"]), (2, "us", ["kids"]), (3, "us", ["pie", "recipe", "apple"])], "id long, market string, core array<string>")
    candidates = spark.createDataFrame([(10, "us", "names", 5, ["name"]), (11, "us", "food", 9, ["turkey", "name", "x"]), (12, "us", "kids", 9, ["kids"]), (13, "us", "pies", 1, ["pie", "recipe"])], "id long, market string, pillar string, volume long, core array<string>")
    assert {r["id"]: r["pillar"] for r in V.adopted(clusters, candidates).collect()} == {1: "names", 3: "pies"}


def test_unique_slugs_respect_natural_numbers(spark):
    rows = [(1, "a"), (2, "a"), (3, "a-2"), (4, "a"), (5, "a-2"), (6, "b"), (7, "a-4")]
    df = spark.createDataFrame(rows, "n long, s string")
    got = {r["n"]: r["slug"] for r in L.unique_slugs(df, "s", [F.asc("n")]).collect()}
    assert got == {1: "a", 2: "a-3", 3: "a-2", 4: "a-5", 5: "a-2-2", 6: "b", 7: "a-4"} and len(set(got.values())) == 7


def test_noise_is_judged_as_typed_and_as_respelled(spark):
    df = spark.createDataFrame([("login page", "login page", "login page", False), ("logn page", "logn page", "login page", False), ("celebracion", "celebracion", "celebration", True), ("good", "good", "good", False)], "raw string, norm string, fixed string, foreign boolean")
    reason = Sc.noise_reason(F.col("raw"), F.col("norm"), F.col("fixed"), [("account", "login")], F.col("foreign"))
    assert [r[0] for r in df.select(reason).collect()] == ["account", "account", "language", None]


def test_decisions_at_ingest(spark):
    rows = spark.createDataFrame([("us", "dad gifts"), ("uk", "dad gifts"), ("us", "mom mugs"), ("us", "odd one")], "market string, keyword string")
    d = [("d1", "drop_keyword", "us", "Dad Gifts"), ("d2", "keep_keyword", "", "dad gifts"), ("d10", "keep_keyword", "", "mom mugs"), ("d3", "drop_keyword", "", "mom mugs"), ("d4", "keep_keyword", "", "nowhere"), ("d5", "keep_keyword", "", "odd-one"), ("d6", "merge", "", "odd one")]
    named, log = Sc.decided_at_ingest(rows, spark.createDataFrame(d, "decision_id string, action string, market string, keyword string"))
    assert {r["decision_id"]: r["status"] for r in log.collect()} == {"d1": "found", "d2": "invalid", "d10": "conflict", "d3": "conflict", "d4": "stale", "d5": "found"}
    assert {(r["market"], r["keyword"]): r["decision_id"] for r in named.collect()} == {("us", "dad gifts"): "d1", ("uk", "dad gifts"): None, ("us", "mom mugs"): None, ("us", "odd one"): "d5"}
    full = named.withColumn("norm", F.col("keyword")).withColumn("volume", F.lit(5)).withColumn("vclass", F.lit(2)).withColumn("kd", F.lit(90.0)).withColumn("need", F.lit("info")).withColumn("prior", F.lit(False))
    out = Sc.scoped(full, Sc.Scope(max_kd=50.0))
    assert {(r["market"], r["keyword"]): (r["reason"], r["lifted"]) for r in out.collect()} == {("us", "dad gifts"): ("decision:d1", None), ("uk", "dad gifts"): ("filter:max_kd", None), ("us", "mom mugs"): ("filter:max_kd", None), ("us", "odd one"): (None, "filter:max_kd")}
    final = {r["decision_id"]: (r["status"], r["detail"]) for r in Sc.kept_log(out, log).collect()}
    assert final["d1"] == ("applied", "") and final["d5"] == ("applied", "kept despite filter:max_kd") and final["d4"] == ("stale", "") and final["d3"][0] == "conflict"


def test_need_is_settled_by_research(spark):
    df = spark.createDataFrame([("shop", "info", True), ("shop", "shop", True), ("shop", "info", False), ("info", "shop", True)], "need string, again string, research boolean")
    need, conflict = Sc.settled_need(F.col("need"), F.col("again"), F.col("research"))
    assert [tuple(r) for r in df.select(need, conflict).collect()] == [("info", True), ("shop", False), ("shop", False), ("info", False)]


def test_audit_with_results_and_free_keywords(spark):
    rows = [
        ("us", "g1", "trio costumes", True, 100, 10.0, "choose", "", ["costume", "trio"]), ("us", "g2", "easy trio costumes", True, 50, 10.0, "choose", "", ["costume", "easy", "trio"]), ("us", "g3", "trio costumes for kids", True, 40, 10.0, "choose", "", ["costume", "kid", "trio"]),
        ("us", "g4", "pumpkin ideas 2024", True, 90, 10.0, "choose", "", ["2024", "idea", "pumpkin"]), ("us", "g4", "pumpkin ideas", False, 30, 10.0, "choose", "", ["idea", "pumpkin"]), ("us", "", "loose", False, 9, 1.0, "info", "", ["loose"]),
    ]
    m = spark.createDataFrame(rows, MEMBERS)
    urls = [("us", "trio costumes", u) for u in "abcdef"] + [("us", "easy trio costumes", u) for u in "abcdex"] + [("us", "trio costumes for kids", u) for u in "qrstuv"]
    results = spark.createDataFrame([(a, b, f"http://{u}.com/") for a, b, u in urls], "market string, keyword string, url string")
    free = spark.createDataFrame([("us", "costumes trio", 5, "choose", ["trio", "costume"]), ("us", "new topic", 7, "info", ["new", "topic"]), ("us", "buy it", 7, "shop", ["buy"])], "market string, keyword string, volume long, need string, words array<string>")
    got = {(r["finding"], r["keyword"], r["other"]) for r in R.audit_grouping(m, results=results, free=free, noise="^pumpkin ideas$").collect()}
    assert got == {
        ("same_query", "easy trio costumes", "trio costumes"), ("serp_apart", "trio costumes for kids", "trio costumes"), ("segment_modifier", "trio costumes for kids", "trio costumes"),
        ("main_changed", "pumpkin ideas 2024", "pumpkin ideas"), ("noise_flag", "pumpkin ideas", ""), ("same_question", "costumes trio", "trio costumes"), ("export_topic", "new topic", ""),
    }


def test_keep_apart_changes_the_grouping(spark):
    rows = [("us", "g1", "dad gifts", True, 100, 1.0, "choose", "", ["dad", "gift"]), ("us", "g1", "dad mugs", False, 30, 1.0, "choose", "", ["dad", "mug"]), ("us", "g2", "mom mugs", True, 80, 1.0, "choose", "", ["mom", "mug"])]
    d = [("d1", "keep_apart", "us", "dad gifts", "dad mugs", "", "r", "e", "", "ann"), ("d2", "keep_apart", "us", "mom mugs", "dad mugs", "", "r", "e", "", "ann"), ("d3", "merge", "us", "dad gifts", "dad gifts", "", "r", "e", "", "ann")]
    schema = "decision_id string, action string, market string, keyword string, target string, value string, reason string, evidence string, source_issue string, author string"
    after, log = R.apply_decisions(spark.createDataFrame(rows, MEMBERS), spark.createDataFrame(d, schema))
    assert {r["decision_id"]: r["status"] for r in log.collect()} == {"d1": "applied", "d2": "already_true", "d3": "already_true"}
    assert {r["keyword"]: (r["group"], r["is_main"]) for r in after.collect()} == {"dad gifts": ("g1", True), "dad mugs": ("g1/dad mugs", True), "mom mugs": ("g2", True)}


def test_cells_are_filled_replaced_and_cleared(spark):
    cells = spark.createDataFrame([("us", "a", "title", ""), ("us", "b", "title", "ours"), ("us", "c", "title", "old"), ("us", "d", "title", "was"), ("us", "e", "title", ""), ("uk", "e", "title", "")], "market string, keyword string, cell string, value string")
    d = [("d1", "a", "new"), ("d2", "b", "new"), ("d3", "c", "new"), ("d5", "e", "x"), ("d6", "nowhere", "x")]
    decisions = spark.createDataFrame([(i, "set_title", "", k, v, "r", "e", "ann") for i, k, v in d] + [("d7", "set_title", "us", "a", "y", "r", "e", "proposal")], "decision_id string, action string, market string, keyword string, value string, reason string, evidence string, author string")
    previous = spark.createDataFrame([("d3", "us", "c", "title", "old"), ("d4", "us", "d", "title", "was")], "decision_id string, market string, keyword string, cell string, value string")
    out, log = R.fill_cells(cells, decisions, previous)
    assert {(r["market"], r["keyword"]): r["value"] for r in out.collect()} == {("us", "a"): "new", ("us", "b"): "ours", ("us", "c"): "new", ("us", "d"): "", ("us", "e"): "", ("uk", "e"): ""}
    assert {r["decision_id"]: r["status"] for r in log.collect()} == {"d1": "applied", "d2": "team_value_kept", "d3": "applied", "d4": "withdrawn", "d5": "invalid", "d6": "stale", "d7": "invalid"}


def test_outline_and_checked_pairs(spark):
    posts = spark.createDataFrame([("p", "thanksgiving facts", "thanksgiving facts", 90, False), ("p", "thanksgiving facts for kids", "thanksgiving facts", 50, False), ("p", "when is thanksgiving", "thanksgiving facts", 70, False), ("p", "facts thanksgiving", "thanksgiving facts", 60, False), ("p", "thanksgivng pie", "thanksgiving facts", 99, True)], "post string, keyword string, main string, volume long, fixed boolean")
    got = [(r["keyword"], r["place"]) for r in R.outline_seeds(posts, ("for",)).orderBy("place").collect()]
    assert got == [("when is thanksgiving", 1), ("thanksgiving facts for kids", 2)]
    pairs = spark.createDataFrame([("us", "a", "b", 5), ("us", "a", "c", 5), ("us", "b", "c", 1), ("us", "a", "z", 9)], "market string, a string, b string, shared long")
    placed = spark.createDataFrame([("us", "a", 1), ("us", "b", 1), ("us", "c", 2)], "market string, keyword string, stt long")
    assert {(r["a"], r["b"]): r["follows"] for r in R.checked_pairs(pairs, placed).collect()} == {("a", "b"): "yes", ("a", "c"): "no: apart", ("b", "c"): "yes", ("a", "z"): "not in plan"}


def test_easier_seed(spark):
    rows = [("c", 1, "dad gifts", 100, 10.0, 0.1, 0.0, True, ["gift"], True), ("c", 2, "gifts for dad", 90, 90.0, 1.0, 0.0, True, ["gift"], False), ("c", 3, "dad mugs", 90, 95.0, 1.0, 0.0, True, ["mug"], False), ("d", 4, "x", 5, 5.0, 1.0, 0.0, True, [], True)]
    df = spark.createDataFrame(rows, "cluster string, id long, keyword string, volume long, winnable double, fit double, fluency double, plain boolean, core array<string>, is_seed boolean")
    assert [tuple(r) for r in Pr.easier_seed(df, "cluster").collect()] == [("c", "gifts for dad")]


def test_months_in_headers(spark):
    df = spark.createDataFrame([("Searches: May 2025",), ("searches:  sept 2024",), ("Volume",), (None,)], "h string")
    assert [r[0] for r in df.select(E.monthly_header(F.col("h"))).collect()] == ["2025-05", "2024-09", None, None]


def test_headers_of_every_tool():
    from keyloom.sources import tabular

    headers = {
        "team plan": ["STT", "Main Keyword", "Category Kind"], "strategy builder": ["Topic", "Page", "Keyword"], "site explorer": ["Keyword", "Current URL", "Informational"], "positions": ["Keyword", "Position", "URL"], "api": ["database", "Keyword"],
        "explorer": ["Keyword", "Country", "Parent Keyword"], "planner": ["Keyword", "Avg. monthly searches"], "search console": ["Top queries", "Clicks"], "research": ["Keyword", "Volume", "Competitive Density"], "unknown": ["Keyword", "Volume"],
    }
    assert {tabular.tool_of(h): h for h in headers.values()} == headers
    assert tabular.tool_of(["Keyword"], "gifts_broad-match_us_2026-05-01.csv") == "research"
    names = {"gifts_broad-match_us_2026-05-01.csv": ("us", "2026-05-01"), "site.com-organic.Positions-uk-20260628.csv": ("uk", "2026-06-28"), "google_gb_gifts_x_2026-01-02.csv": ("uk", "2026-01-02"), "gifts_clusters_2026-05-01.xlsx": ("", "2026-05-01"), "plain.csv": ("", "")}
    assert {n: tabular.market_and_date(n) for n in names} == names
    found = tabular.column_map(["STT", "Từ khóa chính", "Từ khóa phụ", "Keyword", "Danh mục", "Trạng thái", "Traffic potential"])
    assert {k: found[k] for k in ("stt", "main", "secondary", "keyword", "category", "status")} == {"stt": "STT", "main": "Từ khóa chính", "secondary": "Từ khóa phụ", "keyword": "Keyword", "category": "Danh mục", "status": "Trạng thái"}


def test_intents_with_flags_and_features(spark):
    df = spark.createDataFrame([("Commercial, non branded", "false", "true"), ("", None, "true"), ("1,0", "true", None), (None, None, None)], "c string, b string, i string")
    got = [tuple(r[0]) for r in df.select(E.intents(F.col("c"), {"branded": F.col("b"), "informational": F.col("i")})).collect()]
    assert got == [(["commercial", "informational"], False, None), (["informational"], None, None), (["commercial", "informational"], True, None), ([], None, None)]
    cells = spark.createDataFrame([("People also ask, Site Links|organic",), ("people_also_ask;Odd thing",), (None,)], "c string")
    assert [r[0] for r in cells.select(E.result_features(F.col("c"))).collect()] == [["paa", "sitelinks"], ["other:odd thing", "paa"], []]


def test_topic_decisions(spark):
    from keyloom.operators import topics as To

    plan = [
        (1, "us", "dad gifts", "hub", "P01", None, 100), (2, "us", "dad mugs", "post", "P01", None, 50), (3, "us", "dad cards", "merged", "P01", 2, 10), (4, "us", "mom gifts", "hub", "P02", None, 90), (5, "us", "mom mugs", "post", "P02", None, 40),
        (6, "us", "odd topic", "backlog", None, None, 5), (7, "us", "buy now", "skip", None, None, 5), (8, "uk", "dad gifts", "standalone", None, None, 7), (9, "us", "lone", "standalone", None, None, 3), (10, "us", "late", "merged", "P02", 5, 2), (11, "us", "more mugs", "post", "P01", None, 20),
    ]
    df = spark.createDataFrame([(*p, "x") for p in plan], "id long, market string, keyword string, kind string, pillar string, merged_into long, volume long, note string")
    d = [
        ("d01", "drop_post", "us", "dad mugs", ""), ("d02", "promote_pillar", "us", "mom mugs", ""), ("d03", "restore_backlog", "us", "odd topic", ""), ("d04", "set_pillar", "us", "lone", "dad gifts"), ("d05", "drop_post", "us", "buy now", ""), ("d06", "promote_pillar", "", "dad gifts", ""),
        ("d07", "demote_pillar", "us", "nowhere", ""), ("d08", "set_pillar", "us", "late", "dad gifts"), ("d09", "set_pillar", "us", "late", "mom gifts"), ("d10", "set_pillar", "us", "more mugs", "none"), ("d11", "promote_pillar", "uk", "dad gifts", ""),
    ]
    decisions = spark.createDataFrame([(i, a, m, k, t, "r", "e", "ann") for i, a, m, k, t in d], "decision_id string, action string, market string, keyword string, target string, reason string, evidence string, author string")
    out, log = To.apply_topics(df, decisions)
    assert {r["decision_id"]: r["status"] for r in log.collect()} == {"d01": "applied", "d02": "applied", "d03": "applied", "d04": "applied", "d05": "already_true", "d06": "invalid", "d07": "stale", "d08": "conflict", "d09": "conflict", "d10": "applied", "d11": "applied"}
    got = {r["id"]: (r["kind"], r["pillar"], r["merged_into"]) for r in out.collect()}
    assert got == {
        1: ("hub", "P01", None), 2: ("skip", None, None), 3: ("merged", "P01", 1), 4: ("post", "P02", None), 5: ("hub", "P02", None), 6: ("standalone", None, None), 7: ("skip", None, None), 8: ("hub", "P03", None),
        9: ("post", "P01", None), 10: ("merged", "P02", 5), 11: ("standalone", None, None),
    }
    assert out.columns == df.columns
    assert {r["pillar"]: r["number"] for r in To.pillar_numbers(out).collect()} == {"P01": "P02", "P02": "P01", "P03": "P03"}


def test_cross_backlink_and_contextual_links(spark):
    schema = "market string, slug string, pillar string, topic string, is_pillar boolean, key string, interest string, recipient string, occasion string, volume long, value long, parent string, fit string"
    rows = [
        ("us", "dogs", "P1", "dogs", True, "dogs", "dogs", "", "", 100, 100, None, "hard"), ("us", "mom", "P2", "mom", True, "mom", "", "mom", "", 90, 90, None, "easy"), ("us", "dog-mom", "P3", "xmas", False, None, "dogs", "mom", "xmas", 50, 50, None, "easy"),
        ("us", "dog-toys", "P1", "dogs", False, None, "dogs", "", "", 40, 40, None, "hard"), ("us", "dog-beds", "P1", "dogs", False, None, "dogs", "", "", 30, 30, "dog-toys", "stretch"), ("us", "dog-food", "P1", "dogs", False, None, "dogs", "", "", 20, 20, None, "easy"), ("uk", "dogs-uk", "P9", "dogs", True, "dogs", "", "", "", 5, 5, None, "easy"),
    ]
    posts = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in L.cross_links(posts).collect()] == [("us", "dog-mom", "dogs", "interest")]
    assert sorted((r["target"], r["facet"]) for r in L.cross_links(posts, 2).collect()) == [("dogs", "interest"), ("mom", "recipient")]
    links = spark.createDataFrame([("dogs", "dog-beds"), ("dog-toys", "x")], "source string, target string")
    published = spark.createDataFrame([("dogs",), ("dog-toys",), ("mom",)], "slug string")
    got = {(r["source"], r["target"], r["place"]) for r in L.backlink_queue(posts, links, published).collect()}
    assert got == {("dogs", "dog-mom", 1), ("mom", "dog-mom", 2), ("dog-toys", "dog-mom", 3), ("dog-toys", "dog-beds", 1), ("dogs", "dog-food", 1), ("dog-toys", "dog-food", 2)}
    bags = spark.createDataFrame([("dog-toys", "dog", 2), ("dog-toys", "toy", 1), ("dog-beds", "dog", 2), ("dog-beds", "bed", 1), ("dog-food", "dog", 1), ("dog-food", "food", 3)], "slug string, word string, n long")
    found = {(r["source"], r["target"]) for r in L.contextual(posts, bags, links, most=1).collect()}
    assert found == {("dog-toys", "dog-beds"), ("dog-beds", "dog-food"), ("dog-food", "dog-toys")}


def test_spreadsheet_sinks(spark):
    import pytest

    from keyloom.plans import sinks
    from keyloom.sources import tabular

    df = spark.createDataFrame([("a", ["x", "y"], 1), ('b "q", é', [], None)], "k string, l array<string>, n long")
    assert sinks.spreadsheet_csv(df) == '﻿k,l,n\r\na,x|y,1\r\n"b ""q"", é",,\r\n'.encode()
    assert [n for n, _ in tabular.workbook_sheets(sinks.workbook({"One": df, "Two": df}))] == ["One", "Two"]
    for bad in ({"a/b": df}, {"x" * 32: df}, {"Same": df, "same": df}, {"Long": spark.createDataFrame([("y" * 40_000,)], "k string")}):
        with pytest.raises(ValueError):
            sinks.workbook(bad)


def test_decision_files_and_ranked_issues(spark, tmp_path):
    from keyloom.sources import decisions

    (tmp_path / "d.csv").write_bytes('﻿Decision ID;Action;Keyword;Reason\r\nd1;MERGE;dad gifts;"same; words"\r\n;split;mom mugs;\r\n;;;\r\n'.encode())
    got = [r.asDict() for r in decisions.read_decisions(spark, str(tmp_path / "d.csv")).orderBy("action").collect()]
    assert [(r["action"], r["keyword"], r["reason"], r["target"]) for r in got] == [("merge", "dad gifts", "same; words", ""), ("split", "mom mugs", "", "")]
    assert got[0]["decision_id"] == "d1" and got[1]["decision_id"].startswith("D-") and list(got[0]) == list(decisions.COLUMNS)
    rows = [("a", "low", 9, "i1"), ("b", "high", 1, "i2"), ("c", "high", 5, "i3"), ("c", "high", 5, "i3"), ("d", "medium", None, "i4")]
    issues = spark.createDataFrame([(c, s, v, i, "us", "k", "", "merge") for c, s, v, i in rows], "check string, severity string, volume long, issue_id string, market string, keyword string, other string, action string")
    assert [(r["place"], r["issue_id"]) for r in R.ranked_issues(issues, 3).orderBy("place").collect()] == [(1, "i3"), (2, "i2"), (3, "i4")]
    kw = spark.createDataFrame([("us", "mugs", 5, "shop, but questions in results"), ("us", "x", 1, None)], "market string, keyword string, volume long, need_conflict string")
    assert [(r["check"], r["keyword"], r["other"]) for r in R.need_conflicts(kw).collect()] == [("need_conflict", "mugs", "shop, but questions in results")]
    near = R.closest_names(spark.createDataFrame([("dad gift ideas",), ("zzz",)], "keyword string"), spark.createDataFrame([("gift ideas",), ("dad mugs",)], "keyword string"))
    assert [tuple(r) for r in near.collect()] == [("dad gift ideas", "gift ideas")]
