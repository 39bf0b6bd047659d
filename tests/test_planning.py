"""Sources, planning, review and the whole pipeline on small cases of our own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keyloom.operators import planning as P
from keyloom.operators import review as R
from keyloom.operators import scope as Sc
from keyloom.plans import pipeline, sinks
from keyloom.sources import grouped, tabular


def test_reads_text_with_preamble_and_utf16(spark, tmp_path):
    body = 'Keyword report\r\n2026-01-01\r\nKeyword\tAvg. monthly searches\tCompetition\r\n"dad, gifts"\t1,200\tlow\r\nmugs\t10 – 100\thigh\r\n\t\t\r\n'
    path = tmp_path / "planner_us_2026-03-04.csv"
    path.write_bytes(body.encode("utf-16"))
    found = tabular.layout(spark, str(path))
    assert (found.header_row, found.delimiter, found.tool, found.market, found.date, found.encoding) == (2, "\t", "planner", "us", "2026-03-04", "UTF-16")
    rows = tabular.typed(tabular.read_text(spark, str(path))).orderBy("keyword").collect()
    assert [(r["keyword"], r["volume"], r["vol_est"], r["market"], r["vclass"]) for r in rows] == [("dad, gifts", 1200, False, "us", 3), ("mugs", 10, True, "us", 2)]


def test_decoding():
    assert tabular.decode("é".encode("cp1252"))[1] == "windows-1252"
    assert tabular.decode(b"\xef\xbb\xbfab")[0] == "ab"
    with pytest.raises(ValueError, match="no header"):
        tabular.find_header(["a,b", "c,d"])


def test_workbook_round_trip(spark, tmp_path):
    data = tabular.write_workbook({"One": [["Keyword", "Volume"], ["a & b", 10], ["", ""], ["c", True]], "Other": [["x"]]})
    path = tmp_path / "w.xlsx"
    path.write_bytes(data)
    assert dict(tabular.workbook_sheets(data))["One"][1] == ["a & b", "10"]
    rows = tabular.read_workbooks(spark, str(path)).orderBy("row").collect()
    assert [(r["_sheet"], r["record"]["keyword"], r["record"]["volume"]) for r in rows] == [("One", "a & b", "10"), ("One", "c", "TRUE")]


def test_grouped_layouts(spark):
    block = spark.createDataFrame([("s", 1, "main a", "", "10", "1", "p"), ("s", 2, "", "sec a", "5", "2", ""), ("s", 3, "main b", "sec b", "7", "3", "")], "_src string, row long, main_keyword string, secondary_keyword string, volume string, kd string, pillar string")
    got = {(r["group_no"], r["keyword"], r["role"], r["pillar"]) for r in grouped.read_grouped(block).collect()}
    assert got == {(1, "main a", "main", "p"), (1, "sec a", "secondary", "p"), (2, "main b", "main", "p"), (2, "sec b", "secondary", "p")}
    wide = spark.createDataFrame([("s", 1, "m", "a; b", "3", "1")], "_src string, row long, main_keyword string, secondary_keywords string, volume string, kd string")
    assert {r["keyword"] for r in grouped.read_grouped(wide).collect()} == {"m", "a", "b"}
    long = spark.createDataFrame([("s", 1, "x1", "g1", "5"), ("s", 2, "x2", "", "9"), ("s", 3, "y", "g2", "1")], "_src string, row long, keyword string, group string, volume string")
    assert {(r["main"], r["keyword"]) for r in grouped.read_grouped(long).collect()} == {("x2", "x1"), ("x2", "x2"), ("y", "y")}
    pairs = spark.createDataFrame([("s", i, f"alpha {i}", str(i), f"beta {i}", str(i)) for i in range(5)], "_src string, row long, Alpha string, V1 string, Beta string, V2 string")
    assert {r["main"] for r in grouped.read_grouped(pairs).collect()} == {"alpha 4", "beta 4"}


MEMBERS = "market string, group string, keyword string, is_main boolean, volume long, kd double, need string, parent string, words array<string>"


def members(spark):
    rows = [
        ("us", "g1", "dad gifts", True, 100, 1.0, "choose", "", ["dad", "gift"]), ("us", "g1", "gifts dad", False, 300, 1.0, "choose", "", ["dad", "gift"]), ("us", "g1", "buy mugs", False, 50, 1.0, "shop", "mom mugs", ["buy", "mug"]),
        ("us", "g2", "mom mugs", True, 80, 1.0, "shop", "", ["mom", "mug"]), ("us", "g2", "gifts dad", False, 300, 1.0, "choose", "", ["dad", "gift"]), ("us", "g3", "gift dad", True, 10, 1.0, "choose", "", ["dad", "gift"]),
        ("us", "", "big one", False, 900, 1.0, "info", "", ["big", "one"]), ("us", "g4", "zero", True, 0, None, "info", "", ["zero"]),
    ]
    return spark.createDataFrame(rows, MEMBERS)


def test_back_check(spark):
    issues = R.back_check(members(spark))
    got = {(r["check"], r["keyword"]) for r in issues.collect()}
    assert {("duplicate_across_groups", "gifts dad"), ("secondary_is_other_main", "buy mugs"), ("main_not_best", "dad gifts"), ("shopping_main", "mom mugs"), ("same_question_groups", "gift dad"), ("ungrouped_high_volume", "big one"), ("no_data", "zero")} <= got
    again = {r["issue_id"] for r in R.back_check(members(spark).orderBy(F.desc("keyword"))).collect()}
    assert again == {r["issue_id"] for r in issues.collect()}
    assert {r["author"] for r in R.proposals(issues).collect()} == {"proposal"}


def test_audit(spark):
    got = {(r["finding"], r["keyword"]) for r in R.audit_grouping(members(spark)).collect()}
    assert ("same_query", "gift dad") in got and ("main_changed", "dad gifts") in got and ("shop_member", "buy mugs") in got


def test_decisions(spark):
    d = [
        ("d1", "merge", "us", "gift dad", "dad gifts", "", "same", "words", "", "ann"), ("d2", "move_keyword", "us", "buy mugs", "mom mugs", "", "shop", "need", "", "ann"), ("d3", "set_need", "us", "nothing", "", "info", "r", "e", "", "ann"),
        ("d4", "rename_main", "us", "gifts dad", "", "", "", "e", "", "ann"), ("d10", "merge", "us", "gift dad", "mom mugs", "", "x", "y", "", "ann"),
    ]
    decisions = spark.createDataFrame(d, "decision_id string, action string, market string, keyword string, target string, value string, reason string, evidence string, source_issue string, author string")
    after, log = R.apply_decisions(members(spark), decisions)
    status = {r["decision_id"]: r["status"] for r in log.collect()}
    assert status == {"d1": "applied", "d2": "applied", "d3": "stale", "d4": "invalid", "d10": "conflict"}
    groups = {r["keyword"]: r["group"] for r in after.filter("keyword in ('gift dad', 'buy mugs')").collect()}
    assert groups == {"gift dad": "g1", "buy mugs": "g2"}


def test_targets_are_followed(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "d")], "n string, t string")
    assert {r["n"]: r["t"] for r in R.follow_targets(df, "n", "t").collect()} == dict.fromkeys("abcd", "d")


def test_planning(spark):
    kw = spark.createDataFrame([("p", "dad gifts", 100, "dad gifts", False, ["dad", "gift"]), ("p", "gifts for dad", 90, "dad gifts", False, ["gift", "dad"]), ("p", "dad mugs", 50, "dad gifts", False, ["dad", "mug"])], "post string, keyword string, volume long, main string, typo boolean, words array<string>")
    assert {r["keyword"]: r["role"] for r in P.secondary_keywords(kw).collect()} == {"dad gifts": "main", "gifts for dad": "also covers", "dad mugs": "secondary"}
    posts = spark.createDataFrame([("us", "hub", "p", "pillar", 1.0), ("us", "a", "p", "cluster", 9.0), ("us", "b", "q", "standalone", 5.0)], "market string, slug string, pillar_id string, role string, priority double")
    assert {r["slug"] for r in P.limit_posts(posts, 2).filter("kept").collect()} == {"a", "hub"}
    pub = spark.createDataFrame([("u1", ["dad", "gift"]), ("u2", ["dad", "gift", "big"])], "url string, words array<string>")
    mine = spark.createDataFrame([("s1", ["dad", "gift"])], "slug string, words array<string>")
    assert {(r["url"], r["kind"]) for r in P.published_matches(mine, pub).collect()} == {("u1", "same"), ("u2", "part")}
    checks = spark.createDataFrame([("us", "a", "b", 5, 9), ("us", "a", "c", 4, 4), ("us", "x", "y", 3, 3)], "market string, a string, b string, va long, vb long")
    assert {(r["a"], r["b"]) for r in P.budgeted_checks(checks, 3).collect()} == {("a", "b"), ("a", "c")}


def test_pipeline_end_to_end(spark):
    phrases = ["christmas gifts for mom", "gifts for mom christmas", "christmas gift mom", "christmas gifts for dad", "christmas ideas", "christmas quotes", "easter gifts for teacher", "how to wrap christmas gifts", "gifts near me", "best mugs", "buy mugs", ""]
    rows = [(p, "us", 100 - i, 3, float(10 * (i % 5)), None, "", "f", "t") for i, p in enumerate(phrases)]
    df = spark.createDataFrame(rows, "keyword string, market string, volume long, vclass int, kd double, position double, url string, src string, tool string")
    out = pipeline.run(df, pipeline.Config(least_pillar=2))
    n_kept = sum(1 + len(r["variants"]) for r in out["keywords"].collect())
    assert n_kept + out["excluded"].count() == len(phrases)
    decisions = spark.createDataFrame([("d1", "keep_keyword", "us", "gifts near me"), ("d2", "drop_keyword", "", "best mugs")], "decision_id string, action string, market string, keyword string")
    again = pipeline.run(df, pipeline.Config(least_pillar=2, scope=Sc.Scope(max_kd=35.0, exclude=("^buy",), known_class=1)), decisions=decisions)
    reasons = {r["keyword"]: r["reason"] for r in again["excluded"].collect()}
    assert reasons["best mugs"] == "decision:d2" and reasons["buy mugs"] == "filter:exclude:^buy" and reasons["christmas ideas"] == "filter:max_kd" and "gifts near me" not in reasons
    assert {r["decision_id"]: r["status"] for r in again["decisions"].collect()} == {"d1": "applied", "d2": "applied"}
    plan = out["plan"].collect()
    assert len({r["slug"] for r in plan}) == len(plan) and sorted(r["stt"] for r in plan) == list(range(1, len(plan) + 1))
    slugs = {r["slug"] for r in plan}
    assert all(r["source"] in slugs and r["target"] in slugs for r in out["links"].collect())
    assert sinks.markdown(out["gaps"], "Gaps").startswith("# Gaps")


def test_streaming_ingest(spark, tmp_path):
    import datetime

    from keyloom.streaming import ingest

    rows = [("Mugs", "us", "a", 5, datetime.datetime(2026, 1, 1)), ("mugs", "us", "a", 5, datetime.datetime(2026, 1, 1, 0, 5)), ("hats", "us", "a", 3, datetime.datetime(2026, 1, 1))]
    schema = "keyword string, market string, src string, volume long, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = ingest.into(ingest.distinct_rows(stream), str(tmp_path / "out"), str(tmp_path / "ck"), lambda b: b)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_review_sheets(spark):
    posts = spark.createDataFrame([("us", "s1", ["dad", "gift"], None), ("us", "s2", ["mom"], "s1")], "market string, slug string, words array<string>, merged_into string")
    kw = spark.createDataFrame([("s1", "us", "dad gifts", 10), ("s1", "us", "gift dad", 30)], "slug string, market string, keyword string, volume long")
    issues = spark.createDataFrame([("BC-1", "weak_member", "us", "dad gifts", "x", "merge"), ("BC-2", "no_data", "us", "zz", "", "")], "issue_id string, check string, market string, keyword string, other string, action string")
    r = {x["slug"]: x for x in P.review_rows(posts, kw, issues).collect()}
    assert (r["s1"]["owned_volume"], r["s1"]["biggest_keyword"], r["s1"]["issues"], r["s2"]["issues"]) == (40, "gift dad", "BC-1 weak_member", "")
    d = spark.createDataFrame([("d1", "merge", "us", "dad gifts", "y", "", "applied")], "decision_id string, action string, market string, keyword string, target string, source_issue string, status string")
    assert {x["issue_id"]: x["state"] for x in P.issue_status(issues, d).collect()} == {"BC-1": "applied", "BC-2": "open"}
    clusters = spark.createDataFrame([("us", "dad mug", 9, "backlog", ["dad", "mug"]), ("us", "in", 5, "cluster", ["in"])], "market string, name string, volume long, role string, words array<string>")
    scope = spark.createDataFrame([("url", 3), ("url", 4), ("local", 1)], "reason string, volume long")
    got = [(x["name"], x["reason"], x["nearest"]) for x in P.left_out(clusters, scope, posts).collect()]
    assert got == [("dad mug", "backlog", "s1"), ("3 keywords out of scope", "url, local", None)]
    hubs = spark.createDataFrame([("us", "p", "a", 10.0, True), ("us", "p", "b", 20.0, False), ("us", "q", "c", 10.0, True), ("us", "q", "d", 12.0, False)], "market string, pillar string, name string, winnable double, is_given_hub boolean")
    assert {x["name"] for x in P.given_pillars(hubs).filter("is_hub").collect()} == {"b", "c"}
    apart = spark.createDataFrame([("s1", "s2")], "a string, b string")
    assert {x["slug"]: x["merged_into"] for x in P.keep_groups_apart(posts, apart).collect()} == {"s1": None, "s2": None}
    texts = spark.createDataFrame([("how_to", "# T\n## One \nx\n## Two")], "post_type string, text string")
    assert [x["section"] for x in P.template_sections(texts).orderBy("position").collect()] == ["One", "Two"]
    t = spark.createDataFrame([("personalized mugs", "gift_guide", "uk")], "k string, t string, m string")
    assert t.select(P.post_titles(F.col("k"), F.col("t"), F.col("m"))).first()[0] == "Personalised Mugs They Will Love"
