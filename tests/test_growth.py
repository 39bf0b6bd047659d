"""Joins whose rows must grow with the input and not with its pairs, held against brute force."""

from __future__ import annotations

import random

from keyloom.operators import cover as V
from keyloom.operators import links as L
from keyloom.operators import similarity as S


def most_joined(df) -> int:
    """The rows of the largest join that a collected DataFrame made."""
    found = [0]

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            walk(node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan())
        if "Join" in kind and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return max(found)


def test_backlink_queue_by_lists_of_facet_sets(spark):
    rnd = random.Random(3)
    facets = ("interest", "recipient", "occasion")
    rows = [
        (rnd.choice(["us", "uk"]), f"s{i}", rnd.random() < 0.1, rnd.choice([None, *range(6)]), *(rnd.choice(["a", "b", "", None]) for _ in facets)) for i in range(900)
    ]
    live = [f"s{i}" for i in range(0, 900, 4)]
    edges = [(f"s{i - 1}", f"s{i}") for i in range(1, 900)] + [(f"s{rnd.randrange(900)}", f"s{rnd.randrange(900)}") for _ in range(900)]
    posts = spark.createDataFrame(rows, "market string, slug string, is_pillar boolean, volume long, interest string, recipient string, occasion string")
    df = L.backlink_queue(posts, spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([(s,) for s in live], "slug string"))
    got = {(r["market"], r["source"], r["target"], r["place"]) for r in df.collect()}
    want, there = set(), set(edges)
    for t in (r for r in rows if r[1] not in live):
        shared = [(sum(bool(x) and x == y for x, y in zip(s[4:], t[4:])), s) for s in rows if s[1] in live and s[0] == t[0] and (s[1], t[1]) not in there]
        ranked = sorted((x for x in shared if x[0]), key=lambda x: (-x[0], not x[1][2], x[1][3] is None, -(x[1][3] or 0), x[1][1]))
        had = sum(b == t[1] and a in live for a, b in there)
        want |= {(t[0], s[1], t[1], k) for k, (_, s) in enumerate(ranked, 1) if k + had <= 3}
    assert got == want
    assert most_joined(df) < 10 * len(rows)


def test_merge_targets_by_word_sets(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("pq"), [rnd.choice("abcdef") for _ in range(rnd.randint(0, 3))], rnd.choice([None, *range(5)]), i % 5 == 0, i in (0, 5)) for i in range(900)]
    df = V.merge_targets(spark.createDataFrame(rows, "id long, pillar string, core array<string>, volume long, kept boolean, hub boolean"))
    got = {(r["id"], r["target"], r["how"]) for r in df.collect()}
    want = set()
    for i, pillar, core, *_ in (r for r in rows if not r[4]):
        near = [(set(k[2]) <= set(core), len(set(k[2]) & set(core)), k[3] is not None, k[3] or 0, -k[0]) for k in rows if k[4] and k[1] == pillar and set(k[2]) & set(core)]
        hub = min((k[0] for k in rows if k[5] and k[1] == pillar), default=None)
        best = max(near, default=None)
        want.add((i, -best[4], "contained" if best[0] else "overlap") if best else (i, hub, "none" if hub is None else "hub"))
    assert got == want
    assert most_joined(df) < 20 * len(rows)


def test_cosine_top_by_blocks_of_classes(spark, monkeypatch):
    rnd = random.Random(5)
    bags = {i: {w: rnd.randint(1, 3) for w in rnd.sample(["x", "y", "z", *(f"w{n}" for n in range(30))], rnd.randint(1, 6))} for i in range(150)}
    bags |= {i: bags[i % 20] for i in range(150, 400)}
    rows = [(i, w, n, i % 2) for i, bag in bags.items() for w, n in bag.items()]
    monkeypatch.setattr(S, "BLOCK", 40, raising=False)
    monkeypatch.setattr(S, "SLICE", 16, raising=False)
    df = S.cosine_top(spark.createDataFrame(rows, "id long, word string, n long, g int"), "id", "word", "n", ["g"], 0.2, 3)
    got = {tuple(r) for r in df.collect()}
    norm = {i: sum(n * n for n in bag.values()) ** 0.5 for i, bag in bags.items()}
    want = set()
    for a in bags:
        scored = [(round(sum(n * bags[b].get(w, 0) for w, n in bags[a].items()) / (norm[a] * norm[b]), 9), b) for b in bags if b != a and b % 2 == a % 2]
        want |= {(a, b, c, k) for k, (c, b) in enumerate(sorted((x for x in scored if x[0] >= 0.2), key=lambda x: (-x[0], x[1]))[:3], 1)}
    assert got == want
    assert most_joined(df) < 10 * len(bags)
