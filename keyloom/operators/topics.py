"""Decisions on the topics of a plan: pillars made and unmade, posts moved, restored and dropped.

Decisions are a few dozen rows that people write; they are read on the driver
behind a checked bound, with the rows they name and, of the pillars touched, the
hub and the greatest other post.  They settle in a fixed order on that small
picture; what comes of it goes back to the plan as two small tables of changes,
one by cluster and one for what was merged into clusters that left.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .review import plain_key

#: Actions in the order of application.
ACTIONS = ("promote_pillar", "demote_pillar", "set_pillar", "restore_backlog", "drop_post")
LOG = "decision_id string, action string, market string, keyword string, target string, status string, detail string"


@dataclass
class _Place:
    id: int
    market: str
    keyword: str
    kind: str
    pillar: str | None
    merged_into: int | None
    volume: int


class _Picture:
    """The named clusters as they stand, each pillar's hub, and its greatest post that no decision names."""

    def __init__(self, named: list, hubs: dict[str, _Place], largest: dict[str, _Place], numbers: int) -> None:
        self.at = {p.id: p for p in named}
        for other in hubs.values():
            self.at.setdefault(other.id, other)
        self.hub = {k: self.at[p.id] for k, p in hubs.items()}
        self.largest, self.numbers = largest, numbers
        self.before = {i: (p.kind, p.pillar, p.merged_into) for i, p in self.at.items()}
        self.handed: dict[int, int | None] = {}

    def set(self, p: _Place, kind: str, pillar: str | None, merged_into: int | None = None) -> None:
        if p.kind == "hub" and self.hub.get(p.pillar) is p:
            del self.hub[p.pillar]
        p.kind, p.pillar, p.merged_into = kind, pillar, merged_into
        if kind == "hub":
            self.hub[pillar] = p

    def hand_on(self, p: _Place, pillar: str | None) -> None:
        """What was merged into ``p`` goes to its pillar's hub or greatest post, else to the backlog."""
        posts = [x for x in self.at.values() if x.kind == "post" and x.pillar == pillar and x is not p]
        posts += [self.largest[pillar]] if pillar in self.largest else []
        heir = self.hub.get(pillar) or max(posts, key=lambda x: (x.volume, -x.id), default=None)
        self.handed[p.id] = heir.id if heir is not None and heir is not p else None

    def decide(self, p: _Place, action: str, target: _Place | None, aimed: bool) -> tuple[str, str]:
        planned = p.kind in ("hub", "post", "standalone")
        if p.kind == "skip":
            return ("already_true", "already skipped") if action == "drop_post" else ("invalid", "a skipped cluster: change its need first")
        if action == "promote_pillar":
            if p.kind == "hub":
                return "already_true", "already a hub"
            if p.pillar is not None and p.kind in ("post", "merged"):
                if p.pillar in self.hub:
                    self.set(self.hub[p.pillar], "post", p.pillar)
                self.set(p, "hub", p.pillar)
            else:
                self.numbers += 1
                self.set(p, "hub", f"P{self.numbers:02d}")
            return "applied", f"hub of {p.pillar}"
        if action == "demote_pillar":
            if p.kind != "hub":
                return "already_true", "not a hub"
            self.set(p, "post", p.pillar)
            return "applied", f"post of {p.pillar}, which has no hub now"
        if action == "drop_post":
            pillar = p.pillar
            self.set(p, "skip", None)
            self.hand_on(p, pillar)
            return "applied", "skipped"
        if p.kind == "hub":
            return ("already_true", "already planned") if action == "restore_backlog" and not aimed else ("invalid", "a hub: demote it first")
        if aimed:
            if target is None:
                return "stale", "target not found"
            if target.kind not in (("hub",) if action == "set_pillar" else ("hub", "post", "standalone")):
                return "invalid", f"the target is a {target.kind}"
            if (action == "restore_backlog" and planned) or (p.kind == "post" and p.pillar == target.pillar and p.pillar is not None):
                return "already_true", "already there"
            self.set(p, "post" if target.pillar is not None else "standalone", target.pillar)
            return "applied", f"post of {target.pillar}" if target.pillar is not None else "standalone post"
        if action == "set_pillar":
            if p.kind == "standalone":
                return "already_true", "already standalone"
            pillar = p.pillar
            self.set(p, "standalone", None)
            self.hand_on(p, pillar)
            return "applied", "standalone post"
        if planned:
            return "already_true", "already planned"
        self.set(p, *(("post", p.pillar) if p.kind == "merged" and p.pillar is not None else ("standalone", None)))
        return "applied", f"{p.kind}"


def _clashes(group: list[dict]) -> set[str]:
    """Of the decisions on one cluster, those of opposite effect."""
    acts, out = {r["action"] for r in group}, set()
    if {"promote_pillar", "demote_pillar"} <= acts:
        out |= {r["decision_id"] for r in group if r["action"] in ("promote_pillar", "demote_pillar")}
    if "drop_post" in acts and len(acts) > 1:
        out |= {r["decision_id"] for r in group}
    if len({plain_key(r["target"]) for r in group if r["action"] == "set_pillar"}) > 1:
        out |= {r["decision_id"] for r in group if r["action"] == "set_pillar"}
    return out


def apply_topics(plan: DataFrame, decisions: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The plan after decisions on its topics, and a log (applied, already_true, stale, invalid, conflict).

    ``plan``: id, market, keyword, kind (hub, post, merged, standalone, backlog,
    skip), pillar, merged_into (an id), volume; other columns ride along.  A
    cluster is named by its keyword's identity; with a blank market it must be in
    one market alone.
    """
    rows = [r.asDict() for r in decisions.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} decisions")
    spark = plan.sparkSession
    listed = sorted((r for r in rows if r["action"] in ACTIONS), key=lambda r: (ACTIONS.index(r["action"]), r["decision_id"]))
    names = sorted({plain_key(n) for r in listed for n in (r["keyword"], r["target"]) if plain_key(n)}) or [""]
    base = plan.select("id", "market", "keyword", "kind", "pillar", "merged_into", "volume").withColumn("_key", T.decision_key(F.col("keyword")))
    wanted = spark.createDataFrame([(n,) for n in names], "_key string")
    hits = base.join(F.broadcast(wanted), "_key").limit(20 * most + 1).collect()
    if len(hits) > 20 * most:
        raise ValueError(f"the decisions name more than {20 * most} clusters")
    named = [_Place(*(r[c] for c in ("id", "market", "keyword", "kind", "pillar", "merged_into", "volume"))) for r in hits]
    ids = {r["id"] for r in hits}
    touched = spark.createDataFrame([(p,) for p in sorted({x.pillar for x in named if x.pillar is not None})] or [("",)], "pillar string")
    others = base.join(F.broadcast(touched), "pillar").filter(F.col("kind").isin("hub", "post"))
    if ids:
        others = others.join(F.broadcast(spark.createDataFrame([(i, True) for i in sorted(ids)], "id long, _named boolean")), "id", "left")
    else:
        others = others.withColumn("_named", F.lit(None).cast("boolean"))
    rank = F.row_number().over(Window.partitionBy("pillar").orderBy(F.when(F.col("kind") == "hub", 0).otherwise(1), F.desc("volume"), "id"))
    tops = others.filter((F.col("kind") == "hub") | F.col("_named").isNull()).withColumn("_k", rank).filter("_k <= 2").collect()  # two a touched pillar
    place = lambda r: _Place(*(r[c] for c in ("id", "market", "keyword", "kind", "pillar", "merged_into", "volume")))
    by_id = {p.id: p for p in named}
    hubs = {r["pillar"]: by_id.get(r["id"]) or place(r) for r in tops if r["kind"] == "hub"}
    largest = {r["pillar"]: place(r) for r in sorted(tops, key=lambda r: -r["_k"]) if r["kind"] == "post"}
    numbers = base.select(F.max(F.regexp_extract("pillar", "^P([0-9]{1,9})$", 1).try_cast("int"))).first()[0] or 0
    picture = _Picture(named, hubs, largest, numbers)
    at: dict[str, list[_Place]] = defaultdict(list)
    for r, p in zip(hits, named):
        at[r["_key"]].append(p)

    def find(text: str | None, market: str) -> tuple[_Place | None, str, str]:
        found = [p for p in at.get(plain_key(text), []) if not market or p.market == market]
        if len({p.market for p in found}) > 1:
            return None, "invalid", "in several markets"
        return (max(found, key=lambda p: (p.volume, -p.id)), "", "") if found else (None, "stale", "not found")

    said: dict[str, tuple[str, str]] = {}
    by_cluster: dict = defaultdict(list)
    for r in listed:
        if r.get("author") == "proposal" or not r.get("reason") or not r.get("evidence") or not plain_key(r["keyword"]):
            said[r["decision_id"]] = ("invalid", "a proposal, or no keyword, reason or evidence")
            continue
        p, _, _ = find(r["keyword"], str(r["market"] or ""))
        by_cluster[p.id if p else (r["market"], plain_key(r["keyword"]))].append(r)
    clash = set().union(*(_clashes(g) for g in by_cluster.values())) if by_cluster else set()
    for r in listed:
        if r["decision_id"] in said:
            continue
        p, status, detail = find(r["keyword"], str(r["market"] or ""))
        if r["decision_id"] in clash:
            said[r["decision_id"]] = ("conflict", "opposite effects on one cluster")
        elif p is None:
            said[r["decision_id"]] = (status, detail)
        else:
            aimed = plain_key(r["target"]) not in ("", "none")
            said[r["decision_id"]] = picture.decide(p, r["action"], find(r["target"], p.market)[0] if aimed else None, aimed)
    log = spark.createDataFrame(
        [(r["decision_id"], r["action"], str(r["market"] or ""), r["keyword"], r["target"], *said[r["decision_id"]]) for r in listed], LOG,
    )
    changed = [(p.id, True, p.kind, p.pillar, p.merged_into) for i, p in picture.at.items() if (p.kind, p.pillar, p.merged_into) != picture.before[i]]
    new = spark.createDataFrame(changed, "id long, _c boolean, _kind string, _pillar string, _into long")
    pick = lambda c, n: F.when(F.col("_c"), F.col(n)).otherwise(F.col(c)).alias(c)
    rest = [F.col(c) for c in plan.columns if c not in ("kind", "pillar", "merged_into")]
    moved = plan.join(F.broadcast(new), "id", "left").select(*rest, pick("kind", "_kind"), pick("pillar", "_pillar"), pick("merged_into", "_into"))
    heirs = spark.createDataFrame(list(picture.handed.items()), "merged_into long, _heir long").withColumn("_h", F.lit(True))
    out = moved.join(F.broadcast(heirs), "merged_into", "left")
    lost = F.col("_h") & F.col("_heir").isNull()
    kept = [F.col(c) for c in plan.columns if c not in ("kind", "pillar", "merged_into")]
    return out.select(
        *kept, F.when(lost, "backlog").otherwise(F.col("kind")).alias("kind"), F.when(lost, None).otherwise(F.col("pillar")).alias("pillar"),
        F.when(F.col("_h"), F.col("_heir")).otherwise(F.col("merged_into")).alias("merged_into"),
    ).select(*plan.columns), log


def pillar_numbers(plan: DataFrame) -> DataFrame:
    """(pillar, number): ``P01``.. by falling volume of all that a pillar holds, then by name."""
    from .cluster import global_rank

    total = plan.filter("coalesce(pillar, '') <> ''").groupBy("pillar").agg(F.sum("volume").alias("volume"))
    return global_rank(total, [F.desc("volume"), F.asc("pillar")], "_n").select("pillar", F.format_string("P%02d", "_n").alias("number"))
