"""Which sub-topics of a pillar deserve a post: weighted coverage, picked greedily.

A sub-topic is a set of core words: a whole core, or one word of one.  It may
take the members whose core holds all its words and that no more specific
sub-topic has; its gain is their volume.  Picks go by falling gain while enough
is gained.  Gains only fall as members find more specific owners, so a gain that
was computed earlier bounds the present one: sub-topics wait in a heap under
their last gain, the top one is brought up to date, and it is picked when it
stays on top (lazy evaluation of submodular gains).  A pick therefore touches few
sub-topics, and supports are index arrays.

Picking is sequential inside a pillar, whose size the pillar stages bound;
pillars run in parallel.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that say who or when, and narrow a topic without making another.
MODIFIERS = (
    "kids", "adults", "family", "teen", "teens", "teenager", "seniors", "group", "youth", "couples", "men", "women", "students", "week", "weekend",
    "break", "time", "night", "today", "year", "years",
)


@dataclass(frozen=True)
class Limits:
    """Least volume of a post, its least share of the pillar, the volume from which a post is always worth it, the share of the strongest sub-topic and of a wider one that a narrower must reach, and the pillar size up to which nothing is merged."""

    least: int = 300
    share: float = 0.02
    always: int = 2000
    of_strongest: float = 0.10
    of_wider: float = 0.10
    small: int = 0
    modifiers: tuple[str, ...] = MODIFIERS


class Topics:
    """Sub-topics of the members' cores (lists of word sets), hub's words left out, with their supports."""

    def __init__(self, cores: list[frozenset[str]], hub: frozenset[str], limits: Limits) -> None:
        light = frozenset(limits.modifiers)
        by_word: dict[str, list[int]] = {}
        for i, core in enumerate(cores):
            for word in core:
                by_word.setdefault(word, []).append(i)
        words = {w: np.array(v) for w, v in by_word.items()}
        found = {c for c in cores if c} | {frozenset((w,)) for w in words}
        # ties: fewer words first, then the later in the order of the alphabet
        self.sets = sorted((s for s in found if not s <= hub), key=lambda s: (-len(s), sorted(s)), reverse=True)
        self.weight = [(len(s - light), len(s)) for s in self.sets]
        self.support = [self._holders(s, words) for s in self.sets]
        self.light = light

    @staticmethod
    def _holders(topic: frozenset[str], words: dict[str, np.ndarray]) -> np.ndarray:
        lists = sorted((words[w] for w in topic), key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True)
        return out

    def is_section(self, t: int, gain: int, picked: dict[int, int], limits: Limits) -> bool:
        """Whether a picked wider sub-topic makes ``t`` a section: it adds modifiers alone, or too little."""
        return any(self.sets[p] < self.sets[t] and (self.sets[t] - self.sets[p] <= self.light or gain < limits.of_wider * g) for p, g in picked.items())


def choose(cores: Iterable[Iterable[str]], volumes: Iterable[int], hub: Iterable[str] = (), limits: Limits | None = None) -> tuple[
    list[frozenset[str]], set[frozenset[str]],
]:
    """Each member's sub-topic (the hub's words where it has none), and the sub-topics that are posts."""
    limits = limits or Limits()
    cores, volume = [frozenset(c) for c in cores], np.array(list(volumes), np.int64)
    hub = frozenset(hub)
    topics = Topics(cores, hub, limits)
    rank = {w: i for i, w in enumerate(sorted({*topics.weight, (len(hub - topics.light), len(hub))}))}
    level = np.full(len(cores), rank[len(hub - topics.light), len(hub)])
    owner = np.full(len(cores), -1)
    floor = max(limits.least, limits.share * int(volume.sum()))
    bar = max(limits.least, min(floor, limits.always))

    def open_to(t: int) -> np.ndarray:
        held = topics.support[t]
        return held[level[held] < rank[topics.weight[t]]]

    heap = [(-int(volume[open_to(t)].sum()), t) for t in range(len(topics.sets))]
    heapq.heapify(heap)
    picked: dict[int, int] = {}
    while heap and -heap[0][0] >= bar:
        _, t = heapq.heappop(heap)
        mine = open_to(t)
        gain = int(volume[mine].sum())
        if heap and (-gain, t) > heap[0]:
            heapq.heappush(heap, (-gain, t))
            continue
        if gain < bar or topics.is_section(t, gain, picked, limits):
            continue
        if not picked:
            bar = max(limits.least, min(max(floor, limits.of_strongest * gain), limits.always))
        picked[t] = gain
        level[mine], owner[mine] = rank[topics.weight[t]], t
    owned = np.bincount(owner[owner >= 0], weights=volume[owner >= 0], minlength=len(topics.sets))
    posts = {topics.sets[t] for t in picked if (owner == t).any() and 2 * owned[t] >= bar}
    return [topics.sets[t] if t >= 0 else hub for t in owner.tolist()], posts


def greedy_cover(rows: DataFrame, group: str, limits: Limits | None = None, hub: str | None = None) -> DataFrame:
    """(group, id, node, kept) of every member (columns id, words, volume; ``hub`` flags the row whose words the pillar page has).

    ``node`` holds the words of the member's sub-topic in order, and ``kept``
    whether that is a post.  The hub's own row is no member.  A pillar of up to
    ``limits.small`` members keeps them all, each under its own words.
    """
    limits = limits or Limits()
    schema = f"{group} string, id long, node string, kept boolean"

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        hubs, members = pdf[pdf["hub"]], pdf[~pdf["hub"]].sort_values("id")
        if len(pdf) <= limits.small:
            nodes, kept = [" ".join(sorted(w)) for w in members["words"]], [True] * len(members)
        else:
            owner, posts = choose(members["words"], members["volume"], hubs["words"].iloc[0] if len(hubs) else (), limits)
            nodes, kept = [" ".join(sorted(n)) for n in owner], [n in posts for n in owner]
        return pd.DataFrame({group: pdf[group].iloc[0], "id": members["id"].to_numpy(), "node": nodes, "kept": kept})

    flag = F.coalesce(F.col(hub).cast("boolean"), F.lit(False)) if hub else F.lit(False)
    return rows.select(group, "id", "words", "volume", flag.alias("hub")).groupBy(group).applyInPandas(cover, schema)


def adopted(clusters: DataFrame, candidates: DataFrame, modifiers: tuple[str, ...] = MODIFIERS) -> DataFrame:
    """(id, pillar): the pillar of the candidate whose core a long-tail cluster's core holds, or half agrees with.

    A whole core beats half of one, then more words in common, then volume, then
    the least pillar.  Columns id, core, market of both; candidates have pillar
    and volume.  Only those that share a subject word meet.
    """
    subject = lambda c: F.filter(c, lambda w: ~w.isin(*modifiers))
    a = clusters.select("id", "market", "core", F.explode(subject("core")).alias("word"))
    b = candidates.select(
        F.col("id").alias("cid"), "market", "pillar", "volume", F.col("core").alias("ccore"), F.explode(subject("core")).alias("word"),
    )
    met = a.join(b, ["market", "word"]).filter("id <> cid")
    shared, union = F.size(F.array_intersect("core", "ccore")), F.size(F.array_union("core", "ccore"))
    held = F.size(F.array_except("ccore", "core")) == 0
    score = F.when(held, F.struct(F.lit(2).alias("kind"), F.size("ccore").alias("n"), F.col("volume").alias("v"))).when(
        2 * shared >= union, F.struct(F.lit(1).alias("kind"), shared.alias("n"), F.col("volume").alias("v")),
    )
    best = met.withColumn("s", score).filter("s is not null")
    return best.groupBy("id").agg(F.min_by("pillar", F.struct(-F.col("s.kind"), -F.col("s.n"), -F.col("s.v"), F.col("pillar"))).alias("pillar"))


def merge_targets(rows: DataFrame) -> DataFrame:
    """(id, target, how): the kept post of its pillar that a merged cluster becomes a section of.

    Columns id, pillar, core (words), volume, kept, hub.  A post whose whole core
    the cluster's holds is nearest (the largest core, then volume), else the one
    with most words in common, else the pillar's hub; none without one of these.
    Only word sets that share a word meet: of the posts of one set the greatest
    volume, then the least target stands for all, and clusters of one set share
    their answer.  Rows grow with a pillar's distinct sets squared at most, not
    with its clusters times its posts.
    """
    loose = rows.filter("not kept").select("id", "pillar", F.array_sort(F.array_distinct("core")).alias("set"))
    posts = rows.filter("kept").select(F.col("id").alias("target"), "pillar", F.array_sort(F.array_distinct("core")).alias("own"), "volume", "hub")
    order = F.struct(F.col("volume").isNotNull().alias("v"), "volume", (-F.col("target")).alias("t"))
    stands = posts.groupBy("pillar", "own").agg(F.max(order).alias("o"))
    words = stands.select("pillar", "own", "o", F.explode("own").alias("word"))
    sets = loose.select("pillar", "set").distinct()
    met = sets.select("pillar", "set", F.explode("set").alias("word")).join(words, ["pillar", "word"])
    pairs = met.groupBy("pillar", "set", "own").agg(F.first("o").alias("o"), F.count("*").alias("shared"))
    held = F.col("shared") == F.size("own")
    score = F.struct(held.cast("int").alias("held"), "shared", "o")
    best = pairs.groupBy("pillar", "set").agg(F.max_by(F.struct((-F.col("o.t")).alias("target"), held.alias("held")), score).alias("b"))
    hubs = posts.filter("hub").groupBy("pillar").agg(F.min("target").alias("hub_id"))
    x = loose.join(best, ["pillar", "set"], "left").join(hubs, "pillar", "left")
    how = F.when(F.col("b.held"), "contained").when(F.col("b").isNotNull(), "overlap").when(F.col("hub_id").isNotNull(), "hub").otherwise("none")
    return x.select("id", F.coalesce("b.target", "hub_id").alias("target"), how.alias("how"))


def misplaced(posts: DataFrame) -> DataFrame:
    """(slug, pillar, other): posts whose word set is that of another pillar's name, and the least such pillar.

    Columns market, slug, pillar, words and, of pillars, is_pillar.
    """
    same = F.array_join(F.array_sort(F.array_distinct("words")), " ")
    hubs = posts.filter("is_pillar").select("market", same.alias("set"), F.col("pillar").alias("other")).filter("`set` <> ''")
    found = posts.filter("not is_pillar").withColumn("set", same).join(hubs, ["market", "set"]).filter("pillar <> other")
    return found.groupBy("slug", "pillar").agg(F.min("other").alias("other"))
