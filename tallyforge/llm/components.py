"""Connected components of links, by minimum labels and pointer jumping, and the pairs of shared keys that lie across components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Members of one key that are ordered together at most; a larger key is dealt out by salt.
SALT_SHARE = 256
#: Members on either side of a block of pairs.
KEY_SHARE = 4096
#: Rows of a side table broadcast at most.
MOST_BROADCAST = 200_000


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest node.

    Each round a node takes the smallest label among its own and its neighbours',
    then the label of that label, so long chains shorten by more than half a round.
    Labels are reduced before they are shuffled; rounds are cut by written tables.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges = scratch.keep(both, f"{name}-edges")
    labels = scratch.keep(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), f"{name}-0")
    k = 0
    while True:
        offered = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(offered, F.col("node") == F.col("a")).select("node", F.col("component").alias("before"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("far"))
        k += 1
        step = scratch.keep(lower.join(jump, "c").select("node", "before", F.least("c", "far").alias("component")), f"{name}-{k}")
        moved = step.filter("component <> before").limit(1).count()
        labels = step.drop("before")
        scratch.drop(f"{name}-{k - 1}")
        if not moved:
            scratch.drop(f"{name}-edges")
            return labels


def merged(known: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``known`` (node, component) after ``links`` (a, b) between its components; a node that it lacks is a component of its own."""
    far = connected_components(links, scratch, name).select(F.col("node").alias("component"), F.col("component").alias("far"))
    moved = known.join(far, "component", "left").select("node", F.coalesce("far", "component").alias("component"))
    alone = far.join(known.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("far").alias("component"))
    return scratch.keep(moved.unionByName(alone), f"{name}-all")


def contracted_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``connected_components`` of links (a, b), a < b, that are many for each node.

    Every node's link to its smallest partner makes a forest, whose components take
    the rounds; of the other links only the distinct ones between its trees are left.
    """
    trees = connected_components(links.groupBy("b").agg(F.min("a").alias("a")), scratch, f"{name}-trees")
    of = lambda end: trees.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
    return merged(trees, ends.filter("a <> b").distinct(), scratch, f"{name}-between")


def dealt(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (id, mark, key) of keys that have several, each with a salt that deals a key of over SALT_SHARE members out."""
    sizes = scratch.keep(members.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "key-sizes")
    held = F.broadcast(sizes) if sizes.count() <= MOST_BROADCAST else sizes
    salts = F.ceil(F.col("members") / SALT_SHARE)
    return members.join(held, "key").select("key", F.pmod(F.xxhash64("mark", "id", "key"), salts).cast("int").alias("salt"), "id", "mark")


def with_components(members: DataFrame, known: DataFrame) -> DataFrame:
    """Members with the component of their id, which is the id itself where no link is known."""
    return members.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _blocks(members: DataFrame, known: DataFrame, scratch: Scratch, details: DataFrame | None, on: tuple[str, ...], name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members p (key, i, j, largest) outside the largest component of their key, all members q, in blocks that meet by (key, i, j), and the members outside once each."""
    owned = members if "component" in members.columns else with_components(members, known)
    sizes = owned.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
    split = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("members").alias("members"), F.max(F.struct("members", "component")).alias("top")).filter("parts > 1")
    filled = lambda members: F.ceil(members / KEY_SHARE).cast("int")
    split = split.select("key", F.col("top.component").alias("largest"), filled(F.col("members") - F.col("top.members")).alias("outer"), filled(F.col("members")).alias("blocks"))
    split = scratch.keep(split, name)
    block = lambda n: F.pmod(F.xxhash64("mark", "id", F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    open_keys = owned.join(F.broadcast(split) if split.count() <= MOST_BROADCAST else split, "key")
    outside = open_keys.filter("component <> largest").select("key", "id", "mark")
    if details is not None:
        open_keys = open_keys.join(details, list(on))
    member = F.struct(*[c for c in open_keys.columns if c not in ("key", "largest", "outer", "blocks")])
    small = open_keys.filter("component <> largest").select("key", "largest", block("outer").alias("i"), member.alias("p"), "blocks").select("key", "i", every("blocks").alias("j"), "p", "largest")
    rest = open_keys.select("key", "largest", block("blocks").alias("j"), member.alias("q"), "outer").select("key", "largest", every("outer").alias("i"), "j", "q")
    return small, rest, outside


def crossing(members: DataFrame, known: DataFrame, scratch: Scratch, *, details: DataFrame | None = None, on: tuple[str, ...] = ("id", "mark")) -> DataFrame:
    """Every pair (p, q) of members (key, id, mark) of one key whose ids lie in different components (node, component).

    Members outside a key's largest component meet all others. Each side is cut into
    as many blocks of KEY_SHARE as it fills, and a task takes a pair of blocks: where
    few lie outside the largest component, the members are sent once. Members may have
    their component already. ``details`` are joined to the members that are left to pair.
    """
    small, rest, _ = _blocks(members, known, scratch, details, on, "split")
    # Two members outside the largest component meet twice; one of the two is enough.
    once = (F.col("q.component") == F.col("largest")) | (F.col("p.component") < F.col("q.component"))
    return small.drop("largest").join(rest, ["key", "i", "j"]).filter(once & (F.col("p.component") != F.col("q.component"))).select("p", "q")


def reaching(members: DataFrame, known: DataFrame, scratch: Scratch, link: Column, *, details: DataFrame | None = None, on: tuple[str, ...] = ("id", "mark")) -> tuple[DataFrame, DataFrame]:
    """Links of components (a, b), and the members outside the largest component of their key.

    A member p outside is met with the members q of the largest component, in the blocks
    of ``crossing``, until one of them fits ``link`` (over ``p`` and ``q``): a row for each
    member and block, however many it is linked with. Pairs of two members outside are
    those that are left to compare.
    """
    small, rest, outside = _blocks(members, known, scratch, details, on, "reach-split")
    p, q = small.alias("s"), rest.filter("q.component = largest").select(*(F.col(c).alias(f"{c}_") for c in ("key", "i", "j")), "q").alias("r")
    met = p.join(q, (F.col("key") == F.col("key_")) & (F.col("i") == F.col("i_")) & (F.col("j") == F.col("j_")) & link, "left_semi")
    links = met.select(F.col("p.component").alias("a"), F.col("largest").alias("b")).distinct()
    return links, outside
