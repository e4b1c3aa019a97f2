"""Parent-child links to full hierarchies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import settle

#: Links that one forest holds, about: what a task keeps in memory.
LINKS_PER_FOREST = 500_000
#: Path steps that leave a task at once, about.
BATCH_STEPS = 1_000_000


class Forest:
    """A weighted disjoint-set forest over the links of one partition.

    find() with path compression: far gives for each child the farthest ancestor that these links reach, the
    steps to it (its weight), and the smallest node on the way, the ancestor left out. A chain that runs
    into a ring of these links has the ring's smallest node and -1 steps instead.
    """

    def __init__(self, up: dict[int, int]):
        self.up = up
        self.far: dict[int, tuple[int, int, int]] = {}
        for start in up:
            self._find(start)

    def _find(self, x: int) -> None:
        up, far, chain = self.up, self.far, {}
        while x in up and x not in far and x not in chain:
            chain[x] = None
            x = up[x]
        way = list(chain)
        if x in chain:
            ring = way[way.index(x) :]
            root, steps, low = min(ring), -1, 0
        else:
            root, steps, low = far.get(x, (x, 0, x))
            low = low if x in far else None
        for y in reversed(way):
            if steps >= 0:
                steps += 1
                low = y if low is None or y < low else low
            far[y] = (root, steps, low)

    def way(self, x: int) -> list[int]:
        """The nodes from below x's farthest ancestor down to x; none for a chain into a ring."""
        if self.far[x][1] < 0:
            return []
        out = []
        while x in self.up:
            out.append(x)
            x = self.up[x]
        return out[::-1]


def _forests(with_paths: bool):
    """One forest a partition, as (node, anc, off, low, seg): all batches of links are put together first."""
    names = ["node", "anc", "off", "low", "seg"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}
        for pdf in batches:
            up.update(zip(pdf["node"].tolist(), pdf["parent"].tolist()))
        forest = Forest(up)
        rows, steps = [], 0
        for x, found in forest.far.items():
            seg = forest.way(x) if with_paths else None
            rows.append((x, *found, seg))
            steps += 1 + len(seg or ())
            if steps >= BATCH_STEPS:
                yield pd.DataFrame(rows, columns=names)
                rows, steps = [], 0
        yield pd.DataFrame(rows, columns=names)

    return run


def _merge(trees: DataFrame) -> DataFrame:
    """(node, anc, off, low, seg) of trees with roots that other trees hold: the same with the last ancestor of all.

    Only the nodes at which trees hang below others, the exits, are merged: each takes one step from tree to
    tree, the ways adding up, and the exits still needed for the others are merged in turn, so each round
    sees at most as many nodes as the round before, far fewer where nodes have several children. In the end
    every tree looks its exit up once. A round in which no exit reaches a node without parent proves that
    only chains into rings are left, as the exit nearest to such a node would have reached it.
    """
    exits = settle(trees.join(trees.select(F.col("anc").alias("node")).distinct(), "node", "left_semi"))
    if exits.isEmpty():
        return trees
    up = exits.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("off").alias("off2"), F.col("low").alias("low2"), F.col("seg").alias("seg2"))
    stepped = settle(_step(exits.join(up, "anc", "left"), F.col("anc2").isNull()))
    solved = _ringed(exits) if stepped.where("last").isEmpty() else _merge(stepped.drop("last"))
    found = solved.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("off").alias("off2"), F.col("low").alias("low2"), F.col("seg").alias("seg2"))
    return _step(trees.join(found, "anc", "left"), F.lit(True)).drop("last")


def _step(joined: DataFrame, last) -> DataFrame:
    """A way (anc, off, low, seg) with the way (anc2, off2, low2, seg2) from its end on added to it, if there is one; 2 off is -1 where that runs into a ring."""
    ring = F.coalesce(F.col("off2") < 0, F.lit(False))
    none = F.array().cast("array<bigint>")
    return joined.select(
        "node", F.coalesce("anc2", "anc").alias("anc"), F.when(ring, -1).otherwise(F.col("off") + F.coalesce("off2", F.lit(0))).cast("long").alias("off"),
        F.least("low", F.coalesce("low2", "low")).alias("low"), F.when(ring, none).otherwise(F.concat(F.coalesce("seg2", none), F.coalesce("seg", none))).alias("seg"), last.alias("last"),
    )


def _ringed(exits: DataFrame) -> DataFrame:
    """_merge() of nodes all of whose chains run into rings: anc is the ring's smallest node, off -1."""
    step = settle(exits.select("node", F.col("anc").alias("to")))
    size = step.count()
    while True:  # the image of the doubled step shrinks until only rings are left
        image = step.select(F.col("to").alias("node")).distinct().count()
        if image == size:
            break
        size = image
        step = settle(step.join(step.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")))
    on_ring = settle(step.select(F.col("to").alias("node")).distinct())
    label = settle(exits.join(on_ring, "node", "left_semi").select("node", F.col("anc").alias("to"), F.least("low", "node").alias("low")))
    while True:  # minima over stretches of doubling length, until none falls
        ahead = label.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("low").alias("low2"))
        new = settle(label.join(ahead, "to").select("node", F.col("far").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("fell")))
        if new.where("fell").isEmpty():
            break
        label = new.drop("fell")
    named = label.select(F.col("node").alias("to"), "low")
    return step.join(named, "to").select("node", F.col("low").alias("anc"), F.lit(-1).cast("long").alias("off"), "low", F.array().cast("array<bigint>").alias("seg"))


def _climb(links: DataFrame, child: str, parent: str, with_paths: bool) -> DataFrame:
    """(node, root, depth, path) of all nodes."""
    edge = links.select(F.col(child).cast("long").alias("node"), F.col(parent).cast("long").alias("parent")).where("node is not null and parent is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    edge = settle(edge)
    parts = -(-edge.count() // LINKS_PER_FOREST)
    lying = edge.repartitionByRange(parts, "node") if parts > 1 else edge.coalesce(1)
    trees = settle(lying.mapInPandas(_forests(with_paths), "node long, anc long, off long, low long, seg array<long>"))
    if parts > 1:
        ringed = trees.where("off < 0")  # rings within one partition, and what leads to them there
        loops = ringed.select(F.col("node").alias("anc"), F.col("anc").alias("root")).distinct()
        found = settle(_merge(trees.where("off >= 0")))
        found = found.join(loops, "anc", "left").select("node", F.coalesce("root", "anc").alias("anc"), F.when(F.col("root").isNotNull(), -1).otherwise(F.col("off")).alias("off"), "seg")
        trees = settle(found.unionByName(ringed.select("node", "anc", "off", "seg")))
    none = F.array().cast("array<bigint>")
    path = F.when(F.col("off") >= 0, F.concat(F.array("anc"), "seg")).otherwise(none) if with_paths else F.lit(None).cast("array<bigint>")
    below = trees.select("node", F.col("anc").alias("root"), F.col("off").alias("depth"), path.alias("path"))
    tops = trees.where("off >= 0").select("anc").distinct()
    return below.unionByName(tops.select(F.col("anc").alias("node"), F.col("anc").alias("root"), F.lit(0).cast("long").alias("depth"), (F.array("anc") if with_paths else F.lit(None).cast("array<bigint>")).alias("path")))


def roots(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Root and depth of every node of a forest given as links (child, parent), rings found.

    Result: (node, root, depth) for each node that is a child or a parent. If the chain of parents runs
    into a ring (a node that is its own parent included), root is the smallest node on the ring and depth
    is -1. A node without parent is its own root at depth 0.
    Defined cases: links with a null end are no links; repeated links count once; of several parents the
    smallest holds; an empty table yields no rows. Other columns are not read.

    Method: links lie ordered by child in partitions of about LINKS_PER_FOREST; a weighted disjoint-set
    forest combines each partition's links to (node, farthest ancestor known there, steps). The forests are
    then merged through the nodes at which their trees hang below others, see _merge().
    Scale: nothing is collected but counts. Merging joins exits only, in rounds that halve the remaining
    chains; nodes that are no exits take part in one join, at the end. The right side of every join has one
    row a node, so a parent of a third of all nodes only skews the left side, which adaptive execution splits.
    """
    return _climb(links, child, parent, False).drop("path")


def paths(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """roots() with the full path of each node, from its root down to itself.

    Result: (node, root, depth, path array<long>). The path of a node above a ring is empty. The stretch of
    a path within a partition comes from its forest; the stretches above are looked up by the exit's key and
    put before it as trees are merged.
    """
    return _climb(links, child, parent, True)


def descendants(pathed: DataFrame) -> DataFrame:
    """(ancestor, node, distance) for each node of paths() and each of its proper ancestors."""
    return (
        pathed.select("node", "depth", F.posexplode("path").alias("level", "ancestor"))
        .where("ancestor != node")
        .select("ancestor", "node", (F.col("depth") - F.col("level")).cast("long").alias("distance"))
    )
