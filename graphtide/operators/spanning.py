"""How graphs of any size grow from a seed, over tables: a least spanning tree, and the order in which Prim's algorithm walks it.

An edge's weight is its place, so weights differ and the tree is unique. Every step below is a few joins and grouped sums
over (graph_id, node), repeated about as often as the logarithm of a depth; no task holds a graph.

0. Blocks: a task drops edges that are the greatest of a cycle, then joins nodes of neighbouring numbers as far as their
   least edges stay among them. What is left are the edges between such parts; the rounds go over these only.
1. Tree (Boruvka): each component takes its least edge to another; components that are joined so become one, found by
   doubling pointers; repeat with the edges that are left.
2. Root: from the last round back to the first, the component that holds its component's entry is entered there; edges on
   the way from it to the round's root turn round, the others keep their direction. Each node gets its parent and w, the
   weight of the edge from it.
3. Order: Prim's algorithm enters a part of the tree by its heaviest edge last and leaves no lighter edge behind. So v
   comes in the part opened by the nearest node above it whose w is greater (its opener; found by doubling with maxima), and
   the parts of one opener come by weight. The order is a walk of the tree of openers: a node's step is its opener's, and
   one, and the sizes of the parts that the same opener opened by lighter edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.operators.kept import kept
from graphtide.operators.prefix import running_sum


def _doubled(pointers: DataFrame) -> list[DataFrame]:
    """Takes (graph_id, c, up). The k-th table points 2^k steps up, or as far as there is a pointer; the last points to the end of each way."""
    tables = [kept(pointers)]
    while True:
        at = tables[-1].select("graph_id", F.col("c").alias("up"), F.col("up").alias("further"))
        step = kept(tables[-1].join(at, ["graph_id", "up"], "left").select("graph_id", "c", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return tables
        tables.append(step.drop("moved"))


def _ends(pointers: DataFrame) -> DataFrame:
    """`pointers` with up and m replaced: where each way ends, and the greatest m on it. Takes (graph_id, c, up, m), without cycles, and other columns.

    A task first follows the pointers within its range of nodes. What these lead to is then followed apart, by doubling: a
    chain of neighbouring numbers leaves a node for each range there.
    """

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not sum(map(len, parts)):
            return
        pdf = pd.concat(parts, ignore_index=True)
        index = lambda c: pd.Index(pdf[c]) if single else pd.MultiIndex.from_arrays([pdf.graph_id, pdf[c]])
        single = pdf.graph_id.nunique() == 1
        at = index("c").get_indexer(index("up"))
        up, m = pdf.up.to_numpy(np.int64), pdf.m.to_numpy(np.int64)
        while (inside := at >= 0).any():
            next_ = np.maximum(at, 0)
            up, m, at = np.where(inside, up[next_], up), np.where(inside, np.maximum(m, m[next_]), m), np.where(inside, at[next_], -1)
        yield pdf.assign(up=up, m=m)

    table = kept(pointers.repartitionByRange("graph_id", "c").mapInPandas(within, pointers.schema))
    further = lambda t: t.select("graph_id", F.col("c").alias("up"), F.col("up").alias("up2"), F.col("m").alias("m2"))
    led = kept(table.select("graph_id", "c", "up", "m").join(table.select("graph_id", F.col("up").alias("c")).distinct(), ["graph_id", "c"], "left_semi"))
    if led.isEmpty():
        return table
    while True:
        step = kept(led.join(further(led), ["graph_id", "up"], "left").select("graph_id", "c", F.coalesce("up2", "up").alias("up"), F.greatest("m", "m2").alias("m"), F.col("up2").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            break
        led = step.drop("moved")
    return kept(table.join(further(led), ["graph_id", "up"], "left").withColumns({"up": F.coalesce("up2", "up"), "m": F.greatest("m", "m2")}).select(*pointers.columns))


def _rounds(edges: DataFrame) -> tuple[list[dict], DataFrame]:
    """Boruvka's rounds, each with the labels it began with, the least edge of each component but the round's roots (c, to, pos, x in c, y in to) and each component's root; and the last labels (graph_id, node, comp)."""
    live = kept(edges.select("graph_id", F.col("edge_pos").alias("pos"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("from_id").alias("x"), F.col("to_id").alias("y")))
    labels = kept(live.select("graph_id", F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")))
    rounds = []
    while not live.isEmpty():
        both = live.select("graph_id", F.col("a").alias("c"), F.col("b").alias("to"), "pos", "x", "y").unionByName(live.select("graph_id", F.col("b").alias("c"), F.col("a").alias("to"), "pos", F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("graph_id", "c").agg(F.min(F.struct("pos", "to", "x", "y")).alias("m")).select("graph_id", "c", "m.*")
        # Two components that took the same edge: the lesser is a root.
        twice = least.groupBy("graph_id", "pos").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n")).filter("n = 2").select("graph_id", "c")
        forest = kept(least.join(twice, ["graph_id", "c"], "left_anti"))
        roots = _ends(forest.select("graph_id", "c", F.col("to").alias("up"), F.lit(-1).cast("long").alias("m")))
        root = lambda of, name: roots.select("graph_id", F.col("c").alias(of), F.col("up").alias(name))  # noqa: B023, E731
        rounds.append({"labels": labels, "forest": forest, "roots": roots})
        labels = kept(labels.join(root("comp", "r"), ["graph_id", "comp"], "left").select("graph_id", "node", F.coalesce("r", "comp").alias("comp")))
        joined = live.join(root("a", "ra"), ["graph_id", "a"], "left").join(root("b", "rb"), ["graph_id", "b"], "left")
        live = kept(joined.select("graph_id", "pos", F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "x", "y").filter("a <> b"))
    return rounds, labels


#: Nodes with numbers next to each other whose tree a task makes, and edges that a task thins out at once.
BLOCK = 1 << 16
EDGES_AT_ONCE = 1 << 18
#: Places of edges whose nodes are numbered together.
PLACES_AT_ONCE = 1 << 14
_FAR = np.iinfo(np.int64).max


def least_forest(a: np.ndarray, b: np.ndarray, pos: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Which edges are taken by Boruvka's rounds. Takes edges between the nodes 0, 1, ... by rising pos, which differ, and for each node the least pos of an edge that leads elsewhere; a part whose least edge leads elsewhere takes none."""
    part, taken, live = np.arange(len(out)), np.zeros(len(pos), bool), np.arange(len(pos))
    while len(live):
        pa, pb = part[a[live]], part[b[live]]
        apart = pa != pb
        live, pa, pb = live[apart], pa[apart], pb[apart]
        least = np.full(len(out), len(pos))
        # By falling place, so that the least is written last.
        least[pa[::-1]] = live[::-1]
        other = np.full(len(out), len(pos))
        other[pb[::-1]] = live[::-1]
        least = np.minimum(least, other)
        takes = np.flatnonzero(least < len(pos))
        takes = takes[pos[least[takes]] < out[takes]]
        if not len(takes):
            break
        edge = least[takes]
        taken[edge] = True
        up = np.arange(len(out))
        up[takes] = part[a[edge]] + part[b[edge]] - takes
        both = np.flatnonzero((up[up] == np.arange(len(out))) & (up > np.arange(len(out))))
        up[both] = both
        while (up[up] != up).any():
            up = up[up]
        np.minimum.at(out, up, out.copy())
        part = up[part]
    return taken


def thinned(edges: DataFrame) -> DataFrame:
    """`edges` (graph_id, pos, a, b) without some that are the greatest of a cycle: each task leaves what its edges' own least forest holds. No shuffle."""

    def left(pdf: pd.DataFrame) -> pd.DataFrame:
        kept_rows = []
        for _, rows in pdf.groupby("graph_id", sort=False):
            rows = rows.sort_values("pos")
            nodes, ends = np.unique(rows[["a", "b"]].to_numpy(np.int64).T.ravel(), return_inverse=True)
            kept_rows.append(rows[least_forest(ends[: len(rows)], ends[len(rows) :], rows.pos.to_numpy(np.int64), np.full(len(nodes), _FAR))])
        return pd.concat(kept_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= EDGES_AT_ONCE:
                yield left(pd.concat(held))
                held, size = [], 0
        if size:
            yield left(pd.concat(held))

    return edges.mapInPandas(run, edges.schema)


def _block_trees(live: DataFrame, apart: DataFrame, seed: int, block: int) -> DataFrame:
    """graph_id, c, up, pos, root, other: parts of the least forest within blocks of nodes. A part's root is the seed, if it holds it, else its end of the least edge that leaves it, else any node; roots have null up and pos. `other` is null but in rows of edges between two parts of a block: from c to up, with both parts' roots.

    A task gets the edges within its block, and of those that leave it (`apart`) each node's least.
    """
    leaving = apart.select("graph_id", F.col("a").alias("c"), "pos").unionByName(apart.select("graph_id", F.col("b").alias("c"), "pos")).groupBy("graph_id", "c").agg(F.min("pos").alias("pos"))
    inner = live.filter(_block("a", block) == _block("b", block)).select("graph_id", "a", "b", "pos", F.lit(False).alias("leaves"))
    rows = inner.unionByName(leaving.select("graph_id", F.col("c").alias("a"), F.col("c").alias("b"), "pos", F.lit(True).alias("leaves"))).withColumn("block", _block("a", block))

    def trees(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        inner, outer = pdf[~pdf.leaves].sort_values("pos"), pdf[pdf.leaves]
        n = len(inner)
        nodes, at = np.unique(np.concatenate([inner.a, inner.b, outer.a]).astype(np.int64), return_inverse=True)
        a, b, pos = at[:n], at[n : 2 * n], inner.pos.to_numpy(np.int64)
        out = np.full(len(nodes), _FAR)
        out[at[2 * n :]] = outer.pos
        taken = least_forest(a, b, pos, out.copy())
        ends, others = np.concatenate([a[taken], b[taken]]), np.concatenate([b[taken], a[taken]])
        order = np.argsort(ends, kind="stable")
        near, weight = others[order].tolist(), np.tile(pos[taken], 2)[order].tolist()
        starts = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=len(nodes)))]).tolist()
        up, by, root = [-1] * len(nodes), [0] * len(nodes), [-1] * len(nodes)
        # Of a part's nodes the seed comes first, then that with the least edge out.
        for r in np.lexsort((out, nodes != seed)).tolist():
            if root[r] >= 0:
                continue
            stack, root[r] = [r], r
            while stack:
                v = stack.pop()
                for i in range(starts[v], starts[v + 1]):
                    if root[u := near[i]] < 0:
                        root[u], up[u], by[u] = r, v, weight[i]
                        stack.append(u)
        above, part = np.array(up), np.array(root)
        null = above < 0
        masked = lambda values, mask: pd.arrays.IntegerArray(np.asarray(values, np.int64), mask)
        found = pd.DataFrame({"graph_id": key[0], "c": nodes, "up": masked(nodes[above], null), "pos": masked(by, null), "root": nodes[part], "other": masked(nodes, np.ones(len(nodes), bool))})
        left = part[a] != part[b]
        a, b, pos = a[left], b[left], pos[left]
        no = np.zeros(len(a), bool)
        return pd.concat([found, pd.DataFrame({"graph_id": key[0], "c": nodes[a], "up": masked(nodes[b], no), "pos": masked(pos, no), "root": nodes[part[a]], "other": masked(nodes[part[b]], no)})])

    return rows.groupBy("graph_id", "block").applyInPandas(trees, f"graph_id {dict(live.dtypes)['graph_id']}, c long, up long, pos long, root long, other long")


def _block(node: str, block: int) -> Column:
    return F.floor(F.col(node) / block)


def rooted_tree(edges: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """graph_id, node, parent, w of each node but the seed that the seed reaches: the least spanning tree, rooted. Takes edges (graph_id, edge_pos, from_id, to_id) between different nodes.

    Blocks of nodes are joined to parts in one task each; the rounds over tables go over what is left between the parts.
    """
    live = kept(thinned(edges.select("graph_id", F.col("edge_pos").alias("pos"), F.col("from_id").alias("a"), F.col("to_id").alias("b"))))
    apart = kept(live.filter(_block("a", block) != _block("b", block)))
    rows = kept(_block_trees(live, apart, seed, block))
    inside = rows.filter("other is null")
    between = apart.withColumnsRenamed({"a": "x", "b": "y"})
    for end, name in (("x", "a"), ("y", "b")):
        between = between.join(inside.select("graph_id", F.col("c").alias(end), F.col("root").alias(name)), ["graph_id", end])
    between = between.unionByName(rows.filter("other is not null").select("graph_id", F.col("c").alias("x"), F.col("up").alias("y"), "pos", F.col("root").alias("a"), F.col("other").alias("b")))
    # Of the edges between two parts the least.
    pair = between.groupBy("graph_id", F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
    between = kept(pair.agg(F.min(F.struct("pos", "x", "y", "a", "b")).alias("m")).select("graph_id", "m.*"))
    top = _tree_by_rounds(between.select("graph_id", F.col("pos").alias("edge_pos"), F.col("a").alias("from_id"), F.col("b").alias("to_id")), seed)
    first = F.col("a") == F.col("node")
    joined = kept(top.join(between.withColumnRenamed("pos", "w"), ["graph_id", "w"]).select("graph_id", F.col("node").alias("root"), F.when(first, F.col("x")).otherwise(F.col("y")).alias("node"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("parent"), "w"))
    seeds = inside.filter(F.col("c") == seed).select("graph_id", "root", F.col("c").alias("entry"))
    entries = kept(seeds.unionByName(joined.select("graph_id", "root", F.col("node").alias("entry"))))
    steps = inside.join(entries, ["graph_id", "root"]).filter("up is not null")
    within = steps.select("graph_id", F.col("c").alias("node"), F.col("up").alias("parent"), F.col("pos").alias("w"))
    # Where a part is entered elsewhere than at its root, the way from there to the root turns round.
    elsewhere = kept(steps.filter("entry <> root").select("graph_id", "c", "up", "pos", "entry"))
    if not elsewhere.isEmpty():
        way = elsewhere.select("graph_id", F.col("entry").alias("c")).distinct()
        for table in reversed(_doubled(elsewhere.select("graph_id", "c", "up"))):
            way = kept(way.unionByName(way.join(table, ["graph_id", "c"]).select("graph_id", F.col("up").alias("c"))).distinct())
        turned = elsewhere.join(way, ["graph_id", "c"], "left_semi").select("graph_id", F.col("up").alias("node"), F.col("c").alias("parent"), F.col("pos").alias("w"))
        within = within.join(way.withColumnRenamed("c", "node"), ["graph_id", "node"], "left_anti").unionByName(turned)
    return kept(within.unionByName(joined.select("graph_id", "node", "parent", "w")))


def _tree_by_rounds(edges: DataFrame, seed: int) -> DataFrame:
    """rooted_tree() of any edges, by rounds over tables."""
    rounds, labels = _rounds(edges)
    entries = kept(labels.filter(F.col("node") == seed).select("graph_id", "comp", F.col("node").alias("entry")))
    found = []
    for r in reversed(rounds):
        forest = r["forest"]
        inside = entries.withColumnRenamed("comp", "r").join(r["labels"].withColumnRenamed("node", "entry"), ["graph_id", "entry"]).select("graph_id", "r", "comp", "entry")
        inside = kept(inside)
        way = inside.select("graph_id", F.col("comp").alias("c"))
        if not way.join(forest.select("graph_id", "c"), ["graph_id", "c"], "left_semi").isEmpty():
            for table in reversed(_doubled(forest.select("graph_id", "c", F.col("to").alias("up")))):
                way = kept(way.unionByName(way.join(table, ["graph_id", "c"]).select("graph_id", F.col("up").alias("c"))).distinct())
        reached = forest.join(r["roots"].select("graph_id", "c", F.col("up").alias("r")), ["graph_id", "c"]).join(entries.select("graph_id", F.col("comp").alias("r")), ["graph_id", "r"], "left_semi")
        turned = reached.join(way.withColumn("turned", F.lit(True)), ["graph_id", "c"], "left").withColumn("turned", F.coalesce("turned", F.lit(False)))
        pick = lambda a, b: F.when(F.col("turned"), F.col(a)).otherwise(F.col(b))
        steps = kept(turned.select("graph_id", pick("to", "c").alias("comp"), pick("y", "x").alias("node"), pick("x", "y").alias("parent"), F.col("pos").alias("w")))
        found.append(steps)
        entries = kept(inside.select("graph_id", "comp", "entry").unionByName(steps.select("graph_id", "comp", F.col("node").alias("entry"))))
    if not found:
        return edges.select("graph_id", F.col("from_id").alias("node"), F.col("to_id").alias("parent"), F.col("edge_pos").alias("w"))
    return kept(reduce(DataFrame.unionByName, found).select("graph_id", "node", "parent", "w"))


def openers(tree: DataFrame, seed: int = 0) -> DataFrame:
    """graph_id, node, w, opener: the nearest node above whose w is greater than the node's, or the seed."""
    # The greatest w of the node and all above it; what is above is lighter if it is the node's.
    known = _ends(tree.select("graph_id", F.col("node").alias("c"), F.col("parent").alias("up"), F.col("w").alias("m"), "w", "parent"))
    lightest = known.filter("m = w").select("graph_id", F.col("c").alias("node"), "w", F.lit(seed).cast("long").alias("opener"))
    at = kept(known.filter("m > w").select("graph_id", F.col("c").alias("node"), "w", "c"))
    if at.isEmpty():
        return kept(lightest)
    above = tree.select("graph_id", F.col("node").alias("parent"), F.col("w").alias("m"))
    first = kept(tree.join(above, ["graph_id", "parent"], "left").select("graph_id", F.col("node").alias("c"), F.col("parent").alias("up"), F.coalesce("m", F.lit(-1).cast("long")).alias("m")))
    # The k-th table points 2^k steps up, or to the seed, with the greatest w of what it passes and reaches.
    tables = [first]
    while not tables[-1].filter(F.col("up") != seed).isEmpty():
        further = tables[-1].select("graph_id", F.col("c").alias("up"), F.col("up").alias("up2"), F.col("m").alias("m2"))
        tables.append(kept(tables[-1].join(further, ["graph_id", "up"], "left").select("graph_id", "c", F.coalesce("up2", "up").alias("up"), F.greatest("m", "m2").alias("m"))))
    # As far up as all that is passed is lighter; something above is heavier, so never to the seed.
    for table in reversed(tables):
        at = kept(at.join(table, ["graph_id", "c"], "left").select("graph_id", "node", "w", F.when(F.col("m") < F.col("w"), F.col("up")).otherwise(F.col("c")).alias("c")))
    found = at.join(tree.select("graph_id", F.col("node").alias("c"), F.col("parent").alias("opener")), ["graph_id", "c"]).select("graph_id", "node", "w", "opener")
    return kept(lightest.unionByName(found))


def walk_steps(edges: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """graph_id, node_id, step: when each node joins, 0 for the seed, by growing with the earliest edge that has one end inside. Nodes out of the seed's reach are left out."""
    part = openers(rooted_tree(edges, seed, block), seed)
    pointers = kept(part.filter(F.col("opener") != seed).select("graph_id", F.col("node").alias("c"), F.col("opener").alias("up")))
    ways = [pointers]
    while not ways[-1].isEmpty():
        further = ways[-1].select("graph_id", F.col("c").alias("up"), F.col("up").alias("up2"))
        ways.append(kept(ways[-1].join(further, ["graph_id", "up"]).select("graph_id", "c", F.col("up2").alias("up"))))
    # The k-th round adds what lies between 2^k and 2^(k+1) steps below.
    sizes = part.select("graph_id", F.col("node").alias("c"), F.lit(1).cast("long").alias("n"))
    for way in ways[:-1]:
        more = way.join(sizes, ["graph_id", "c"]).groupBy("graph_id", "up").agg(F.sum("n").alias("more")).withColumnRenamed("up", "c")
        sizes = kept(sizes.join(more, ["graph_id", "c"], "left").select("graph_id", "c", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    sized = kept(part.join(sizes.withColumnRenamed("c", "node"), ["graph_id", "node"])) if len(ways) > 1 else part.withColumn("n", F.lit(1).cast("long"))
    # An edge has one place, so a range of places has few rows.
    steps = running_sum(sized, ["graph_id", "opener"], ["w"], "n", "before", inclusive=False, part=F.floor(F.col("w") / PLACES_AT_ONCE))
    steps = kept(steps.select("graph_id", F.col("node").alias("c"), (F.col("before") + 1).alias("step")))
    for way in ways[:-1]:
        above = way.join(steps.select("graph_id", F.col("c").alias("up"), F.col("step").alias("more")), ["graph_id", "up"]).select("graph_id", "c", "more")
        steps = kept(steps.join(above, ["graph_id", "c"], "left").select("graph_id", "c", (F.col("step") + F.coalesce("more", F.lit(0))).alias("step")))
    seeds = edges.filter((F.col("from_id") == seed) | (F.col("to_id") == seed)).select("graph_id").distinct().select("graph_id", F.lit(seed).cast("long").alias("node_id"), F.lit(0).cast("long").alias("step"))
    return steps.select("graph_id", F.col("c").alias("node_id"), "step").unionByName(seeds)
