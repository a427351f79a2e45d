"""How a graph grows by its edge stream: order, batches, new nodes, places in the state vector, incidence, loop closures."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphtide.operators.kept import kept, tasks_for
from graphtide.operators.prefix import numbered, running_sum
from graphtide.operators.spanning import walk_steps

LOOP_GAP = 5


# ---- order


def prim_steps(edges: list[tuple[int, str, int, int | None]], seed: int) -> dict[int, int]:
    """When each node joins, by growing from `seed` with the earliest edge that has one end inside: Prim's algorithm with the edge's place as weight. Edges are (place, type, from, to)."""
    near: dict[int, list[tuple[int, int]]] = {}
    for place, kind, a, b in edges:
        if kind != "G" and b is not None and a != b:
            near.setdefault(a, []).append((place, b))
            near.setdefault(b, []).append((place, a))
    steps, heap = {seed: 0}, list(near.get(seed, []))
    heapq.heapify(heap)
    while heap:
        _, node = heapq.heappop(heap)
        if node not in steps:
            steps[node] = len(steps)
            for item in near.get(node, []):
                if item[1] not in steps:
                    heapq.heappush(heap, item)
    return steps


STEPS = "graph_id long, node_id long, step long"


#: A graph with more edges is walked over tables.
WALKED = 1 << 17
#: Steps whose edges are numbered together.
STEPS_AT_ONCE = 1 << 14


def growth_steps(edges: DataFrame, seed: int = 0, walked: int = WALKED) -> DataFrame:
    """graph_id, node_id, step. A graph with at most `walked` edges is walked in one task, graphs being spread over the cluster; a larger one over tables, with equal steps. Fails for a graph without the seed node."""
    kind, picked = dict(edges.dtypes)["graph_id"], edges.select("graph_id", "edge_pos", "type", "from_id", "to_id")

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(p), t, int(a), None if pd.isna(b) else int(b)) for p, t, a, b in zip(pdf.edge_pos, pdf.type, pdf.from_id, pdf.to_id, strict=True)]
        if not any(seed in r[2:] for r in rows):
            raise ValueError(f"graph {key[0]} has no node {seed}")
        steps = prim_steps(rows, seed)
        return pd.DataFrame({"graph_id": key[0], "node_id": list(steps), "step": list(steps.values())})

    sizes = kept(picked.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("from_id") == seed) | F.coalesce(F.col("to_id") == seed, F.lit(False))).alias("seeded")))
    large = sizes.filter(F.col("n") > walked)
    grouped = lambda some: some.groupBy("graph_id").applyInPandas(walk, STEPS.replace("graph_id long", f"graph_id {kind}"))
    if large.isEmpty():
        return grouped(picked)
    without = large.filter("not seeded").first()
    if without:
        raise ValueError(f"graph {without['graph_id']} has no node {seed}")
    joining = picked.join(large, "graph_id", "left_semi").filter("type <> 'G' and from_id <> to_id")
    seeds = large.select("graph_id", F.lit(seed).cast("long").alias("node_id"), F.lit(0).cast("long").alias("step"))
    return kept(grouped(picked.join(large, "graph_id", "left_anti")).unionByName(walk_steps(joining, seed).filter("step > 0")).unionByName(seeds))


def growth_order(edges: DataFrame, seed: int = 0, steps: DataFrame | None = None) -> DataFrame:
    """`edges` with step, kind (growth or closure) and seq: each growing edge is followed by those that its node closes, in file order. Edges out of the seed's reach are left out."""
    steps = steps if steps is not None else growth_steps(edges, seed)
    at = lambda side: steps.select("graph_id", F.col("node_id").alias(f"{side}_id"), F.col("step").alias(f"s_{side}"))
    rows = edges.join(at("from"), ["graph_id", "from_id"]).join(at("to"), ["graph_id", "to_id"], "left").filter("type = 'G' or s_to is not null")
    # A growing edge is the earliest that reaches its later end from a node that joined before; it is the least by place among edges of that step.
    step = F.greatest(F.lit(1), F.col("s_from"), F.coalesce("s_to", "s_from"))
    grows = (F.col("type") != "G") & (F.col("s_from") != F.col("s_to"))
    first = F.min(F.when(F.col("_grows"), F.col("edge_pos"))).over(Window.partitionBy("graph_id", "_part", "step"))
    # Steps have none missing, so ranges of them are known. What is joined is read twice, so it is kept.
    rows = kept(rows.withColumn("step", step).withColumn("_grows", grows).drop("s_from", "s_to")).withColumn("_part", F.floor(F.col("step") / STEPS_AT_ONCE))
    totals = rows.groupBy("graph_id", "_part").agg(F.count(F.lit(1)).alias("_total"))
    before = Window.partitionBy("graph_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept(totals.select("graph_id", "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")))
    place = F.row_number().over(Window.partitionBy("graph_id", "_part").orderBy("step", F.col("kind") == "closure", "edge_pos"))
    dealt = rows.repartition("graph_id", "_part").withColumn("kind", F.when(F.col("_grows") & (F.col("edge_pos") == first), "growth").otherwise("closure"))
    return dealt.withColumn("_place", place).join(offsets, ["graph_id", "_part"]).select(*[c for c in rows.columns if c not in ("_part", "_grows")], "kind", (F.col("_place") + F.col("_before")).alias("seq"))


def grown(edges: pd.DataFrame, seed: int = 0) -> pd.DataFrame:
    """`edges` of one graph in the order of growth_order, for where a task holds the whole graph."""
    rows = [(int(p), t, int(a), None if pd.isna(b) else int(b)) for p, t, a, b in zip(edges.edge_pos if "edge_pos" in edges else edges.seq, edges.type, edges.from_id, edges.to_id, strict=True)]
    if not any(seed in r[2:] for r in rows):
        raise ValueError(f"a graph has no node {seed}")
    steps, first, found = prim_steps(rows, seed), {}, []
    for i, (place, kind, a, b) in enumerate(rows):
        if a in steps and (kind == "G" or b in steps):
            step, grows = max(1, steps[a], steps.get(b, 0)), kind != "G" and steps[a] != steps[b]
            found.append((step, place, i, grows))
            if grows:
                first[step] = min(first.get(step, place), place)
    return edges.iloc[[i for _, _, _, i in sorted((step, not grows or place != first[step], place, i) for step, place, i, grows in found)]]


def dropped_edges(edges: DataFrame, ordered: DataFrame) -> DataFrame:
    """Edges that growth doesn't reach."""
    return edges.join(ordered.select("graph_id", "edge_pos"), ["graph_id", "edge_pos"], "left_anti")


# ---- batches and state


def batches(edges: DataFrame, size: int = 1, seq: str = "edge_pos") -> DataFrame:
    """`edges` with it, the number of the batch from 1."""
    return edges.withColumn("it", (F.floor((F.col(seq) - 1) / size) + 1).cast("long"))


def endpoints(edges: DataFrame) -> DataFrame:
    """One row for each end of each edge, with place 0 or 1; a self-loop has two, a unary edge one."""
    ends = F.filter(F.array(F.struct(F.lit(0).alias("place"), F.col("from_id").alias("node_id")), F.struct(F.lit(1).alias("place"), F.col("to_id").alias("node_id"))), lambda e: e["node_id"].isNotNull())
    return edges.withColumn("_e", F.explode(ends)).select(*edges.columns, F.col("_e.place").alias("place"), F.col("_e.node_id").alias("node_id"))


def first_seen(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, node_id, first_it of each node that an edge names and the graph holds. Takes edges with `it`."""
    seen = endpoints(edges.select("graph_id", "it", "from_id", "to_id")).groupBy("graph_id", "node_id").agg(F.min("it").alias("first_it"))
    return seen.join(nodes.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi")


def state_offsets(seen: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, node_id, first_it, dim, offset: nodes take their places in the state vector as they come, by number within a batch."""
    rows = seen.join(nodes.select("graph_id", "node_id", "dim"), ["graph_id", "node_id"])
    return running_sum(rows, ["graph_id"], ["first_it", "node_id"], "dim", "offset", inclusive=False)


def variables(offsets: DataFrame) -> DataFrame:
    """graph_id, var (from 1), node_id."""
    return offsets.select("graph_id", F.explode(F.sequence(F.col("offset") + 1, F.col("offset") + F.col("dim"))).alias("var"), "node_id")


def incidence(edges: DataFrame) -> DataFrame:
    """graph_id, node_id, degree, and the places of the node's edges, each once."""
    return endpoints(edges.select("graph_id", "edge_pos", "from_id", "to_id")).groupBy("graph_id", "node_id").agg(F.count_distinct("edge_pos").alias("degree"), F.array_sort(F.collect_set("edge_pos")).alias("edge_list"))


def coordinates(nodes: DataFrame, dim: int) -> DataFrame:
    """Poses (dim 3) or landmarks (dim 2)."""
    return nodes.filter(F.col("dim") == dim)


# ---- loop closures


def pose_orders(edges: DataFrame, seq: str = "edge_pos", tasks: int | None = None) -> DataFrame:
    """graph_id, node_id, first (the edge that names the pose first), pose_order from 1. Every kind of edge names its first node, P edges their second too."""
    named = endpoints(edges).filter("place = 0 or type = 'P'")
    # Twice the edge's number and the place: plain numbers are summed up by hashing, structs only by sorting.
    named = named.select("graph_id", "node_id", (F.col(seq).cast("long") * 2 + F.col("place")).alias("m"))
    first = (named.repartition(tasks, "graph_id", "node_id") if tasks else named).groupBy("graph_id", "node_id").agg(F.min("m").alias("m"))
    return numbered(first, ["graph_id"], ["m"], "pose_order", tasks).select("graph_id", "node_id", F.floor(F.col("m") / 2).cast("long").alias("first"), "pose_order")


def pose_closures(edges: DataFrame, gap: int = LOOP_GAP, seq: str = "edge_pos") -> DataFrame:
    """graph_id, edge_pos, loop_closure of P edges, for batches of one edge: both poses named before, and their orders further apart than `gap`."""
    edges = kept(edges.select("graph_id", "type", "from_id", "to_id", *dict.fromkeys(["edge_pos", seq])))
    tasks = tasks_for(edges)
    orders = kept(pose_orders(edges, seq, tasks))
    at = lambda side: orders.select("graph_id", F.col("node_id").alias(f"{side}_id"), F.col("first").alias(f"f_{side}"), F.col("pose_order").alias(f"o_{side}"))
    rows = edges.filter("type = 'P'")
    for side in ("from", "to"):
        by = ["graph_id", f"{side}_id"]
        rows = rows.repartition(tasks, *by).join(at(side).repartition(tasks, *by), by)
    flag = (F.col("f_from") < F.col(seq)) & (F.col("f_to") < F.col(seq)) & (F.abs(F.col("o_from") - F.col("o_to")) > gap)
    return rows.select("graph_id", "edge_pos", flag.alias("loop_closure"))


def landmark_closures(edges: DataFrame, gap: int = LOOP_GAP, seq: str = "edge_pos") -> DataFrame:
    """graph_id, edge_pos, loop_closure of L edges: an earlier sight of the landmark that counts is further than `gap` away; a sight that closes a loop doesn't count later.

    Which sights count depends on earlier flags, so a landmark's sights are folded in order. The fold keeps their least and greatest order only, and streams over sorted partitions, so that no landmark's sights are gathered.
    """
    edges = kept(edges.select("graph_id", "type", "from_id", "to_id", *dict.fromkeys(["edge_pos", seq])))
    tasks, by = tasks_for(edges), ["graph_id", "from_id"]
    poses = pose_orders(edges, seq, tasks).select("graph_id", F.col("node_id").alias("from_id"), "pose_order")
    rows = edges.filter("type = 'L'").select("graph_id", "to_id", F.col(seq).alias("seq"), "edge_pos", "from_id").repartition(tasks, *by).join(poses.repartition(tasks, *by), by)
    dealt = rows.select("graph_id", "to_id", "seq", "edge_pos", "pose_order").repartition(tasks, "graph_id", "to_id").sortWithinPartitions("graph_id", "to_id", "seq")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, least, most = None, 0, 0
        for pdf in batches:
            flags = []
            for g, mark, order in zip(pdf.graph_id, pdf.to_id, pdf.pose_order, strict=True):
                if (g, mark) != key:
                    key, least, most, flag = (g, mark), order, order, False
                else:
                    flag = order - least > gap or most - order > gap
                    if not flag:
                        least, most = min(least, order), max(most, order)
                flags.append(flag)
            yield pdf[["graph_id", "edge_pos"]].assign(loop_closure=flags)

    return dealt.mapInPandas(fold, f"graph_id {dict(edges.dtypes)['graph_id']}, edge_pos long, loop_closure boolean")


class LoopDetector:
    """The rule for batches of any size, as a fold: a hit ends its batch, whose later edges are neither tested nor ordered."""

    def __init__(self, gap: int | float | None = None) -> None:
        self.gap = LOOP_GAP if gap is None or gap != gap or gap in (float("inf"), float("-inf")) else gap
        self.orders: dict[int, int] = {}
        self.marks: dict[int, tuple[int, int]] = {}

    def _order(self, node: int) -> int:
        return self.orders.setdefault(node, len(self.orders) + 1)

    def _self_loop(self, node: int) -> None:
        # Both ends are looked up before either is ordered, so the first sight by a self-loop takes two numbers.
        if node not in self.orders:
            self.orders[node] = len(self.orders) + 2
            self.orders[("gap", node)] = 0

    def batch(self, edges: list[tuple[str, int, int | None]]) -> bool:
        """Edges are (type, from, to)."""
        for kind, a, b in edges:
            if kind == "P":
                if a in self.orders and b in self.orders and abs(self.orders[a] - self.orders[b]) > self.gap:
                    return True
                if a == b:
                    self._self_loop(a)
                else:
                    self._order(a)
                    self._order(b)
            elif kind == "L":
                order = self._order(a)
                least, most = self.marks.get(b, (order, order))
                if order - least > self.gap or most - order > self.gap:
                    return True
                self.marks[b] = (min(least, order), max(most, order))
            elif kind == "G":
                self._order(a)
        return False


# ---- affected parts


def affected_variables(steps: DataFrame, offsets: DataFrame, threshold: float) -> DataFrame:
    """graph_id, var: all variables of nodes with a step beyond `threshold`. Takes steps (graph_id, var, dx)."""
    moved = steps.filter(F.abs("dx") > threshold).join(variables(offsets), ["graph_id", "var"]).select("graph_id", "node_id").distinct()
    return variables(offsets.join(moved, ["graph_id", "node_id"], "left_semi")).select("graph_id", "var")


def affected_edges(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """graph_id, edge_pos of edges with an end in `moved` (graph_id, node_id)."""
    return endpoints(edges.select("graph_id", "edge_pos", "from_id", "to_id")).join(moved, ["graph_id", "node_id"], "left_semi").select("graph_id", "edge_pos").distinct()
