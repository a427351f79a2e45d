"""Steps and determinants of graphs of any size: block elimination over tables.

The nodes of a graph, by number, are cut into ranges. Of each pair of neighbours in different ranges the one with more
such neighbours goes to the border, so that the others (a landmark's poses, say) can be eliminated range by range: in one
group each, H_II = LL' (by panels where its blocks lie near the diagonal, as a trajectory's do), the border gets the Schur complement -H_BI H_II^-1 H_IB, and what a range's solution needs of the border's is
kept as rows x_i = c_i - sum K_ib x_b. Complements of all ranges are added by grouped sums, and what is left is cut into
ranges again, until nothing is. Solutions come back from the last round to the first by a join and a grouped sum a round.

A group holds a range and the border nodes next to it. With borders that hardly shrink (dense graphs) ranges grow up to
LARGEST nodes; beyond, ArithmeticError names conjugate gradients (linsys), which need no elimination. A graph whose matrix has no
Cholesky factor gets nulls; others are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphtide.operators.growth import first_seen
from graphtide.operators.kept import kept
from graphtide.operators.linsys import G, H, system
from graphtide.operators.prefix import numbered

#: Nodes of a range at first and at most.
SIZE, LARGEST = 256, 2048
#: Nodes of a panel, at least.
PANEL = 8
#: Small graphs that are solved as one stack, and rows that a task reads before it solves them.
STACK, READ = 16, 1 << 17
V = [f"v{i}" for i in range(1, 10)]
#: What a range gives: blocks and gradients to be added to the border's, the solution's dependence on the border, its constant, the determinant.
BLOCK, SIDE, NEEDS, CONSTANT, DETERMINANT = range(5)
OUT = "kind int, a long, b long, " + ", ".join(f"{v} double" for v in V)


def _narrow(a: np.ndarray, b: np.ndarray, values: np.ndarray, rhs: np.ndarray, width: int, solve: bool) -> tuple[float, np.ndarray, np.ndarray | None]:
    """Half the log determinant of H, L^-1 rhs and, if asked for, H^-1 rhs, where blocks reach at most `width` nodes to the side (a <= b): panels of `width` nodes are only coupled with their neighbours."""
    n, size, three = len(rhs) // 3, 3 * width, np.arange(3)
    panels = -(-n // width)
    own, next_ = np.zeros((panels, width, 3, width, 3)), np.zeros((panels, width, 3, width, 3))

    def put(into, panel, rows, columns, what):
        np.add.at(into, (panel[:, None, None], rows[:, None, None], three[None, :, None], columns[:, None, None], three[None, None, :]), what)

    (k, i), (m, j) = np.divmod(a, width), np.divmod(b, width)
    same, off = k == m, (k == m) & (a != b)
    put(own, k[same], i[same], j[same], values[same])
    put(own, k[off], j[off], i[off], values[off].transpose(0, 2, 1))
    put(next_, k[~same], i[~same], j[~same], values[~same])
    own, next_ = own.reshape(panels, size, size), next_.reshape(panels, size, size)
    # A landmark's third row is empty, and so are the rows beyond the last node.
    d, at = np.arange(size), np.arange(panels * size).reshape(panels, size)
    own[:, d, d] = np.where((own[:, d, d] == 0) & ((d % 3 == 2) | (at >= 3 * n)), 1, own[:, d, d])
    y = np.zeros((panels, size, rhs.shape[1]))
    y.reshape(panels * size, -1)[: 3 * n] = rhs
    lowers, along, logdet = np.empty_like(own), np.empty_like(own), 0.0
    for k in range(panels):
        lowers[k] = np.linalg.cholesky(own[k])
        logdet += float(np.log(np.diagonal(lowers[k])).sum())
        done = np.linalg.solve(lowers[k], np.concatenate([next_[k], y[k]], axis=1))
        along[k], y[k] = done[:, :size], done[:, size:]
        if k + 1 < panels:
            own[k + 1] -= along[k].T @ along[k]
            y[k + 1] -= along[k].T @ y[k]
    back = np.empty_like(y) if solve else None
    for k in reversed(range(panels if solve else 0)):
        back[k] = np.linalg.solve(lowers[k].T, y[k] - along[k] @ back[k + 1] if k + 1 < panels else y[k])
    whole = lambda t: t.reshape(panels * size, -1)[: 3 * n]
    return logdet, whole(y), whole(back) if solve else None


def _dense(a: np.ndarray, b: np.ndarray, values: np.ndarray, rhs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """What _narrow gives, by one matrix."""
    n, three = len(rhs), np.arange(3)
    h = np.zeros((n, n))
    rows, columns = (lambda x, y: (3 * x[:, None, None] + three[None, :, None], 3 * y[:, None, None] + three[None, None, :])), a != b
    np.add.at(h, rows(a, b), values)
    np.add.at(h, rows(b[columns], a[columns]), values[columns].transpose(0, 2, 1))
    # A landmark's third row is empty.
    third = np.arange(2, n, 3)
    empty = third[h[third, third] == 0]
    h[empty, empty] = 1
    lower = np.linalg.cholesky(h)
    solved = np.linalg.solve(lower, rhs)
    return float(np.log(np.diagonal(lower)).sum()), solved, np.linalg.solve(lower.T, solved)


def _eliminated(pdf: pd.DataFrame, solve: bool = True) -> pd.DataFrame:
    """One range: rows of blocks (a, b, values, whether a and b are inner) and of gradients (b null). Without `solve` only what later determinants need."""
    sides = pdf[pdf.b.isna()]
    blocks = pdf[~pdf.b.isna()]
    a, b = blocks.a.to_numpy(np.int64), blocks.b.to_numpy(np.int64)
    a_in, b_in = blocks.a_in.to_numpy(bool), blocks.b_in.to_numpy(bool)
    inner = np.unique(np.concatenate([a[a_in], b[b_in]]))
    border = np.unique(np.concatenate([a[~a_in], b[~b_in]]))
    n, m = 3 * len(inner), 3 * len(border)
    # Columns of the border's nodes, and the gradient.
    rhs, values, three = np.zeros((n, m + 1)), blocks[V].to_numpy(float).reshape(-1, 3, 3), np.arange(3)

    def put(rows, columns, what):
        np.add.at(rhs, (3 * rows[:, None, None] + three[None, :, None], 3 * columns[:, None, None] + three[None, None, :]), what)

    left, right, both = a_in & ~b_in, b_in & ~a_in, a_in & b_in
    put(np.searchsorted(inner, a[left]), np.searchsorted(border, b[left]), values[left])
    put(np.searchsorted(inner, b[right]), np.searchsorted(border, a[right]), values[right].transpose(0, 2, 1))
    rhs[:, m].reshape(-1, 3)[np.searchsorted(inner, sides.a.to_numpy(np.int64))] = sides[V[:3]].to_numpy(float)
    ia, ib = np.searchsorted(inner, a[both]), np.searchsorted(inner, b[both])
    width = max(PANEL, int(np.abs(ia - ib).max(initial=0)))
    try:
        logdet, solved, back = _narrow(ia, ib, values[both], rhs, width, solve) if 4 * width <= len(inner) else _dense(ia, ib, values[both], rhs)
    except np.linalg.LinAlgError:
        logdet, solved, back = np.nan, np.full((n, m + 1), np.nan), np.full((n, m + 1), np.nan)
    w, y = solved[:, :-1], solved[:, -1]

    def rows(kind, a, b, values):
        whole = np.full((len(values), 9), np.nan)
        whole[:, : values.shape[1]] = values
        return np.full(len(values), kind), np.asarray(a, np.int64), np.full(len(values), -1) if b is None else b, np.full(len(values), b is None), whole

    i, j = np.triu_indices(len(border))
    complement = -(w.T @ w).reshape(len(border), 3, len(border), 3).transpose(0, 2, 1, 3)[i, j].reshape(-1, 9)
    out = [rows(DETERMINANT, [0], None, np.array([[logdet]]))]
    if len(border):
        out += [rows(BLOCK, border[i], border[j], complement), rows(SIDE, border, None, -(w.T @ y).reshape(-1, 3))]
    if solve:
        out.append(rows(CONSTANT, inner, None, back[:, -1].reshape(-1, 3)))
        p, q = np.repeat(np.arange(len(inner)), len(border)), np.tile(np.arange(len(border)), len(inner))
        out.append(rows(NEEDS, inner[p], border[q], back[:, :-1].reshape(len(inner), 3, len(border), 3).transpose(0, 2, 1, 3).reshape(-1, 9)))
    kind, a, b, alone, whole = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame(whole, columns=V).assign(kind=kind, a=a, b=pd.arrays.IntegerArray(b.astype(np.int64), alone))


def _together(pdf: pd.DataFrame, group: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """_eliminated of ranges without a border, stacked: `group` numbers the rows' ranges, in ascending order. (range of each row, rows)."""
    side = pdf.b.isna().to_numpy()
    a = pdf.a.to_numpy(np.int64)
    own = np.flatnonzero(~side & (pdf.b.to_numpy(float) == a))
    own = own[np.lexsort((a[own], group[own]))]
    of, node = group[own], a[own]
    starts = np.searchsorted(of, np.arange(int(group[-1]) + 2))
    sizes, place = np.diff(starts), np.arange(len(own)) - starts[of]
    order = np.lexsort((node, of))
    names, values = pd.MultiIndex.from_arrays([of[order], node[order]]), pdf[V].to_numpy(float)
    at = lambda rows, ids: place[order[names.get_indexer(pd.MultiIndex.from_arrays([group[rows], ids]))]]
    blocks, sides = np.flatnonzero(~side), np.flatnonzero(side)
    row, column, side_row = at(blocks, a[blocks]), at(blocks, pdf.b.to_numpy(float)[blocks].astype(np.int64)), at(sides, a[sides])
    block_of, side_of, three = group[blocks], group[sides], np.arange(3)
    solved, logdet = np.full((len(own), 3), np.nan), np.full(len(sizes), np.nan)
    by_size = np.argsort(sizes, kind="stable")
    for at_ in range(0, len(by_size), STACK):
        some = by_size[at_ : at_ + STACK]
        most = int(sizes[some].max())
        stacked = np.full(len(sizes), -1)
        stacked[some] = np.arange(len(some))
        h, g = np.zeros((len(some), most, 3, most, 3)), np.zeros((len(some), most, 3))
        mine = np.flatnonzero(stacked[block_of] >= 0)
        q, i, j, m = stacked[block_of[mine]], row[mine], column[mine], values[blocks[mine]].reshape(-1, 3, 3)
        h[q[:, None, None], i[:, None, None], three[:, None], j[:, None, None], three] = m
        off = i != j
        h[q[off][:, None, None], j[off][:, None, None], three[:, None], i[off][:, None, None], three] = m[off].transpose(0, 2, 1)
        mine = np.flatnonzero(stacked[side_of] >= 0)
        g[stacked[side_of[mine]], side_row[mine]] = values[sides[mine], :3]
        n = 3 * most
        h, g, d = h.reshape(-1, n, n), g.reshape(-1, n), np.arange(n)
        # A landmark's third row is empty, and so are rows beyond a range's nodes.
        h[:, d, d] = np.where((h[:, d, d] == 0) & ((d % 3 == 2) | (d >= 3 * sizes[some][:, None])), 1, h[:, d, d])
        good = np.ones(len(some), dtype=bool)
        try:
            lower = np.linalg.cholesky(h)
        except np.linalg.LinAlgError:
            lower = np.zeros_like(h)
            for k in range(len(some)):
                try:
                    lower[k] = np.linalg.cholesky(h[k])
                except np.linalg.LinAlgError:
                    good[k], h[k], lower[k] = False, np.eye(n), np.eye(n)
        x = np.linalg.solve(h, g[:, :, None])[:, :, 0]
        x[~good] = np.nan
        logdet[some] = np.where(good, np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1), np.nan)
        mine = np.flatnonzero(stacked[of] >= 0)
        solved[mine] = x.reshape(len(some), most, 3)[stacked[of[mine]], place[mine]]
    whole = np.full((len(own) + len(sizes), 9), np.nan)
    whole[: len(own), :3], whole[len(own) :, 0] = solved, logdet
    rows = pd.DataFrame(whole, columns=V).assign(kind=np.repeat([CONSTANT, DETERMINANT], [len(own), len(sizes)]), a=np.concatenate([node, np.zeros(len(sizes), dtype=np.int64)]), b=pd.array([None] * len(whole), dtype="Int64"))
    return np.concatenate([of, np.arange(len(sizes))]), rows


def _whole_graphs(tagged: DataFrame, graph: str) -> DataFrame:
    """What _ranges_done gives where each graph is a range: a task reads many graphs and solves those of like size stacked."""
    names = ["graph_id", "kind", "a", "b", *V]

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        group, keys = pd.factorize(pdf.graph_id, use_na_sentinel=False)
        of, rows = _together(pdf, group)
        return rows.assign(graph_id=pd.Series(keys).take(of).to_numpy())[names]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for pdf in batches:
            held.append(pdf)
            count += len(pdf)
            if count >= READ:
                every = pd.concat(held, ignore_index=True)
                # The last graph may go on.
                end = int((every.graph_id.ne(every.graph_id.shift()) & ~(every.graph_id.isna() & every.graph_id.shift().isna())).to_numpy().nonzero()[0][-1])
                if end:
                    yield some(every.iloc[:end].reset_index(drop=True))
                held, count = [every.iloc[end:]], len(every) - end
        if count:
            yield some(pd.concat(held, ignore_index=True))

    spark = tagged.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return kept(tagged.select("graph_id", "a", "b", *V).repartition(tasks, "graph_id").sortWithinPartitions("graph_id").mapInPandas(work, f"graph_id {graph}, {OUT}"))


@dataclass(frozen=True)
class Elimination:
    """Of each round, what its nodes need of later ones (graph_id, node, via, v1..v9) and their constants (graph_id, node, v1..v3); and the graphs' determinants."""

    rounds: list[tuple[DataFrame, DataFrame]]
    #: graph_id, n_nodes, half_logdet (null without a factor)
    determinants: DataFrame

    def solution(self, wanted: DataFrame | None = None) -> DataFrame:
        """graph_id, node_id, dx1, dx2, dx3 with H dx = g, of all nodes or of the `wanted` (graph_id, node_id). Then only what they need, and what that needs, is solved for."""
        asked = None if wanted is None else kept(wanted.select("graph_id", F.col("node_id").alias("node")).distinct())
        reach = asked
        if asked is not None:
            for needs, _ in self.rounds:
                more = needs.join(reach, ["graph_id", "node"], "left_semi").select("graph_id", F.col("via").alias("node"))
                reach = kept(reach.unionByName(more).distinct())
        found = None
        for needs, constants in reversed(self.rounds):
            if reach is not None:
                needs, constants = (t.join(reach, ["graph_id", "node"], "left_semi") for t in (needs, constants))
            now = constants.select("graph_id", "node", *[F.col(f"v{i}").alias(f"x{i}") for i in (1, 2, 3)])
            if found is not None:
                at = needs.join(found.withColumnRenamed("node", "via"), ["graph_id", "via"])
                less = [-(F.col(f"v{3 * i + 1}") * F.col("x1") + F.col(f"v{3 * i + 2}") * F.col("x2") + F.col(f"v{3 * i + 3}") * F.col("x3")) for i in range(3)]
                parts = now.unionByName(at.select("graph_id", "node", *[c.alias(f"x{i + 1}") for i, c in enumerate(less)]))
                now = found.unionByName(parts.groupBy("graph_id", "node").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in (1, 2, 3)]))
            found = kept(now)
        if asked is not None:
            found = found.join(asked, ["graph_id", "node"], "left_semi")
        return found.select("graph_id", F.col("node").alias("node_id"), *[F.nanvl(f"x{i}", F.lit(None).cast("double")).alias(f"dx{i}") for i in (1, 2, 3)])


def _tagged(blocks: DataFrame, sides: DataFrame) -> DataFrame:
    return blocks.select("graph_id", "range", "a", "b", "a_in", "b_in", *V).unionByName(sides.select("graph_id", "range", "a", "a_in", *V[:3]), allowMissingColumns=True)


def _ranges_done(tagged: DataFrame, graph: str, solve: bool) -> DataFrame:
    names = ["graph_id", "kind", "a", "b", *V]
    # A range's work is far larger than its bytes, by which small partitions would be merged.
    spark = tagged.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return kept(tagged.repartition(tasks, "graph_id", "range").groupBy("graph_id", "range").applyInPandas(lambda key, pdf: _eliminated(pdf, solve).assign(graph_id=key[0])[names], f"graph_id {graph}, {OUT}"))


def _kept_for_later(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    return made.filter(F.col("kind") == NEEDS).select("graph_id", F.col("a").alias("node"), F.col("b").alias("via"), *V), made.filter(F.col("kind") == CONSTANT).select("graph_id", F.col("a").alias("node"), *V[:3])


def _determinants(n_nodes: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    if not rounds:
        return n_nodes.withColumn("half_logdet", F.lit(None).cast("double"))
    every = reduce(DataFrame.unionByName, [made.filter(F.col("kind") == DETERMINANT).select("graph_id", "v1") for made in rounds])
    return n_nodes.join(every.groupBy("graph_id").agg(F.nanvl(F.sum("v1"), F.lit(None).cast("double")).alias("half_logdet")), "graph_id")


def eliminate(blocks: DataFrame, gradient: DataFrame, size: int = SIZE, written: bool = False, solve: bool = True) -> Elimination:
    """Without `solve` there are determinants only. Takes blocks (graph_id, row_node, col_node, h11..h33; row_node <= col_node) and gradient (graph_id, node_id, g1..g3), as linsys makes them; `written`: both are read from kept tables. Each node must have a block of its own."""
    graph = dict(blocks.dtypes)["graph_id"]
    left = blocks.select("graph_id", F.col("row_node").alias("a"), F.col("col_node").alias("b"), *[F.col(h).alias(v) for h, v in zip(H, V, strict=True)])
    left = left if written else kept(left)
    sides = gradient.select("graph_id", F.col("node_id").alias("a"), *[F.col(g).alias(v) for g, v in zip(G, V, strict=False)])
    n_nodes = kept(left.filter("a = b").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes")))
    most = n_nodes.agg(F.sum("n_nodes").alias("all"), F.max("n_nodes").alias("one")).first()
    count = most["all"] or 0
    if count and most["one"] <= size:
        # Each graph is a range.
        made = _whole_graphs(left.unionByName(sides, allowMissingColumns=True), graph)
        return Elimination([_kept_for_later(made)], _determinants(n_nodes, [made]))
    rounds = []
    while count:
        ranges = numbered(left.filter("a = b").select("graph_id", F.col("a").alias("node")), ["graph_id"], ["node"], "rank").select("graph_id", "node", F.floor((F.col("rank") - 1) / size).alias("range"))
        ranges = kept(ranges)
        side_of = lambda end: ranges.select("graph_id", F.col("node").alias(end), F.col("range").alias(f"r{end}"))  # noqa: B023, E731
        placed = kept(left.join(side_of("a"), ["graph_id", "a"]).join(side_of("b"), ["graph_id", "b"]))
        crossing = placed.filter("ra <> rb").select("graph_id", "a", "b")
        degree = crossing.select("graph_id", F.explode(F.array("a", "b")).alias("node")).groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("d"))
        degree = kept(degree)
        of = lambda end: degree.select("graph_id", F.col("node").alias(end), F.col("d").alias(f"d{end}"))  # noqa: B023, E731
        chosen = F.when((F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") > F.col("b"))), F.col("a")).otherwise(F.col("b"))
        border = kept(crossing.join(of("a"), ["graph_id", "a"]).join(of("b"), ["graph_id", "b"]).select("graph_id", chosen.alias("node")).distinct())
        out = lambda end: border.select("graph_id", F.col("node").alias(end), F.lit(False).alias(f"{end}_in"))  # noqa: B023, E731
        marked = placed.join(out("a"), ["graph_id", "a"], "left").join(out("b"), ["graph_id", "b"], "left").withColumns({"a_in": F.coalesce("a_in", F.lit(True)), "b_in": F.coalesce("b_in", F.lit(True))})
        marked = kept(marked)
        gone = marked.filter("a_in or b_in").withColumn("range", F.when(F.col("a_in"), F.col("ra")).otherwise(F.col("rb")))
        known = kept(sides.join(side_of("a"), ["graph_id", "a"]).withColumnRenamed("ra", "range").join(out("a"), ["graph_id", "a"], "left").withColumn("a_in", F.coalesce("a_in", F.lit(True))))
        made = _ranges_done(_tagged(gone, known.filter("a_in")), graph, solve)
        rounds.append(made)
        rest = border.count()
        if rest * 2 > count:
            if size >= LARGEST and rest == count:
                raise ArithmeticError(f"{rest} nodes can't be cut into ranges of {size}; conjugate gradients solve such graphs")
            size = min(2 * size, LARGEST)
        count = rest
        if count:
            total = lambda df, by, values: df.groupBy("graph_id", *by).agg(*[F.sum(v).alias(v) for v in values])
            left = kept(total(marked.filter("not a_in and not b_in").select("graph_id", "a", "b", *V).unionByName(made.filter(F.col("kind") == BLOCK).select("graph_id", "a", "b", *V)), ["a", "b"], V))
            sides = kept(total(known.filter("not a_in").select("graph_id", "a", *V[:3]).unionByName(made.filter(F.col("kind") == SIDE).select("graph_id", "a", *V[:3])), ["a"], V[:3]))
    return Elimination([_kept_for_later(made) for made in rounds], _determinants(n_nodes, rounds))


# ---- of edges beside states


def steps(nodes: DataFrame, edges: DataFrame, size: int = SIZE) -> DataFrame:
    """graph_id, node_id, dx1, dx2, dx3: one Gauss-Newton step over all edges (to be subtracted)."""
    return eliminate(*system(edges, nodes), size, written=True).solution()


def newest_steps(nodes: DataFrame, edges: DataFrame, newest: int = 5, size: int = SIZE) -> DataFrame:
    """The step of each graph's last `newest` nodes alone, by what they need of the elimination. Nodes come with the edges in order of edge_pos, those of one edge by number."""
    seen = first_seen(edges.withColumn("it", F.col("edge_pos")), nodes)
    # All but the last few of each range of nodes are left behind before a graph's last ones meet.
    last = Window.partitionBy("graph_id").orderBy(F.desc("first_it"), F.desc("node_id"))
    wanted = seen.withColumn("back", F.row_number().over(last)).filter(F.col("back") <= newest)
    return eliminate(*system(edges, nodes), size, written=True).solution(wanted)


def log_determinants(nodes: DataFrame, edges: DataFrame, size: int = SIZE) -> DataFrame:
    """graph_id, n_vars, half_logdet over all edges at the given states."""
    found = eliminate(*system(edges, nodes), size, written=True, solve=False).determinants
    dims = first_seen(edges.withColumn("it", F.lit(1)), nodes).join(nodes.select("graph_id", "node_id", "dim"), ["graph_id", "node_id"]).groupBy("graph_id").agg(F.sum("dim").cast("long").alias("n_vars"))
    return dims.join(found, "graph_id").select("graph_id", "n_vars", "half_logdet")
