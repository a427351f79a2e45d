"""Incremental solving of trajectories: gates, selective updates, full Gauss-Newton steps.

The edges of a graph come in batches. After each, the gain of information over the last increment and the loop-closure
flag decide whether all variables are solved for or the new ones only; iterations go on with the variables of nodes
that still move. A graph's increments depend on each other and run in one task; graphs run side by side. Small ones are run
by the same rule in Java (jvm/Increments.java), larger ones here.

A graph may diverge. A step after which the matrix has no factor, or that isn't finite, is taken back, and its increment is
`failed`: the state is the last that had a factor. Where it had none to begin with, half_logdet and di are null, the gate
counts a gain as none and no step is made. Later increments go on from that state, and other graphs are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphtide import jvm
from graphtide.operators import lockstep
from graphtide.operators.growth import LoopDetector, grown
from graphtide.operators.solver import CODES, Factor, Graph, trajectory_rmse

GATES = ("none", "IGG", "LCG")
#: Graphs of at most so many nodes go to Java, or in lockstep, as many at once; so many graphs or rows are read before they are cut into batches.
SMALL, SIDE_BY_SIDE = 256, 256
READ_GRAPHS, READ_ROWS = 8 * SIDE_BY_SIDE, 1 << 19


@dataclass(frozen=True)
class Config:
    gating: str = "IGG"
    #: Selective partial optimisation; otherwise full Gauss-Newton steps.
    selective: bool = True
    entropy_threshold: float = 1.0
    dx_threshold: float = 1e-3
    loop_gap: int = 4
    most_iterations: int = 10
    batch: int = 1

    def __post_init__(self) -> None:
        if self.gating not in GATES:
            raise ValueError(f"unknown gating: {self.gating}")


INCREMENTS = "it long, loop_closure boolean, half_logdet double, n_vars long, di double, gated boolean, skipped boolean, gn int, err double, ate_rmse double, update_flops double, failed boolean"
COLUMNS = ["it", "loop_closure", "half_logdet", "n_vars", "di", "gated", "skipped", "gn", "err", "ate_rmse", "update_flops", "failed"]


def build(nodes: pd.DataFrame, edges: pd.DataFrame, batch: int = 1) -> tuple[Graph, list[tuple[int, int]]]:
    """The graph with nodes in insertion order, and for each batch how many edges and nodes are in. Edges must be sorted by seq; batches bring nodes in by number."""
    known = {int(i): r for r, i in enumerate(nodes.node_id)}
    place: dict[int, int] = {}
    ends = [[int(a)] + ([] if pd.isna(b) else [int(b)]) for a, b in zip(edges.from_id, edges.to_id, strict=True)]
    sizes = []
    for at in range(0, len(ends), batch):
        for node in sorted({n for pair in ends[at : at + batch] for n in pair}):
            if node not in known:
                raise ValueError(f"an edge names node {node}, which the graph lacks")
            place.setdefault(node, len(place))
        sizes.append((min(len(ends), at + batch), len(place)))
    rows = nodes.iloc[[known[n] for n in place]]
    n = len(edges)
    w = np.zeros((n, 3, 3))
    for (i, j), name in {(0, 0): "i11", (0, 1): "i12", (0, 2): "i13", (1, 1): "i22", (1, 2): "i23", (2, 2): "i33"}.items():
        w[:, i, j] = w[:, j, i] = edges[name].to_numpy(dtype=float)
    kind = edges.type.map(CODES).to_numpy(dtype=np.int64)
    w[kind > 0, 2], w[kind > 0, :, 2] = 0, 0
    z = np.nan_to_num(edges[["z1", "z2", "z3"]].to_numpy(dtype=float))
    a = np.array([place[e[0]] for e in ends], dtype=np.int64)
    b = np.array([place[e[1]] if len(e) > 1 else -1 for e in ends], dtype=np.int64)
    x = np.nan_to_num(rows[["x", "y", "theta"]].to_numpy(dtype=float))
    return Graph(list(place), rows.dim, x, (kind, a, b, z, w)), sizes


def _factored(found) -> tuple:
    """What `found` gives and False, or None and True where the matrix has no factor or the numbers aren't finite."""
    try:
        with np.errstate(over="ignore", invalid="ignore"):
            out = found()
    except np.linalg.LinAlgError:
        return None, True
    return (out, False) if np.isfinite(out).all() else (None, True)


def run(nodes: pd.DataFrame, edges: pd.DataFrame, truth: pd.DataFrame | None, config: Config) -> tuple[list[tuple], Graph]:
    """One tuple for each increment, and the graph at its last state."""
    graph, sizes = build(nodes, edges, config.batch)
    detector = LoopDetector(config.loop_gap)
    stream = [(t, int(a), None if pd.isna(b) else int(b)) for t, a, b in zip(edges.type, edges.from_id, edges.to_id, strict=True)]
    real = {} if truth is None else {int(i): (x, y) for i, x, y in zip(truth.node_id, truth.x, truth.y, strict=True)}
    poses = np.array([i for i, (n, d) in enumerate(zip(graph.ids, graph.dims, strict=True)) if d == 3 and int(n) in real], dtype=np.int64)
    target = np.array([real[int(graph.ids[i])] for i in poses]).reshape(-1, 2)
    out, before, edges_in, nodes_in, factor = [], None, 0, 0, Factor(graph)
    for it, (n_edges, n_nodes) in enumerate(sizes, 1):
        closure = detector.batch(stream[edges_in:n_edges])
        factor.grow(n_edges)
        n_vars = int(graph.offset[n_nodes])
        logdet, failed = _factored(lambda: factor.half_logdet(n_vars))
        gain = None if failed else logdet - before[0] * n_vars / before[1] if before else 0.0
        before = before if failed else (logdet, n_vars)
        node, component = graph.layout(n_nodes)
        fire = {"none": True, "IGG": gain is not None and gain > config.entropy_threshold, "LCG": closure}[config.gating]
        columns = factor.filling(n_nodes)
        work, steps, skipped = float((columns[node >= nodes_in] ** 2).sum()), 0, False
        active = np.ones(n_vars, dtype=bool) if fire else node >= nodes_in if config.selective else np.zeros(n_vars, dtype=bool)
        skipped = config.selective and not active.any()
        moved = old = None
        for k in range(1, config.most_iterations + 1 if active.any() and not failed else 1):
            dx, failed = _factored(lambda: factor.solve(n_vars, int(np.argmax(active))))  # noqa: B023
            if failed:
                if moved is not None:
                    graph.x[moved] = old
                    factor.anew()
                    steps -= 1
                break
            far = np.abs(dx) > config.dx_threshold
            if not (active & far).any():
                break
            if config.selective:
                active = np.isin(node, np.unique(node[active & far]))
            moved = np.unique(node[active])
            old = graph.x[moved].copy()
            graph.step(node[active], component[active], dx[active])
            factor.moved(moved)
            work += float(min(2 * (columns[active] ** 2).sum(), (columns**2).sum())) if config.selective else float((columns**2).sum())
            steps = k
        else:
            # The last step's matrix isn't looked at before the next increment; it is taken back here.
            if moved is not None and _factored(lambda: factor.half_logdet(n_vars))[1]:
                graph.x[moved], failed = old, True
                factor.anew()
                steps -= 1
        edges_in, nodes_in = n_edges, n_nodes
        err = ate = None
        if not skipped:
            err = graph.chi2(n_edges) / max(1, graph.measurements(n_edges))
            inside = poses < n_nodes
            if truth is not None and inside.sum() >= 2:
                ate = trajectory_rmse(graph.x[poses[inside], :2], target[inside])
        out.append((it, bool(closure), logdet, n_vars, gain, bool(fire), skipped, steps, err, ate, work, failed))
    return out, graph


def _tagged(nodes: DataFrame, edges: DataFrame, truth: DataFrame | None) -> DataFrame:
    """Nodes, edges and truth in one table, so that one shuffle brings a graph's parts together."""
    kind = dict(edges.dtypes)["graph_id"]
    names = ["part", "a", "b", "type", "x", "y", "theta", "i11", "i12", "i13", "i22", "i23", "i33", "seq"]
    null = lambda t: F.lit(None).cast(t)
    infos = ["i11", "i12", "i13", "i22", "i23", "i33"]
    tables = [
        nodes.select("graph_id", F.lit(0).alias("part"), F.col("node_id").alias("a"), F.col("dim").cast("long").alias("b"), null("string").alias("type"), "x", "y", "theta", *[null("double").alias(i) for i in infos], null("long").alias("seq")),
        edges.select("graph_id", F.lit(1).alias("part"), F.col("from_id").alias("a"), F.col("to_id").alias("b"), "type", F.col("z1").alias("x"), F.col("z2").alias("y"), F.col("z3").alias("theta"), *infos, "seq"),
    ]
    if truth is not None:
        tables.append(truth.select("graph_id", F.lit(2).alias("part"), F.col("node_id").alias("a"), null("long").alias("b"), null("string").alias("type"), "x", "y", null("double").alias("theta"), *[null("double").alias(i) for i in infos], null("long").alias("seq")))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    assert out.columns == ["graph_id", *names] and kind
    return out


def _parts(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame | None]:
    nodes = pdf[pdf.part == 0].rename(columns={"a": "node_id", "b": "dim"}).sort_values("node_id")
    nodes = nodes.assign(dim=nodes.dim.astype(int))
    edges = pdf[pdf.part == 1].rename(columns={"a": "from_id", "b": "to_id", "x": "z1", "y": "z2", "theta": "z3"}).sort_values("seq")
    truth = pdf[pdf.part == 2].rename(columns={"a": "node_id"})
    return nodes, edges, truth if len(truth) else None


def _each(nodes: DataFrame, edges: DataFrame, truth: DataFrame | None, schema: str, work) -> DataFrame:
    """applyInPandas over graphs; `work` takes (nodes, edges, truth) and gives a pandas frame without graph_id."""
    kind = dict(edges.dtypes)["graph_id"]
    columns = ["graph_id", *[c.split()[0] for c in schema.split(", ")]]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = _parts(pdf)
        if not len(parts[1]):
            return pd.DataFrame(columns=columns)
        return work(*parts).assign(graph_id=key[0])[columns]

    rows = _tagged(nodes, edges, truth)
    # A graph's work is far larger than its bytes, by which small partitions would be merged; a stated number is kept.
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "graph_id").groupBy("graph_id").applyInPandas(one, f"graph_id {kind}, {schema}")


def run_many(parts: list[tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame | None]], config: Config, small: int = SMALL) -> list[list[tuple]]:
    """The tuples of `run` for each of the (nodes, edges, truth), small graphs side by side."""
    out: list[list[tuple]] = [[] for _ in parts]
    ready = []
    for i, (nodes, edges, truth) in enumerate(parts):
        if len(nodes) > small:
            out[i] = run(nodes, edges, truth, config)[0]
            continue
        graph, sizes = build(nodes, edges, config.batch)
        detector, at, closures = LoopDetector(config.loop_gap), 0, []
        stream = [(t, int(a), None if pd.isna(b) else int(b)) for t, a, b in zip(edges.type.tolist(), edges.from_id.tolist(), edges.to_id.tolist(), strict=True)]
        for end, _ in sizes:
            closures.append(detector.batch(stream[at:end]))
            at = end
        real = {} if truth is None else {int(n): (x, y) for n, x, y in zip(truth.node_id.tolist(), truth.x.tolist(), truth.y.tolist(), strict=True)}
        ready.append((int((graph.dims == 3).sum()), len(stream), i, (graph, sizes, closures, real)))
    # Graphs of one size waste the least.
    ready.sort(key=lambda r: r[:3])
    for at in range(0, len(ready), SIDE_BY_SIDE):
        some = ready[at : at + SIDE_BY_SIDE]
        for (_, _, i, _), rows in zip(some, lockstep.run([r[3] for r in some], config), strict=True):
            out[i] = rows
    return out


def increments(nodes: DataFrame, edges: DataFrame, truth: DataFrame | None = None, config: Config = Config()) -> DataFrame:  # noqa: B008
    """One row for each increment of each graph. Takes edges with information, and with seq; without, each graph's come in growth order. Skipped increments have null errors; of failed ones see above."""
    kind, grow = dict(edges.dtypes)["graph_id"], "seq" not in edges.columns
    tagged = _tagged(nodes, edges.withColumn("seq", F.col("edge_pos").cast("long")) if grow else edges, truth)
    names, spark = tagged.columns[1:], tagged.sparkSession
    rows = tagged.groupBy("graph_id").agg(F.collect_list(F.struct(*names)).alias("_rows"), F.count_if(F.col("part") == 0).alias("_nodes"))
    # A graph's work is far larger than its bytes, by which small partitions would be merged; a stated number is kept. By graph_id itself
    # Spark would take the graphs for dealt out already, in partitions that it merges, and make the tables once for each size of graph.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = rows.repartition(tasks, F.xxhash64("graph_id"))

    def graphs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole graphs, each graph's rows together."""
        starts = np.flatnonzero(np.diff(pd.factorize(pdf.graph_id, use_na_sentinel=False)[0], prepend=-1))
        parts, found = [], []
        for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
            part = _parts(pdf.iloc[a:b])
            if len(part[1]):
                parts.append((part[0], grown(part[1]) if grow else part[1], part[2]))
                found.append(pdf.graph_id.iloc[a])
        for name, made in zip(found, run_many(parts, config), strict=True):
            yield pd.DataFrame(made, columns=COLUMNS).astype({c: "Float64" for c in ("half_logdet", "di", "err", "ate_rmse")}).assign(graph_id=name)[["graph_id", *COLUMNS]]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count, seen = [], 0, 0
        for pdf in batches:
            held.append(pdf)
            count, seen = count + len(pdf), seen + pdf.graph_id.nunique()
            if count >= READ_ROWS or seen >= READ_GRAPHS:
                every = pd.concat(held, ignore_index=True)
                # The last graph may go on.
                same = pd.factorize(every.graph_id, use_na_sentinel=False)[0]
                end = int(np.searchsorted(same, same[-1]))
                if end:
                    yield from graphs(every.iloc[:end])
                held, count, seen = [every.iloc[end:]], len(every) - end, 1
        if count:
            yield from graphs(pd.concat(held, ignore_index=True))

    function = jvm.registered(spark, "Increments", f"array<struct<{INCREMENTS.replace(' ', ': ')}>>".replace(",: ", ", "))
    numbers = [GATES.index(config.gating), config.selective, config.entropy_threshold, config.dx_threshold, LoopDetector(config.loop_gap).gap, config.most_iterations, config.batch, grow]
    made = F.call_function(function, F.col("graph_id").cast("string"), "_rows", F.array(*[F.lit(float(v)) for v in numbers]))
    # Filters by size would go below the shuffle, which then were made twice; explode would add one that makes a graph's increments twice.
    sized = lambda rows_of, name: rows.select("graph_id", F.explode_outer(rows_of).alias(name)).filter(F.col(name).isNotNull()).select("graph_id", f"{name}.*")
    small, large = sized(F.when(F.col("_nodes") <= SMALL, made), "_i"), sized(F.when(F.col("_nodes") > SMALL, F.col("_rows")), "_r")
    return small.unionByName(large.mapInPandas(work, f"graph_id {kind}, {INCREMENTS}"))


def estimates(nodes: DataFrame, edges: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """graph_id, node_id, dim, x, y, theta after the last increment."""

    def work(n, e, t):
        graph = run(n, e, None, config)[1]
        theta = pd.array([x if d == 3 else None for x, d in zip(graph.x[:, 2].tolist(), graph.dims, strict=True)], dtype="Float64")
        return pd.DataFrame({"node_id": graph.ids, "dim": graph.dims, "x": graph.x[:, 0], "y": graph.x[:, 1], "theta": theta})

    return _each(nodes, edges, None, "node_id long, dim int, x double, y double, theta double", work)


def whitened3(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, edge_pos, r1, r2, r3 of P edges: residuals times the square root of the information, in Arrow batches."""
    from graphtide.operators.linearise import linearised
    from graphtide.operators.solver import whitening

    rows = linearised(edges.filter("type = 'P'"), nodes).select("graph_id", "edge_pos", "e1", "e2", "e3", "i11", "i12", "i13", "i22", "i23", "i33")

    def work(batches):
        for pdf in batches:
            w = pdf[["i11", "i12", "i13", "i12", "i22", "i23", "i13", "i23", "i33"]].to_numpy(dtype=float).reshape(-1, 3, 3)
            unique, which = np.unique(w.reshape(-1, 9), axis=0, return_inverse=True)
            roots = np.array([whitening(m.reshape(3, 3)) for m in unique]).reshape(-1, 3, 3)[which.ravel()]
            r = np.einsum("nij,nj->ni", roots, pdf[["e1", "e2", "e3"]].to_numpy(dtype=float)) if len(pdf) else np.zeros((0, 3))
            yield pdf[["graph_id", "edge_pos"]].assign(r1=r[:, 0], r2=r[:, 1], r3=r[:, 2])

    return rows.mapInPandas(work, f"graph_id {dict(edges.dtypes)['graph_id']}, edge_pos long, r1 double, r2 double, r3 double")
