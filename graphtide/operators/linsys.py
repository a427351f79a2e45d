"""Block normal equations by grouped sums, and a distributed solver for one large graph.

H = sum J'WJ and g = sum J'We over edges; every edge adds up to three 3 x 3 blocks (the lower one is the transpose of the
upper) and two 3-vectors, summed with map-side combining. Landmarks use the first two rows and columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.functions import geometry as geo
from graphtide.operators.kept import checkpointed, kept_in_small_methods
from graphtide.operators.linearise import linearised, weights

H = [f"h{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
G = ["g1", "g2", "g3"]


def _matrix(prefix: str) -> geo.Matrix:
    return [[F.col(f"{prefix}{i}{j}") for j in (1, 2, 3)] for i in (1, 2, 3)]


def _block(row: str, col: str, m: geo.Matrix) -> Column:
    return F.struct(F.col(row).alias("row_node"), F.col(col).alias("col_node"), *[m[i][j].alias(H[3 * i + j]) for i in range(3) for j in range(3)])


def _weighted(edges: DataFrame, nodes: DataFrame, spread: bool = False) -> DataFrame:
    """linearised, with WA and WB and We once each as columns p.., q.., w.."""
    rows, w = linearised(edges, nodes, spread), weights()
    wa, wb = geo.multiply(w, _matrix("a")), geo.multiply(w, _matrix("b"))
    we = geo.multiply(w, [[F.col(f"e{i}")] for i in (1, 2, 3)])
    return rows.withColumns({f"p{i + 1}{j + 1}": wa[i][j] for i in range(3) for j in range(3)} | {f"q{i + 1}{j + 1}": wb[i][j] for i in range(3) for j in range(3)} | {f"w{i + 1}": we[i][0] for i in range(3)})


def first_nodes(edges: DataFrame) -> DataFrame:
    """graph_id, node_id of the first edge's lesser node: the one that is inserted first and carries the anchor."""
    first = edges.groupBy("graph_id").agg(F.min_by(F.least("from_id", F.coalesce("to_id", "from_id")), "edge_pos").alias("node_id"))
    return first


def _anchored(parts: DataFrame, edges: DataFrame) -> DataFrame:
    one = lambda k: F.lit(1.0 if k in ("h11", "h22", "h33") else 0.0).alias(k)
    return parts.unionByName(first_nodes(edges).select("graph_id", F.col("node_id").alias("row_node"), F.col("node_id").alias("col_node"), *[one(k) for k in H]))


def _block_parts() -> Column:
    """An edge's blocks."""
    a, b = geo.transpose(_matrix("a")), geo.transpose(_matrix("b"))
    aa, bb, ab, ba = geo.multiply(a, _matrix("p")), geo.multiply(b, _matrix("q")), geo.multiply(a, _matrix("q")), geo.multiply(b, _matrix("p"))
    both = F.col("to_id").isNotNull() & (F.col("to_id") != F.col("from_id"))
    upper = F.col("from_id") < F.col("to_id")
    mixed = F.when(upper, _block("from_id", "to_id", ab)).otherwise(_block("to_id", "from_id", ba))
    summed = [[aa[i][j] + ab[i][j] + ba[i][j] + bb[i][j] for j in range(3)] for i in range(3)]
    return F.when(both, F.array(_block("from_id", "from_id", aa), mixed, _block("to_id", "to_id", bb))).when(F.col("to_id").isNull(), F.array(_block("from_id", "from_id", aa))).otherwise(F.array(_block("from_id", "from_id", summed)))


def normal_blocks(edges: DataFrame, nodes: DataFrame, anchor: bool = True) -> DataFrame:
    """graph_id, row_node, col_node, h11..h33 for row_node <= col_node. The anchor adds the identity to the first node's block."""
    parts = _weighted(edges, nodes).select("graph_id", F.explode(_block_parts()).alias("b")).select("graph_id", "b.*")
    if anchor:
        parts = _anchored(parts, edges)
    return parts.groupBy("graph_id", "row_node", "col_node").agg(*[F.sum(k).alias(k) for k in H])


def gradient_blocks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, node_id, g1..g3."""
    rows = _weighted(edges, nodes)
    we = [[F.col(f"w{i}")] for i in (1, 2, 3)]
    part = lambda node, m: F.struct(F.col(node).alias("node_id"), *[x[0].alias(k) for k, x in zip(G, geo.multiply(geo.transpose(_matrix(m)), we), strict=True)])
    both = F.when(F.col("to_id").isNull(), F.array(part("from_id", "a"))).otherwise(F.array(part("from_id", "a"), part("to_id", "b")))
    return rows.select("graph_id", F.explode(both).alias("g")).select("graph_id", "g.*").groupBy("graph_id", "node_id").agg(*[F.sum(k).alias(k) for k in G])


def system(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """normal_blocks and gradient_blocks by one pass over the edges, kept; a gradient goes along as a block without column."""
    we = [[F.col(f"w{i}")] for i in (1, 2, 3)]
    rest, none = [F.lit(0.0).alias(k) for k in H[3:]], F.lit(None).cast(dict(edges.dtypes)["from_id"]).alias("col_node")
    side = lambda node, m: F.struct(F.col(node).alias("row_node"), none, *[x[0].alias(k) for k, x in zip(H, geo.multiply(geo.transpose(_matrix(m)), we), strict=False)], *rest)
    sides = F.when(F.col("to_id").isNull(), F.array(side("from_id", "a"))).otherwise(F.array(side("from_id", "a"), side("to_id", "b")))
    parts = _weighted(edges, nodes, spread=True).select("graph_id", F.explode(F.concat(_block_parts(), sides)).alias("b")).select("graph_id", "b.*")
    made = kept_in_small_methods(_anchored(parts, edges).groupBy("graph_id", "row_node", "col_node").agg(*[F.sum(k).alias(k) for k in H]))
    gradient = made.filter("col_node is null").select("graph_id", F.col("row_node").alias("node_id"), *[F.col(h).alias(g) for h, g in zip(H, G, strict=False)])
    return made.filter("col_node is not null"), gradient


def image(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """graph_id, node_id, q1..q3: H times the vectors (graph_id, node_id, dx1..dx3), H as normal_blocks gives it."""
    off = blocks.filter("row_node <> col_node")
    whole = blocks.unionByName(off.select("graph_id", F.col("col_node").alias("row_node"), F.col("row_node").alias("col_node"), *[F.col(f"h{j}{i}").alias(f"h{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)]))
    product = geo.multiply(_matrix("h"), [[F.col(f"dx{i}")] for i in (1, 2, 3)])
    at = vectors.select("graph_id", F.col("node_id").alias("col_node"), "dx1", "dx2", "dx3")
    return whole.join(at, ["graph_id", "col_node"]).groupBy("graph_id", F.col("row_node").alias("node_id")).agg(*[F.sum(product[i][0]).alias(f"q{i + 1}") for i in range(3)])


# ---- preconditioned conjugate gradients over tables


def _inverse3(m: geo.Matrix) -> geo.Matrix:
    """Of a symmetric 3 x 3 matrix; a landmark's empty last row and column count as those of the identity."""
    flat = (m[2][2] == 0) & (m[0][2] == 0) & (m[1][2] == 0)
    n = [[m[i][j] if (i, j) != (2, 2) else F.when(flat, F.lit(1.0)).otherwise(m[2][2]) for j in range(3)] for i in range(3)]
    minor = lambda i, j: n[(i + 1) % 3][(j + 1) % 3] * n[(i + 2) % 3][(j + 2) % 3] - n[(i + 1) % 3][(j + 2) % 3] * n[(i + 2) % 3][(j + 1) % 3]
    det = n[0][0] * minor(0, 0) + n[0][1] * minor(0, 1) + n[0][2] * minor(0, 2)
    return [[minor(j, i) / det for j in range(3)] for i in range(3)]


def conjugate_gradients(blocks: DataFrame, gradient: DataFrame, tolerance: float = 1e-9, most: int | None = None) -> DataFrame:
    """graph_id, node_id, dx1..dx3, residual with H dx = g for each graph, by block-Jacobi preconditioned conjugate gradients.

    Each graph has its own step lengths and rests once |r| <= tolerance |g|; steps go on until all do. ArithmeticError if
    H is not positive definite, or if the worst graph has not come nearer in as many steps as it can have unknowns. With
    `most`, what is reached after so many steps is returned. residual is |g - H dx| / |g| of the graph, computed anew from dx.
    A step is one join of the blocks with the direction and grouped sums; a few numbers go to the driver. Each step's vectors are checkpointed, so that a lost executor costs one step.
    """
    off = blocks.filter("row_node <> col_node")
    whole = checkpointed(blocks.unionByName(off.select("graph_id", F.col("col_node").alias("row_node"), F.col("row_node").alias("col_node"), *[F.col(f"h{j}{i}").alias(f"h{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)])))
    inv = _inverse3(_matrix("h"))
    diagonal = whole.filter("row_node = col_node").select("graph_id", F.col("row_node").alias("node_id"), *[inv[i][j].alias(f"v{i + 1}{j + 1}") for i in range(3) for j in range(3)])
    zs = geo.multiply(_matrix("v"), [[F.col(f"r{i}")] for i in (1, 2, 3)])
    with_z = {f"z{i + 1}": zs[i][0] for i in range(3)}
    dot = lambda a, b: sum((F.col(f"{a}{i}") * F.col(f"{b}{i}") for i in (2, 3)), F.col(f"{a}1") * F.col(f"{b}1"))
    total = lambda df, **columns: df.groupBy("graph_id").agg(*[F.sum(c).alias(k) for k, c in columns.items()])

    def image(df: DataFrame, vector: str) -> DataFrame:
        product = geo.multiply(_matrix("h"), [[F.col(f"{vector}{i}")] for i in (1, 2, 3)])
        ends = df.select("graph_id", F.col("node_id").alias("col_node"), *[f"{vector}{i}" for i in (1, 2, 3)])
        return whole.join(ends, ["graph_id", "col_node"]).groupBy("graph_id", F.col("row_node").alias("node_id")).agg(*[F.sum(product[i][0]).alias(f"q{i + 1}") for i in range(3)])

    state = gradient.join(diagonal, ["graph_id", "node_id"]).select("graph_id", "node_id", *G, *[F.lit(0.0).alias(f"x{i}") for i in (1, 2, 3)], *[F.col(f"g{i}").alias(f"r{i}") for i in (1, 2, 3)], *[F.col(f"v{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)]).withColumns(with_z)
    state = state.withColumns({f"p{i}": F.col(f"z{i}") for i in (1, 2, 3)})
    state = checkpointed(state.join(total(state, rz=dot("r", "z"), rr=dot("r", "r")).withColumn("goal", F.col("rr") * tolerance**2), "graph_id"))
    going = state.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.first("rr").alias("rr")).filter("rr > 0").agg(F.max("n").alias("n")).first()
    unknowns, step, best, best_at = 3 * (going["n"] or 0), 0, float("inf"), 0
    while unknowns and (most is None or step < most):
        step += 1
        moving = state.join(image(state, "p"), ["graph_id", "node_id"])
        # A graph that has reached its goal rests.
        alpha = F.when(F.col("rr") > F.col("goal"), F.col("rz") / F.col("pq")).otherwise(0.0)
        moved = moving.join(total(moving, pq=dot("p", "q")), "graph_id").withColumn("alpha", alpha)
        moved = moved.withColumns({f"x{i}": F.col(f"x{i}") + F.col("alpha") * F.col(f"p{i}") for i in (1, 2, 3)} | {f"r{i}": F.col(f"r{i}") - F.col("alpha") * F.col(f"q{i}") for i in (1, 2, 3)}).withColumns(with_z)
        moved = checkpointed(moved.drop("q1", "q2", "q3", "alpha").withColumn("bad", F.coalesce((F.col("rr") > F.col("goal")) & ~(F.col("pq") > 0), F.lit(True))).drop("pq").withColumnRenamed("rz", "old"))
        sums = total(moved.drop("rr"), rz=dot("r", "z"), rr=dot("r", "r"))
        beta = F.when(F.col("old") != 0, F.col("rz") / F.col("old")).otherwise(0.0)
        state = moved.drop("rr").join(sums, "graph_id").withColumns({f"p{i}": F.col(f"z{i}") + beta * F.col(f"p{i}") for i in (1, 2, 3)}).drop("old")
        seen = state.agg(F.max("bad").alias("bad"), F.max(F.when(F.col("rr") > F.col("goal"), F.col("rr") / F.col("goal"))).alias("worst")).first()
        state = state.drop("bad")
        if seen["bad"] or (seen["worst"] or 0.0) == float("inf") or seen["worst"] != seen["worst"]:
            raise ArithmeticError(f"conjugate gradients: a graph's matrix is not positive definite, or not finite (step {step})")
        if seen["worst"] is None:
            break
        if seen["worst"] < best:
            best, best_at = seen["worst"], step
        elif most is None and step - best_at > unknowns:
            raise ArithmeticError(f"conjugate gradients: no progress since step {best_at}; the worst residual is {best**0.5 * tolerance:.3g} of |g|, not {tolerance:.3g}")
    state = checkpointed(state.select("graph_id", "node_id", *G, "x1", "x2", "x3"))
    left = state.join(image(state, "x"), ["graph_id", "node_id"]).withColumns({f"r{i}": F.col(f"g{i}") - F.col(f"q{i}") for i in (1, 2, 3)})
    sizes = total(left, rr=dot("r", "r"), gg=dot("g", "g")).select("graph_id", F.when(F.col("gg") > 0, F.sqrt(F.col("rr") / F.col("gg"))).otherwise(0.0).alias("residual"))
    return state.join(sizes, "graph_id").select("graph_id", "node_id", *[F.col(f"x{i}").alias(f"dx{i}") for i in (1, 2, 3)], "residual")
