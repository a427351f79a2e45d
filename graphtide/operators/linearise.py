"""Edges beside their nodes' states, with residuals, Jacobians and weighted errors as plain columns.

The two joins are the only shuffles; everything after them is scalar arithmetic in generated code. Blocks have fixed
columns e1..e3, a11..a33, b11..b33, of which a kind leaves the unused ones 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.functions import geometry as geo
from graphtide.functions import residuals

KINDS = ("P", "L", "G")


def with_states(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`edges` with xf, yf, tf and xt, yt, tt of the two nodes; a unary edge has null second states. Fails at run time on an edge whose first or, unless it is unary, second node is missing."""
    state = lambda side: nodes.select("graph_id", F.col("node_id").alias({"f": "from_id", "t": "to_id"}[side]), F.col("x").alias(f"x{side}"), F.col("y").alias(f"y{side}"), F.col("theta").alias(f"t{side}"), F.lit(True).alias(f"_in_{side}"))
    rows = edges.join(state("f"), ["graph_id", "from_id"], "left").join(state("t"), ["graph_id", "to_id"], "left")
    lost = F.when(F.col("_in_f").isNull(), F.concat(F.lit("an edge's first node is missing: "), F.coalesce(F.col("from_id").cast("string"), F.lit("null")))).when((F.col("type") != "G") & F.col("_in_t").isNull(), F.concat(F.lit("an edge's second node is missing: "), F.coalesce(F.col("to_id").cast("string"), F.lit("null"))))
    return rows.filter(F.when(lost.isNotNull(), F.raise_error(lost).cast("boolean")).otherwise(F.lit(True))).drop("_in_f", "_in_t")


def _columns(kind: str) -> tuple[geo.Vector, geo.Matrix, geo.Matrix | None]:
    c = F.col
    f, t, z = [c("xf"), c("yf"), c("tf")], [c("xt"), c("yt"), c("tt")], [c("z1"), c("z2"), c("z3")]
    if kind == "P":
        return residuals.pose_pose(f, t, z)
    return residuals.pose_landmark(f, t[:2], z[:2]) if kind == "L" else residuals.pose_fix(f, z[:2])


def _by_kind(parts: dict[str, Column]) -> Column:
    out = F.lit(0.0)
    for kind, value in parts.items():
        out = F.when(F.col("type") == kind, value).otherwise(out)
    return out


def checked(edges: DataFrame) -> DataFrame:
    """`edges`, failing at run time on a missing type, node id, information entry or number of a position fix."""
    bad = F.when(F.col("type").isNull() | ~F.col("type").isin(*KINDS), F.lit("edge without a known type")).when(F.col("from_id").isNull(), F.lit("edge without its first node")).when((F.col("type") != "G") & F.col("to_id").isNull(), F.lit("edge without its second node")).when((F.col("type") == "G") & (F.col("z1").isNull() | F.col("z2").isNull()), F.lit("position fix without two numbers")).when(F.col("i11").isNull() | F.col("i22").isNull(), F.lit("edge without information"))
    return edges.filter(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(F.lit(True)))


def linearised(edges: DataFrame, nodes: DataFrame, spread: bool = False) -> DataFrame:
    """with_states of checked edges plus e1..e3, a11..a33, b11..b33. `edges` must hold the information columns. `spread`: edges of one node, and those without a second, are dealt out over all tasks before the arithmetic."""
    rows = with_states(checked(edges), nodes)
    rows = rows.repartition("graph_id", "edge_pos") if spread else rows
    built = {k: _columns(k) for k in KINDS}
    new = {}
    for i in range(3):
        new[f"e{i + 1}"] = _by_kind({k: e[i] for k, (e, _, _) in built.items() if i < len(e)})
        for j in range(3):
            new[f"a{i + 1}{j + 1}"] = _by_kind({k: a[i][j] for k, (_, a, _) in built.items() if i < len(a)})
            new[f"b{i + 1}{j + 1}"] = _by_kind({k: b[i][j] for k, (_, _, b) in built.items() if b and i < len(b) and j < len(b[i])})
    return rows.withColumns(new)


INFO = [["i11", "i12", "i13"], ["i12", "i22", "i23"], ["i13", "i23", "i33"]]


def weights() -> geo.Matrix:
    return [[F.col(name) for name in row] for row in INFO]


def weighted_errors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, edge_pos, type, q = e'We, m = number of measured values. Angles are taken to (-pi, pi]; edges of no known type go."""
    rows = with_states(edges.filter(F.col("type").isin(*KINDS)), nodes)
    built = {k: _columns(k)[0] for k in KINDS}
    built["P"][2] = geo.wrap_upper(F.col("tt") - F.col("tf") - F.col("z3"))
    rows = rows.withColumns({f"e{i + 1}": _by_kind({k: e[i] for k, e in built.items() if i < len(e)}) for i in range(3)})
    return rows.select("graph_id", "edge_pos", "type", geo.quadratic([F.col("e1"), F.col("e2"), F.col("e3")], weights()).alias("q"), F.when(F.col("type") == "P", 3).otherwise(2).alias("m"))


def whitened2(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, edge_pos, r1, r2: the residuals of L and G edges times the square root of their information, (W + sqrt(det) I) / sqrt(trace + 2 sqrt(det))."""
    rows = linearised(edges.filter("type in ('L', 'G')"), nodes)
    det = F.sqrt(F.col("i11") * F.col("i22") - F.col("i12") * F.col("i12"))
    t = F.sqrt(F.col("i11") + F.col("i22") + 2 * det)
    r1 = ((F.col("i11") + det) * F.col("e1") + F.col("i12") * F.col("e2")) / t
    r2 = (F.col("i12") * F.col("e1") + (F.col("i22") + det) * F.col("e2")) / t
    return rows.select("graph_id", "edge_pos", r1.alias("r1"), r2.alias("r2"))
