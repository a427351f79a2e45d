"""The queries by name, over graphs derived from the events table, and the SQL that gives the same rows.

Numbers that come from sums or from trigonometry are rounded, as two engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.functions import geometry as geo
from graphtide.functions import residuals
from graphtide.operators import elimination, growth, incremental, linearise, linsys, metrics, plots
from graphtide.operators.kept import kept
from graphtide.sources import fixture, text

BATCH = 4
STEP_THRESHOLD = 0.75
NORMAL_DIGITS, FINE = 4, 6
SHIFT = 3e-6


def _r(name: str, digits: int = FINE):
    """Rounded, and never a negative zero."""
    return (F.round(F.col(name), digits) + 0.0).alias(name)


def _rounded(df: DataFrame, digits: int = FINE) -> DataFrame:
    return df.select(*[_r(c, digits) if t == "double" else F.col(c) for c, t in df.dtypes])


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.nodes(spark, sf_dir)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.with_information(fixture.edges(spark, sf_dir))


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.growth_order(_edges(spark, sf_dir))


# ---- sources


def pose_nodes(spark, sf_dir):
    return growth.coordinates(_nodes(spark, sf_dir), 3).select("graph_id", "node_id", "x", "y", "theta")


def landmark_nodes(spark, sf_dir):
    return growth.coordinates(_nodes(spark, sf_dir), 2).select("graph_id", "node_id", "x", "y")


def edges_pos(spark, sf_dir):
    return fixture.edges(spark, sf_dir)


def info_symmetrised(spark, sf_dir):
    rows = _edges(spark, sf_dir)
    full = [[(F.col(a) + F.col(b)) / 2 for a, b in zip(r, c, strict=True)] for r, c in zip(linearise.INFO, zip(*linearise.INFO, strict=True), strict=True)]
    return rows.select("graph_id", "edge_pos", *[full[i][j].alias(f"w{i + 1}{j + 1}") for i in range(3) for j in range(3)])


def dangling_edges(spark, sf_dir):
    """Endpoints without a node once every seventh node is taken away."""
    kept = _nodes(spark, sf_dir).filter("node_id % 7 <> 3")
    return text.dangling(kept, fixture.edges(spark, sf_dir))


def _g2o_lines(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("e"))
    e = F.col("e")
    s = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    lines = F.array(
        s("VERTEX_SE2", e, e % 16, e % 8, e % 4),
        s("VERTEX_XY", e + 1_000_000, e % 5, e % 3),
        F.when(e % 3 == 0, s("EDGE_SE2", e, e + 1, "1", "0.5", "-0.25", "4", "0.5", "0", "4", "0", "16 # seen")).otherwise(s("EDGE_SE2", e, "1")),
        s("  EDGE_SE2_XY", e, e + 1_000_000, " 2", e % 7, "2", "0.25", "2"),
        F.lit("# a comment"),
        F.when(e % 5 == 0, F.lit("\tVERTEX_SE2 1 2 3 4")).otherwise(s("OTHER", e)),
    )
    return ev.select("graph_id", F.posexplode(lines).alias("i", "line"), "e").select("graph_id", (F.col("e") * 6 + F.col("i")).alias("line_no"), "line")


def parse_g2o_nodes(spark, sf_dir):
    return text.parse_nodes(_g2o_lines(spark, sf_dir), text.G2O)


def parse_g2o_edges(spark, sf_dir):
    return text.parse_edges(_g2o_lines(spark, sf_dir), text.G2O)


def parse_toro(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("e"))
    e = F.col("e")
    line = F.concat_ws(" ", F.lit("EDGE2"), e, e + 1, F.lit("1"), (e % 4).cast("string"), F.lit("0.5 11 12 22 33 13"), F.when(e % 4 == 0, F.lit("23")).when(e % 4 == 1, F.lit("x")), F.lit("#23"))
    return text.parse_edges(ev.select("graph_id", e.alias("line_no"), line.alias("line")), text.TORO).fillna(-1.0, ["i23"]).withColumn("i23", F.when(F.isnan("i23"), -1.0).otherwise(F.col("i23")))


def parse_toro_nodes(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("e"))
    e = F.col("e")
    line = F.concat_ws(" ", F.lit("VERTEX2"), e, (e % 4).cast("string"), F.lit("-0.5"), F.when(e % 3 < 2, (e % 8).cast("string")), F.when(e % 3 == 1, F.lit("# end")))
    return text.parse_nodes(ev.select("graph_id", e.alias("line_no"), line.alias("line")), text.TORO)


# ---- growth


def batch_assign(spark, sf_dir):
    return growth.batches(fixture.edges(spark, sf_dir), BATCH).select("graph_id", "edge_pos", "it")


def _seen(spark, sf_dir):
    return growth.first_seen(growth.batches(fixture.edges(spark, sf_dir), BATCH), _nodes(spark, sf_dir))


def first_seen_batch(spark, sf_dir):
    return _seen(spark, sf_dir)


def new_nodes_per_batch(spark, sf_dir):
    return _seen(spark, sf_dir).groupBy("graph_id", F.col("first_it").alias("it")).agg(F.count(F.lit(1)).alias("new_nodes"))


def _offsets(spark, sf_dir):
    return growth.state_offsets(_seen(spark, sf_dir), _nodes(spark, sf_dir))


def node_offsets(spark, sf_dir):
    return _offsets(spark, sf_dir).select("graph_id", "node_id", "offset")


def var2node(spark, sf_dir):
    return growth.variables(_offsets(spark, sf_dir))


def seeded_states(spark, sf_dir):
    """New nodes start at the source's guess."""
    return _offsets(spark, sf_dir).join(_nodes(spark, sf_dir).drop("dim"), ["graph_id", "node_id"]).select("graph_id", "first_it", "node_id", "x", "y")


def incidence(spark, sf_dir):
    rows = growth.incidence(fixture.edges(spark, sf_dir))
    return rows.select("graph_id", "node_id", F.col("degree"), F.array_join("edge_list", ",").alias("edge_list"))


def growth_closure_order(spark, sf_dir):
    return growth.growth_order(fixture.edges(spark, sf_dir)).select("graph_id", "edge_pos", "seq", "step", "kind")


def growth_candidates(spark, sf_dir):
    """Edges with exactly one end among the even nodes."""
    inside = _nodes(spark, sf_dir).filter("node_id % 2 = 0")
    at = lambda side: inside.select("graph_id", F.col("node_id").alias(f"{side}_id"), F.lit(True).alias(f"in_{side}"))
    rows = fixture.edges(spark, sf_dir).filter("type <> 'G'").join(at("from"), ["graph_id", "from_id"], "left").join(at("to"), ["graph_id", "to_id"], "left")
    return rows.filter(F.col("in_from").isNull() != F.col("in_to").isNull()).select("graph_id", "edge_pos")


def disconnected_edges(spark, sf_dir):
    """Edges that growth loses once odometry is cut at every thirtieth pose and closures and landmarks are taken away."""
    edges = fixture.edges(spark, sf_dir).filter("type = 'G' or (type = 'P' and z1 > 0 and from_id % 30 <> 29)")
    return growth.dropped_edges(edges, growth.growth_order(edges)).groupBy("graph_id").agg(F.count(F.lit(1)).alias("dropped"))


def loop_closure_pose(spark, sf_dir):
    return growth.pose_closures(fixture.edges(spark, sf_dir))


def loop_closure_landmark(spark, sf_dir):
    return growth.landmark_closures(fixture.edges(spark, sf_dir))


# ---- geometry


def _angles(spark, sf_dir):
    n = growth.coordinates(_nodes(spark, sf_dir), 3)
    return n.withColumn("wide", F.col("theta") * 5 + F.col("node_id") % 3)


def wrap_angle(spark, sf_dir):
    return _angles(spark, sf_dir).select("graph_id", "node_id", geo.wrap(F.col("wide")).alias("wrapped")).select("graph_id", "node_id", _r("wrapped"))


def _pose(suffix: str = "") -> list:
    return [F.col(f"{c}{suffix}") for c in ("x", "y", "theta")]


def _matrix_rows(rows: DataFrame, m) -> DataFrame:
    return _rounded(rows.select("graph_id", "node_id", *[m[i][j].alias(f"m{i + 1}{j + 1}") for i in range(2) for j in range(3)]))


def se2_matrix(spark, sf_dir):
    return _matrix_rows(growth.coordinates(_nodes(spark, sf_dir), 3), geo.to_matrix(*_pose()))


def se2_vector(spark, sf_dir):
    rows = growth.coordinates(_nodes(spark, sf_dir), 3)
    v = geo.to_vector(geo.to_matrix(*_pose()))
    return _rounded(rows.select("graph_id", "node_id", *[c.alias(n) for c, n in zip(v, ("vx", "vy", "vt"), strict=True)]))


def se2_inverse(spark, sf_dir):
    return _matrix_rows(growth.coordinates(_nodes(spark, sf_dir), 3), geo.inverse(geo.to_matrix(*_pose())))


def se2_compose(spark, sf_dir):
    """Each odometry edge's second pose as seen from its first."""
    rows = linearise.with_states(fixture.edges(spark, sf_dir).filter("type = 'P'"), _nodes(spark, sf_dir))
    v = geo.between([F.col("xf"), F.col("yf"), F.col("tf")], [F.col("xt"), F.col("yt"), F.col("tt")])
    return _rounded(rows.select("graph_id", "edge_pos", v[0].alias("rx"), v[1].alias("ry"), F.cos(v[2]).alias("rc"), F.sin(v[2]).alias("rs")))


def _residual(kind: str, n: int):
    def query(spark, sf_dir):
        rows = linearise.with_states(fixture.edges(spark, sf_dir).filter(F.col("type") == kind), _nodes(spark, sf_dir))
        f, t, z = ([F.col(c) for c in names] for names in (("xf", "yf", "tf"), ("xt", "yt", "tt"), ("z1", "z2", "z3")))
        e = (residuals.pose_pose(f, t, z) if kind == "P" else residuals.pose_landmark(f, t, z) if kind == "L" else residuals.pose_fix(f, z))[0]
        return _rounded(rows.select("graph_id", "edge_pos", *[e[i].alias(f"e{i + 1}") for i in range(n)]))

    return query


def jacobian_blocks(spark, sf_dir):
    rows = linearise.linearised(linearise.checked(_edges(spark, sf_dir)), _nodes(spark, sf_dir))
    return _rounded(rows.select("graph_id", "edge_pos", "type", *[f"{m}{i}{j}" for m in "ab" for i in (1, 2, 3) for j in (1, 2, 3)]))


def whitened_residual(spark, sf_dir):
    return _rounded(linearise.whitened2(_edges(spark, sf_dir), _nodes(spark, sf_dir)))


def whitened_residual_pose(spark, sf_dir):
    return _rounded(incremental.whitened3(_edges(spark, sf_dir), _nodes(spark, sf_dir)))


# ---- errors


def chi2_per_graph(spark, sf_dir):
    total = metrics.global_error(_edges(spark, sf_dir), _nodes(spark, sf_dir))
    return total.select("graph_id", "n_edges", "n_measurements", _r("chi2", NORMAL_DIGITS), _r("normalised_error"))


def chi2_by_type(spark, sf_dir):
    rows = linearise.weighted_errors(_edges(spark, sf_dir), _nodes(spark, sf_dir))
    return _rounded(rows.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("q").alias("chi2")), 2)


def normalised_error(spark, sf_dir):
    total = metrics.global_error(_edges(spark, sf_dir), _nodes(spark, sf_dir)).agg(F.sum("chi2").alias("c"), F.sum("n_measurements").alias("m"))
    return total.select((F.round(F.col("c") / F.greatest("m", F.lit(1)), FINE) + 0.0).alias("normalised_error"))


def ate_alignment(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return _rounded(metrics.alignment(n, fixture.ground_truth(n)))


def ate_rmse(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return _rounded(metrics.trajectory_error(n, fixture.ground_truth(n)))


# ---- systems and solving


def normal_blocks(spark, sf_dir):
    return _rounded(linsys.normal_blocks(_edges(spark, sf_dir), _nodes(spark, sf_dir)), NORMAL_DIGITS)


def gradient_blocks(spark, sf_dir):
    return _rounded(linsys.gradient_blocks(_edges(spark, sf_dir), _nodes(spark, sf_dir)), NORMAL_DIGITS)


def _steps(spark, sf_dir):
    return growth.variables(_offsets(spark, sf_dir)).select("graph_id", "var", ((F.col("var") * 37 % 101 - 50) / 64.0).alias("dx"))


def affected_vars(spark, sf_dir):
    return growth.affected_variables(_steps(spark, sf_dir), _offsets(spark, sf_dir), STEP_THRESHOLD)


def affected_edges(spark, sf_dir):
    moved = _steps(spark, sf_dir).filter(F.abs("dx") > STEP_THRESHOLD).join(growth.variables(_offsets(spark, sf_dir)), ["graph_id", "var"]).select("graph_id", "node_id").distinct()
    return growth.affected_edges(fixture.edges(spark, sf_dir), moved)


def converged(spark, sf_dir):
    """Whether a graph's greatest step is within the threshold."""
    return _steps(spark, sf_dir).groupBy("graph_id").agg(F.max(F.abs("dx")).alias("most")).select("graph_id", "most", (F.col("most") <= STEP_THRESHOLD).alias("converged"))


def gn_step(spark, sf_dir):
    return _rounded(elimination.steps(_nodes(spark, sf_dir), _edges(spark, sf_dir)))


def gn_step_image(spark, sf_dir):
    """H dx of the steps that gn_step finds, which is the gradient if they are right. The small shift keeps numbers away from where rounding would change."""
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir)
    blocks, gradient = linsys.system(edges, nodes)
    found = linsys.image(blocks, elimination.eliminate(blocks, gradient, written=True).solution())
    return found.select("graph_id", "node_id", *[(F.round(F.col(f"q{i}") + SHIFT, NORMAL_DIGITS) + 0.0).alias(f"q{i}") for i in (1, 2, 3)])


def partial_solve(spark, sf_dir):
    return _rounded(elimination.newest_steps(_nodes(spark, sf_dir), _edges(spark, sf_dir)))


def logdet(spark, sf_dir):
    return _rounded(elimination.log_determinants(_nodes(spark, sf_dir), _edges(spark, sf_dir)))


# ---- one graph of all events, over tables throughout


def _whole(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Kept, as several tables are made of them."""
    return kept(fixture.nodes(spark, sf_dir, whole=True)), kept(fixture.with_information(fixture.edges(spark, sf_dir, whole=True)))


def one_graph_growth(spark, sf_dir):
    edges = kept(fixture.edges(spark, sf_dir, whole=True).select("graph_id", "edge_pos", "type", "from_id", "to_id"))
    return growth.growth_order(edges, steps=growth.growth_steps(edges, walked=0)).select("edge_pos", "seq", "step", "kind")


def one_graph_step_image(spark, sf_dir):
    """H dx of the step that block elimination finds, as in gn_step_image."""
    nodes, edges = _whole(spark, sf_dir)
    blocks, gradient = linsys.system(edges, nodes)
    found = linsys.image(blocks, elimination.eliminate(blocks, gradient, written=True).solution())
    return found.select("node_id", *[(F.round(F.col(f"q{i}") + SHIFT, NORMAL_DIGITS) + 0.0).alias(f"q{i}") for i in (1, 2, 3)])


def one_graph_logdet(spark, sf_dir):
    return _rounded(elimination.log_determinants(*_whole(spark, sf_dir)).select("n_vars", "half_logdet"))


def _small(spark, sf_dir):
    """Increments by degrees of growth alone: a stored table's shape without a solver."""
    seen = growth.first_seen(growth.batches(fixture.edges(spark, sf_dir), BATCH), _nodes(spark, sf_dir)).join(_nodes(spark, sf_dir).select("graph_id", "node_id", "dim"), ["graph_id", "node_id"])
    rows = seen.groupBy("graph_id", F.col("first_it").alias("it")).agg(F.sum("dim").alias("d"), F.sum("node_id").alias("s"))
    from pyspark.sql import Window

    w = Window.partitionBy("graph_id").orderBy("it").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("graph_id", "it", F.sum("d").over(w).alias("n_vars"), (F.sum(F.col("s") % 64 + 1).over(w) / 8.0).alias("half_logdet"), (F.col("d") * F.col("d")).cast("double").alias("update_flops"))


def info_gain(spark, sf_dir):
    return _rounded(metrics.information_gain(_small(spark, sf_dir)).select("graph_id", "it", "di"))


def cumulative_flops(spark, sf_dir):
    return metrics.cumulative_work(_small(spark, sf_dir)).select("graph_id", "it", "cumulative_flops")


def run_summary(spark, sf_dir):
    rows = _small(spark, sf_dir)
    skipped = F.col("it") % 3 == 0
    rows = rows.select("graph_id", "it", skipped.alias("skipped"), (F.col("it") % 5 == 0).alias("loop_closure"), (F.col("it") % 4).cast("int").alias("gn"), F.when(~skipped, F.col("half_logdet")).alias("err"), F.when(~skipped, F.col("half_logdet") / 2).alias("ate_rmse"), "update_flops")
    return _rounded(metrics.run_summary(rows))


def _incremental(**options):
    config = incremental.Config(**options)

    def query(spark, sf_dir):
        nodes = _nodes(spark, sf_dir)
        return _rounded(incremental.increments(nodes, _edges(spark, sf_dir), fixture.ground_truth(nodes), config))

    return query


def incremental_at_guess(spark, sf_dir):
    """The incremental run without steps: closures, gate, skipped increments, variables and errors as the source's guess gives them."""
    config = incremental.Config(gating="LCG", most_iterations=0)
    rows = incremental.increments(_nodes(spark, sf_dir), _edges(spark, sf_dir), None, config)
    return rows.select("graph_id", "it", "loop_closure", "n_vars", "gated", "skipped", "gn", _r("err", NORMAL_DIGITS))


# ---- tables to draw


def plot_segments(spark, sf_dir):
    return plots.segments(fixture.edges(spark, sf_dir), _nodes(spark, sf_dir))


def plot_new_gnss(spark, sf_dir):
    return plots.new_fixes(fixture.edges(spark, sf_dir), 40)


def plot_highlight(spark, sf_dir):
    moved = _steps(spark, sf_dir).filter(F.abs("dx") > STEP_THRESHOLD).join(growth.variables(_offsets(spark, sf_dir)), ["graph_id", "var"]).select("graph_id", "node_id").distinct()
    return plots.highlighted(_nodes(spark, sf_dir), moved).select("graph_id", "node_id", "x", "y")


QUERIES = {
    f.__name__: f
    for f in (
        pose_nodes, landmark_nodes, edges_pos, info_symmetrised, dangling_edges, parse_g2o_nodes, parse_g2o_edges, parse_toro, parse_toro_nodes, batch_assign, first_seen_batch, new_nodes_per_batch, node_offsets, var2node, seeded_states, incidence, growth_closure_order, growth_candidates, disconnected_edges, loop_closure_pose, loop_closure_landmark, wrap_angle, se2_matrix, se2_vector, se2_inverse, se2_compose, jacobian_blocks, whitened_residual, whitened_residual_pose, chi2_per_graph, chi2_by_type, normalised_error, ate_alignment, ate_rmse, normal_blocks, gradient_blocks, affected_vars, affected_edges, converged, gn_step, gn_step_image, partial_solve, logdet, one_graph_growth, one_graph_step_image, one_graph_logdet, info_gain, cumulative_flops, run_summary, incremental_at_guess, plot_segments, plot_new_gnss, plot_highlight,
    )
} | {
    "residual_pose_pose": _residual("P", 3),
    "residual_pose_landmark": _residual("L", 2),
    "residual_gnss": _residual("G", 2),
    "incremental_spo_igg": _incremental(gating="IGG"),
    "incremental_spo_lcg": _incremental(gating="LCG"),
    "incremental_full_gn": _incremental(gating="LCG", selective=False),
}

from graphtide.plans.oracle import ORACLE_SQL  # noqa: E402

__all__ = ["QUERIES", "ORACLE_SQL"]
