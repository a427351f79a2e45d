"""Errors of graphs and of trajectories against a truth: joins and one aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphtide.operators.linearise import weighted_errors


def global_error(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, n_edges, n_measurements, chi2, normalised_error of each graph with an edge."""
    total = weighted_errors(edges, nodes).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("m").alias("n_measurements"), F.sum("q").alias("chi2"))
    return total.withColumn("normalised_error", F.col("chi2") / F.greatest(F.col("n_measurements"), F.lit(1)))


def alignment(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """graph_id, n, phi, tx, ty: the turn and shift that bring the estimate's poses closest to the truth's. Fewer than two shared poses: null.

    In the plane the best turn has a closed form in the centred cross sums, so no decomposition is needed.
    """
    both = estimate.filter("dim = 3").select("graph_id", "node_id", F.col("x").alias("px"), F.col("y").alias("py")).join(truth.select("graph_id", "node_id", F.col("x").alias("qx"), F.col("y").alias("qy")), ["graph_id", "node_id"])
    s = both.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in ("px", "py", "qx", "qy")], (F.covar_pop("px", "qy") - F.covar_pop("py", "qx")).alias("cross"), (F.covar_pop("px", "qx") + F.covar_pop("py", "qy")).alias("dot"))
    phi = F.when(F.col("n") >= 2, F.atan2("cross", "dot"))
    s = s.withColumn("phi", phi)
    c, sn = F.cos("phi"), F.sin("phi")
    return s.select("graph_id", "n", "phi", (F.col("mqx") - (c * F.col("mpx") - sn * F.col("mpy"))).alias("tx"), (F.col("mqy") - (sn * F.col("mpx") + c * F.col("mpy"))).alias("ty"))


def trajectory_error(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """graph_id, n, rmse of the aligned estimate's positions; null below two shared poses."""
    a = alignment(estimate, truth)
    poses = estimate.filter("dim = 3").select("graph_id", "node_id", F.col("x").alias("px"), F.col("y").alias("py")).join(truth.select("graph_id", "node_id", F.col("x").alias("qx"), F.col("y").alias("qy")), ["graph_id", "node_id"]).join(a, "graph_id")
    c, s = F.cos("phi"), F.sin("phi")
    dx = c * F.col("px") - s * F.col("py") + F.col("tx") - F.col("qx")
    dy = s * F.col("px") + c * F.col("py") + F.col("ty") - F.col("qy")
    return poses.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(dx * dx + dy * dy)).alias("rmse"))


def information_gain(increments: DataFrame) -> DataFrame:
    """`increments` (graph_id, it, half_logdet, n_vars) with di: the gain beyond what the growth of the state explains; 0 at first."""
    w = Window.partitionBy("graph_id").orderBy("it")
    before = F.lag("half_logdet").over(w)
    return increments.withColumn("di", F.coalesce(F.col("half_logdet") - before * (F.col("n_vars") / F.lag("n_vars").over(w)), F.lit(0.0)))


def cumulative_work(increments: DataFrame) -> DataFrame:
    w = Window.partitionBy("graph_id").orderBy("it").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return increments.withColumn("cumulative_flops", F.sum("update_flops").over(w))


def run_summary(increments: DataFrame) -> DataFrame:
    """One row a graph: increments, skipped ones, loop closures, iterations, last and mean error and trajectory error, mean work. Skipped increments have null errors and don't count."""
    return increments.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("increments"),
        F.count_if("skipped").alias("skipped"),
        F.count_if("loop_closure").alias("loop_closures"),
        F.sum("gn").alias("iterations"),
        F.max_by("err", F.when(F.col("err").isNotNull(), F.col("it"))).alias("final_error"),
        F.avg("err").alias("mean_error"),
        F.max_by("ate_rmse", F.when(F.col("ate_rmse").isNotNull(), F.col("it"))).alias("final_ate"),
        F.avg("ate_rmse").alias("mean_ate"),
        F.avg("update_flops").alias("mean_update_flops"),
    )


def parity_series(increments: DataFrame) -> DataFrame:
    """Skipped increments as error 0 and trajectory error NaN."""
    return increments.withColumns({"err": F.coalesce("err", F.lit(0.0)), "ate_rmse": F.coalesce("ate_rmse", F.lit(float("nan")))})
