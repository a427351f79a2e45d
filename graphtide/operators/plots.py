"""Tables ready to draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, edge_pos, type, x1, y1, x2, y2: node to node, or node to measured position."""
    at = lambda side, n: nodes.select("graph_id", F.col("node_id").alias(f"{side}_id"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    rows = edges.join(at("from", 1), ["graph_id", "from_id"]).join(at("to", 2), ["graph_id", "to_id"], "left")
    fix = F.col("type") == "G"
    return rows.filter("type = 'G' or x2 is not null").select("graph_id", "edge_pos", "type", "x1", "y1", F.when(fix, F.col("z1")).otherwise(F.col("x2")).alias("x2"), F.when(fix, F.col("z2")).otherwise(F.col("y2")).alias("y2"))


def new_fixes(edges: DataFrame, after: int = 0) -> DataFrame:
    """graph_id, edge_pos, z1, z2 of position fixes beyond the mark `after`; of equal positions the first."""
    first = F.row_number().over(Window.partitionBy("graph_id", "z1", "z2").orderBy("edge_pos"))
    return edges.filter((F.col("type") == "G") & (F.col("edge_pos") > after)).withColumn("_n", first).filter("_n = 1").select("graph_id", "edge_pos", "z1", "z2")


def highlighted(nodes: DataFrame, affected: DataFrame) -> DataFrame:
    """Nodes among `affected` (graph_id, node_id); unknown ones are ignored."""
    return nodes.join(affected, ["graph_id", "node_id"], "left_semi")


def closure_marks(increments: DataFrame) -> DataFrame:
    return increments.filter("loop_closure").select("graph_id", "it")
