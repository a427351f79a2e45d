"""Normal equations kept up to date: when nodes move or edges come, only the blocks of touched edges change.

The blocks H and g, the states and the edges are versions of a snapshot. A batch reads the last version before it, takes what
the edges of moved nodes gave at the old states from the sums, adds what they give at the new ones and what new edges give,
and writes its own version. The touched edges are found by a semi-join; no edge of unmoved nodes is linearised again. A
batch that is repeated finds its version there and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphtide.operators.growth import endpoints
from graphtide.operators.kept import kept
from graphtide.operators.linsys import G, H, gradient_blocks, normal_blocks
from graphtide.sources.snapshots import Snapshots

STATE = ["x", "y", "theta"]


class KeptBlocks:
    """Versions of blocks (as linsys.normal_blocks gives them, with the anchor), gradient, nodes and edges."""

    def __init__(self, snapshots: Snapshots) -> None:
        self.snapshots = snapshots

    def begin(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Version 0. Takes edges with information."""
        nodes, edges = kept(nodes.select("graph_id", "node_id", "dim", *STATE)), kept(edges)
        self.snapshots.write(0, {"nodes": nodes, "edges": edges, "blocks": normal_blocks(edges, nodes), "gradient": gradient_blocks(edges, nodes)})

    def apply(self, batch: int, moved: DataFrame, arrived: DataFrame | None = None) -> bool:
        """Version batch + 1: `moved` has nodes' new states (graph_id, node_id, x, y, theta), at most one row for a node, of which those that the graph lacks are left out; `arrived` new edges between known nodes. False if it was there."""
        version = batch + 1
        if version in self.snapshots.versions():
            return False
        before = {name: self.snapshots.read(name, version - 1) for name in ("nodes", "edges", "blocks", "gradient")}
        new = moved.select("graph_id", "node_id", *[F.col(c).alias(f"new_{c}") for c in STATE], F.lit(True).alias("moved"))
        nodes = kept(before["nodes"].join(new, ["graph_id", "node_id"], "left"))
        old_states = nodes.select("graph_id", "node_id", "dim", *STATE)
        new_states = nodes.select("graph_id", "node_id", "dim", *[F.when(F.col("moved"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in STATE])
        gone = nodes.filter("moved").select("graph_id", "node_id")
        edges = before["edges"]
        touched = endpoints(edges.select("graph_id", "edge_pos", "from_id", "to_id")).join(gone, ["graph_id", "node_id"], "left_semi").select("graph_id", "edge_pos").distinct()
        touched = kept(edges.join(touched, ["graph_id", "edge_pos"], "left_semi"))
        added = touched if arrived is None else touched.unionByName(arrived.select(*edges.columns))

        def changed(whole: DataFrame, made, by: list[str], values: list[str]) -> DataFrame:
            less = made(touched, old_states).select(*by, *[(-F.col(v)).alias(v) for v in values])
            return whole.unionByName(less).unionByName(made(added, new_states).select(*by, *values)).groupBy(*by).agg(*[F.sum(v).alias(v) for v in values])

        tables = {
            "nodes": new_states,
            "edges": edges if arrived is None else edges.unionByName(arrived.select(*edges.columns)),
            "blocks": changed(before["blocks"], lambda e, n: normal_blocks(e, n, anchor=False), ["graph_id", "row_node", "col_node"], H),
            "gradient": changed(before["gradient"], gradient_blocks, ["graph_id", "node_id"], G),
        }
        return self.snapshots.write(version, tables)

    def follow(self, moves: DataFrame, checkpoint: str) -> StreamingQuery:
        """Starts a query over a stream of moves (graph_id, node_id, seq, x, y, theta): of a batch's rows for a node the one of the greatest seq counts."""

        def one(batch: DataFrame, number: int) -> None:
            last = Window.partitionBy("graph_id", "node_id").orderBy(F.desc("seq"))
            self.apply(number, batch.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n"))

        return moves.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
