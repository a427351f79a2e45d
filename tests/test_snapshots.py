"""Versioned snapshots, and blocks that are kept up to date by a stream of moves."""

import pytest
from pyspark.sql import functions as F

from graphtide.operators import linsys
from graphtide.sources import fixture
from graphtide.sources.snapshots import Snapshots
from graphtide.streaming.blocks import KeptBlocks


def test_versions_are_whole_or_absent(spark, tmp_path):
    found = Snapshots(spark, str(tmp_path / "s"))
    assert found.versions() == []
    with pytest.raises(KeyError):
        found.read("estimate")
    one, two = spark.createDataFrame([(1, 0.5)], "node_id long, x double"), spark.createDataFrame([(1, 0.75)], "node_id long, x double")
    assert found.write(3, {"estimate": one, "truth": two})
    assert not found.write(3, {"estimate": two, "truth": two})
    broken = two.select("node_id", F.raise_error(F.lit("lost")).cast("double").alias("x"))
    with pytest.raises(Exception, match="lost"):
        found.write(4, {"truth": one, "estimate": broken})
    assert found.versions() == [3] and found.read("estimate").collect() == one.collect()
    assert found.write(4, {"estimate": two}) and found.versions() == [3, 4]
    assert found.read("estimate").collect() == two.collect() and found.read("estimate", as_of=3).collect() == one.collect() and found.read("truth", as_of=3).collect() == two.collect()
    with pytest.raises(KeyError):
        found.read("estimate", as_of=2)


def rows(df, keys):
    return {tuple(r[k] for k in keys): [r[c] for c in df.columns if c not in keys] for r in df.collect()}


def same(kept, version):
    nodes, edges = (kept.snapshots.read(name, version) for name in ("nodes", "edges"))
    for name, made, keys in (("blocks", linsys.normal_blocks, ["graph_id", "row_node", "col_node"]), ("gradient", linsys.gradient_blocks, ["graph_id", "node_id"])):
        mine, whole = rows(kept.snapshots.read(name, version).select(*made(edges, nodes).columns), keys), rows(made(edges, nodes), keys)
        assert mine.keys() == whole.keys()
        for k, v in whole.items():
            assert mine[k] == pytest.approx(v, rel=1e-9, abs=1e-7)


def test_kept_blocks_equal_those_made_anew(spark, data_dir, tmp_path):
    nodes = fixture.nodes(spark, data_dir).filter("graph_id < 3")
    edges = fixture.with_information(fixture.edges(spark, data_dir)).filter("graph_id < 3").checkpoint()
    late = edges.filter("edge_pos % 9 = 4")
    kept = KeptBlocks(Snapshots(spark, str(tmp_path / "kept")))
    kept.begin(nodes, edges.join(late, ["graph_id", "edge_pos"], "left_anti"))
    same(kept, 0)
    source = tmp_path / "moves"
    schema = "graph_id long, node_id long, seq long, x double, y double, theta double"
    for i, some in enumerate(([(0, 3, 1, 9.0, 9.0, 9.0), (0, 3, 2, 1.5, -0.5, 0.25), (0, 77_777, 1, 0.0, 0.0, 0.0)], [(0, 3, 3, 2.5, 0.5, 0.75), (1, 0, 1, 0.25, 0.0, 0.5), (2, 1_000_001, 1, 4.0, 1.0, None)])):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{source}/{i}")
        # A restart: the query begins where its checkpoint ends.
        kept.follow(spark.readStream.schema(schema).parquet(f"{source}/*"), str(tmp_path / "checkpoint")).awaitTermination()
        same(kept, i + 1)
    assert kept.snapshots.versions() == [0, 1, 2]
    assert kept.snapshots.read("nodes").filter("graph_id = 0 and node_id = 3").first()["x"] == 2.5
    moved = spark.createDataFrame([(1, 2, 1.0, 1.0, 1.0)], "graph_id long, node_id long, x double, y double, theta double")
    assert kept.apply(2, moved, late) and not kept.apply(2, moved, late)
    same(kept, 3)
    assert kept.snapshots.read("edges").count() == edges.count()
    # Earlier versions are as they were.
    same(kept, 1)
