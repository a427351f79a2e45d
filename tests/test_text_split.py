"""Each line is split once, and lines without a wanted tag never."""

from graphtide.sources import text


def test_lines_are_split_once_and_awkward_ones_read_as_before(spark):
    rows = ["  VERTEX_SE2 1 2 3 4 # VERTEX_XY 9 1 1", "VERTEX_SE2#1 2 3 4", "#VERTEX_XY 7 1 2", "VERTEX_XYZ 8 1 2", "VERTEX_XY 5 x  2", "\tVERTEX_XY 6 1 2", "", "   ", "#\rVERTEX_XY 4 1 2", "VERTEX_XY 3 1", None]
    lines = spark.createDataFrame([("g", i, line) for i, line in enumerate(rows)], "graph_id string, line_no long, line string")
    nodes = text.parse_nodes(lines, text.G2O)
    got = {(r["node_id"], r["dim"], str(r["x"]), r["y"], r["theta"], r["file_pos"]) for r in nodes.collect()}
    assert got == {(1, 3, "2.0", 3.0, 4.0, 0), (5, 2, "nan", 2.0, None, 4)}
    assert [r["tag"] for r in text.tokens(lines).orderBy("line_no").collect()] == ["VERTEX_SE2", "VERTEX_SE2", "VERTEX_XYZ", "VERTEX_XY", "\tVERTEX_XY", "\rVERTEX_XY", "VERTEX_XY"]
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
