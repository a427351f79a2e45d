"""Readers of pose-graph text files.

g2o: `VERTEX_SE2 id x y theta`, `VERTEX_XY id x y`, `EDGE_SE2 from to dx dy dtheta I11 I12 I13 I22 I23 I33`,
`EDGE_SE2_XY pose landmark zx zy I11 I12 I22`. TORO: `VERTEX2 id x y theta`, `EDGE2 from to dx dy dtheta I11 I12 I22 I33
I13 I23`. '#' begins a comment; blank lines, unknown tags and lines with too few fields are skipped; only spaces
separate fields; a field that is no number reads as NaN. Ids are 64-bit; a line whose id is no number is skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags, fewest fields behind the tag, and the places of the information matrix's entries.
G2O = {"VERTEX_SE2": 4, "VERTEX_XY": 3, "EDGE_SE2": 11, "EDGE_SE2_XY": 7}
TORO = {"VERTEX2": 4, "EDGE2": 11}
INFORMATION = {"EDGE_SE2": {"i11": 5, "i12": 6, "i13": 7, "i22": 8, "i23": 9, "i33": 10}, "EDGE2": {"i11": 5, "i12": 6, "i22": 7, "i33": 8, "i13": 9, "i23": 10}, "EDGE_SE2_XY": {"i11": 4, "i12": 5, "i22": 6}}
KINDS = {"EDGE_SE2": "P", "EDGE2": "P", "EDGE_SE2_XY": "L"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """graph_id (the file's name without its ending), line_no, line. A file is read whole, as the place of a line matters."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("graph_id"), "value")
    return files.select("graph_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def _split(lines: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """graph_id, line_no, p (a line's fields, the tag first) of lines that hold anything; with `tags` lines that can't have one of them go before they are split."""
    if tags is not None:
        begins = F.lit(False)
        for tag in tags:
            begins = begins | F.ltrim("line").startswith(tag)
        lines = lines.filter(begins)
    cleaned = F.trim(F.when(F.contains("line", F.lit("#")), F.regexp_replace("line", "#.*", "")).otherwise(F.col("line")))
    # Filters on generated fields stay behind them; on plain columns they would split each line again for every field they look at.
    return lines.select("graph_id", "line_no", F.explode(F.array(F.split(cleaned, " +"))).alias("p")).filter(F.element_at("p", 1) != "")


def tokens(lines: DataFrame) -> DataFrame:
    """graph_id, line_no, tag, f (the other fields) of lines that hold anything."""
    return _split(lines).select("graph_id", "line_no", F.element_at("p", 1).alias("tag"), F.slice("p", 2, F.size("p")).alias("f"))


def _number(i: int) -> Column:
    return F.coalesce(F.try_element_at("p", F.lit(i + 2)).try_cast("double"), F.lit(float("nan")))


def _id(i: int) -> Column:
    return F.try_element_at("p", F.lit(i + 2)).try_cast("double").cast("long")


def _known(lines: DataFrame, tags: dict[str, int]) -> DataFrame:
    """_split with tag, of lines with one of the tags and enough fields."""
    wanted = F.lit(False)
    for tag, fewest in tags.items():
        wanted = wanted | ((F.element_at("p", 1) == tag) & (F.size("p") > fewest))
    return _split(lines, list(tags)).filter(wanted).withColumn("tag", F.element_at("p", 1))


def parse_nodes(lines: DataFrame, tags: dict[str, int]) -> DataFrame:
    """graph_id, node_id, dim, x, y, theta, file_pos; of vertices with one id the last counts."""
    flat = F.col("tag") == "VERTEX_XY"
    rows = _known(lines, {k: v for k, v in tags.items() if k.startswith("VERTEX")}).filter(_id(0).isNotNull())
    named = rows.select("graph_id", _id(0).alias("node_id"), F.struct(F.col("line_no").alias("file_pos"), F.when(flat, 2).otherwise(3).alias("dim"), _number(1).alias("x"), _number(2).alias("y"), F.when(~flat, _number(3)).alias("theta")).alias("v"))
    last = named.groupBy("graph_id", "node_id").agg(F.max_by("v", "v.file_pos").alias("v"))
    return last.select("graph_id", "node_id", "v.dim", "v.x", "v.y", "v.theta", "v.file_pos")


def parse_edges(lines: DataFrame, tags: dict[str, int]) -> DataFrame:
    """graph_id, line_no, type, from_id, to_id, z1, z2, z3 and the information's upper triangle."""
    rows = _known(lines, {k: v for k, v in tags.items() if k.startswith("EDGE")}).filter(_id(0).isNotNull() & _id(1).isNotNull())
    kind, info = F.lit(None).cast("string"), {}
    for tag, name in KINDS.items():
        kind = F.when(F.col("tag") == tag, name).otherwise(kind)
    for name in ("i11", "i12", "i13", "i22", "i23", "i33"):
        value = F.lit(0.0)
        for tag, places in INFORMATION.items():
            if name in places:
                value = F.when(F.col("tag") == tag, _number(places[name])).otherwise(value)
        info[name] = value
    return rows.select("graph_id", "line_no", kind.alias("type"), _id(0).alias("from_id"), _id(1).alias("to_id"), _number(2).alias("z1"), _number(3).alias("z2"), F.when(kind == "P", _number(4)).alias("z3"), *[v.alias(k) for k, v in info.items()])


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge endpoints without a node: graph_id, node_id."""
    ends = edges.select("graph_id", F.col("from_id").alias("node_id")).unionByName(edges.filter("to_id is not null").select("graph_id", F.col("to_id").alias("node_id")))
    return ends.distinct().join(nodes, ["graph_id", "node_id"], "left_anti")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a .g2o or .graph (TORO) file, or of a folder with nodes.parquet and edges.parquet (a snapshot). Fails if an edge's endpoint is missing."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending in ("g2o", "graph"):
        tags, lines = G2O if ending == "g2o" else TORO, read_lines(spark, path)
        nodes, edges = parse_nodes(lines, tags), parse_edges(lines, tags)
        from pyspark.sql import Window

        edges = edges.withColumn("edge_pos", F.row_number().over(Window.partitionBy("graph_id").orderBy("line_no")).cast("long")).drop("line_no")
    elif "/" in path and ending != "mat" and "." not in path.rstrip("/").rpartition("/")[2]:
        nodes, edges = spark.read.parquet(f"{path}/nodes.parquet"), spark.read.parquet(f"{path}/edges.parquet")
    else:
        raise ValueError(f"unknown graph format: {path}")
    missing = dangling(nodes, edges).limit(1).collect()
    if missing:
        raise ValueError(f"edge endpoint {missing[0]['node_id']} of graph {missing[0]['graph_id']} has no node")
    return nodes, edges


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes.parquet")
    edges.write.mode("overwrite").parquet(f"{path}/edges.parquet")
