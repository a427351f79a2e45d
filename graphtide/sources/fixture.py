"""Pose graphs derived from the events table: one trajectory for each user, or with `whole` one of all events.

nodes: graph_id, node_id, dim, x, y, theta; edges: graph_id, edge_pos, type, from_id, to_id, z1, z2, z3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphtide.operators.kept import tasks_for
from graphtide.operators.prefix import running_sums

#: Landmarks are numbered from here.
LANDMARKS, WHOLE_LANDMARKS = 1_000_000, 1_000_000_000_000
#: The upper triangle i11, i12, i13, i22, i23, i33 of each kind's information matrix.
INFORMATION = {"P": (4.0, 0.5, 0.0, 4.0, 0.0, 16.0), "L": (2.0, 0.25, 0.0, 2.0, 0.0, 0.0), "G": (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)}


def _events(spark: SparkSession, sf_dir: str, whole: bool) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    if whole:
        bought = F.coalesce((F.col("event_type") == "purchase").cast("long"), F.lit(0).cast("long"))
        rows = running_sums(ev.select(F.lit(0).cast("long").alias("graph_id"), F.col("event_id").alias("e"), "event_type", "ts"), ["graph_id"], ["ts", "e"], {"place": F.lit(1).cast("long"), "bought": bought})
        return rows.select("graph_id", "e", "event_type", (F.col("place") - 1).alias("k"), "bought").crossJoin(ev.agg((F.count(F.lit(1)) - 1).alias("last")))
    # Named before it is dealt out, so that what follows by graph needs no second shuffle.
    ev = ev.select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("e"), "event_type", "ts")
    # Memory of a task doesn't grow with the input.
    if (tasks := tasks_for(ev)) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        ev = ev.repartition(tasks, "graph_id")
    place = Window.partitionBy("graph_id").orderBy("ts", "e")
    return ev.select("graph_id", "e", "event_type", (F.row_number().over(place) - 1).cast("long").alias("k"))


def nodes(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    ev, e = _events(spark, sf_dir, whole), F.col("e")
    poses = ev.select("graph_id", F.col("k").alias("node_id"), F.lit(3).alias("dim"), F.col("k").cast("double").alias("x"), ((e % 16) / 8.0).alias("y"), (e * 7 % 64 / 16.0 - 2.0).alias("theta"))
    marks = ev.filter("k % 3 = 0").select("graph_id", (e % 5).alias("m")).distinct().select("graph_id", (F.col("m") + (WHOLE_LANDMARKS if whole else LANDMARKS)).alias("node_id"), F.lit(2).alias("dim"), (F.col("m") * 4.0).alias("x"), (F.col("m") * 0.5 - 1.0).alias("y"), F.lit(None).cast("double").alias("theta"))
    return poses.unionByName(marks)


def edges(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """In file order: odometry, pose closures, landmark sights, position fixes. An odometry edge beyond the last pose isn't made."""
    e, k = F.col("e"), F.col("k")
    ev = _events(spark, sf_dir, whole)
    if not whole:
        ev = ev.withColumn("last", F.max("k").over(Window.partitionBy("graph_id")))
    none = F.lit(None)
    across, turn = (e % 8 - 4) / 8.0, (e % 16 - 8) / 16.0
    made = lambda grp, kind, to, z1, z2, z3: F.struct(F.lit(grp).alias("grp"), F.lit(kind).alias("type"), to.cast("long").alias("to_id"), z1.cast("double").alias("z1"), z2.cast("double").alias("z2"), z3.cast("double").alias("z3"))
    kinds = F.array(
        F.when(k < F.col("last"), made(0, "P", k + 1, F.lit(1.0), across, turn)),
        F.when((k >= 10) & (k % 7 == 0), made(1, "P", k - 10, F.lit(-10.0), across, turn)),
        F.when(k % 3 == 0, made(2, "L", e % 5 + (WHOLE_LANDMARKS if whole else LANDMARKS), (e % 32 - 16) / 4.0, (e % 8 - 4) / 4.0, none)),
        F.when(F.col("event_type") == "purchase", made(3, "G", none, k + (e % 4 - 2) / 4.0, e % 8 / 4.0, none)),
    )
    # One pass over the events makes edges of all kinds.
    raw = ev.select("graph_id", "k", *(["last", "bought"] if whole else []), F.explode(F.array_compact(kinds)).alias("m")).select("graph_id", "k", k.alias("from_id"), *(["last", "bought"] if whole else []), "m.*")
    if whole:
        # Numbers by (grp, k), from the numbers of the poses: k has none missing.
        last = F.col("last")
        closures, sights = F.greatest(F.floor(last / 7) - 1, F.lit(0)), F.floor(last / 3) + 1
        place = F.when(F.col("grp") == 0, k + 1).when(F.col("grp") == 1, last + F.floor(k / 7) - 1).when(F.col("grp") == 2, last + closures + F.floor(k / 3) + 1).otherwise(last + closures + sights + F.col("bought"))
        return raw.select("graph_id", place.cast("long").alias("edge_pos"), "type", "from_id", "to_id", "z1", "z2", "z3")
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy("grp", "k")).cast("long")
    return raw.withColumn("edge_pos", place).select("graph_id", "edge_pos", "type", "from_id", "to_id", "z1", "z2", "z3")


def with_information(edges: DataFrame) -> DataFrame:
    """`edges` with i11, i12, i13, i22, i23, i33."""
    for n, name in enumerate(("i11", "i12", "i13", "i22", "i23", "i33")):
        value = F.lit(0.0)
        for kind, parts in INFORMATION.items():
            value = F.when(F.col("type") == kind, parts[n]).otherwise(value)
        edges = edges.withColumn(name, value)
    return edges


def ground_truth(nodes: DataFrame) -> DataFrame:
    """Poses turned, moved and slightly disturbed."""
    i = F.col("node_id")
    return nodes.filter("dim = 3").select("graph_id", "node_id", (F.col("x") * 0.6 - F.col("y") * 0.8 + 3 + (i % 5 - 2) / 64.0).alias("x"), (F.col("x") * 0.8 + F.col("y") * 0.6 - 1 + (i % 3 - 1) / 32.0).alias("y"), "theta")
