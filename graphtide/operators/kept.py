"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one on a single machine, as in tests, and an error on a cluster."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="graphtide-")


def kept(df: DataFrame) -> DataFrame:
    """`df` as a written table, which goes with the application; a lost executor costs no more than what follows.

    Unlike a checkpoint it brings no constraints or partitionings along, which loops that join a table with itself would double at each step.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/kept-{uuid.uuid4()}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def kept_in_small_methods(df: DataFrame) -> DataFrame:
    """`kept`, for expressions so long that one generated method of a stage would be beyond the 8,000 bytes that the JVM compiles; it would interpret them for each row. Spark then generates a method for each part."""
    conf = df.sparkSession.conf
    before = conf.get(METHOD_LIMIT, None)
    conf.set(METHOD_LIMIT, "8000")
    try:
        return kept(df)
    finally:
        conf.unset(METHOD_LIMIT) if before is None else conf.set(METHOD_LIMIT, before)


#: Rows of a task, where a stated number of tasks keeps its memory from growing with the input.
ROWS = 1 << 18


def tasks_for(table: DataFrame) -> int:
    """How many tasks a table that is read from files should be dealt to: the session's number, or more so that each has about ROWS rows. Counts by the files' footers."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // ROWS))


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed now; what Spark knows of its partitioning stays known."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
