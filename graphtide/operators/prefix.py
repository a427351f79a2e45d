"""Running sums and numbers over groups of any size, without a task that holds a whole group.

Rows are dealt out by ranges of (keys, order). Each range sums for itself; a group's totals in the ranges before are added.
A window over the group would bring it into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphtide.operators.kept import kept

#: A row's place within its partition, in the lower bits of Spark's monotonically increasing numbers.
PLACE_BITS = 33


def _columns(order: list[Column | str]) -> dict[str, Column]:
    return {f"_o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}


def running_sums(df: DataFrame, keys: list[str], order: list[Column | str], values: dict[str, Column | str], inclusive: bool = True, tasks: int | None = None, part: Column | None = None) -> DataFrame:
    """`df` with each of `values`' names, the sum of its column over the rows of its group up to and with this row, or before it. `order` must tell a group's rows apart.

    `tasks`: how many ranges, where the session's number of partitions would make them large. `part`: the range's number,
    where one that never falls along `order` is known and holds few rows; then no ranges have to be found. `df` is read twice.
    """
    places = _columns(order)
    sums = {f"_v{i}": F.col(v) if isinstance(v, str) else v for i, v in enumerate(values.values())}
    rows = df.withColumns(places | sums)
    # A range's number must not change when a task is repeated, so ranges that Spark finds are kept.
    ranged = rows.withColumn("_part", part) if part is not None else kept(rows.repartitionByRange(*([tasks] if tasks else []), *keys, *places).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_total{v}") for v in sums])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Kept, so that Spark sees how small they are.
    offsets = kept(totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_total{v}").over(before), F.lit(0)).alias(f"_before{v}") for v in sums]))
    within = Window.partitionBy("_part", *keys).orderBy(*places).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    summed = (ranged.repartition(tasks, "_part", *keys) if tasks else ranged).select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_sum{v}") for v in sums])
    return summed.join(offsets, [*keys, "_part"]).select(*df.columns, *[(F.col(f"_sum{v}") + F.col(f"_before{v}")).alias(name) for v, name in zip(sums, values, strict=True)])


def running_sum(df: DataFrame, keys: list[str], order: list[Column | str], value: Column | str, name: str, inclusive: bool = True, tasks: int | None = None, part: Column | None = None) -> DataFrame:
    """running_sums() of one column."""
    return running_sums(df, keys, order, {name: value}, inclusive, tasks, part)


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str, tasks: int | None = None) -> DataFrame:
    """`df` with `name`, the row's number from 1 within its group. Ranges are sorted as they are written, and a row's place there is its number but for the rows before its group's first."""
    places = _columns(order)
    rows = df.withColumns(places).repartitionByRange(*([tasks] if tasks else []), *keys, *places).sortWithinPartitions(*keys, *places)
    ranged = kept(rows.select(*df.columns, F.monotonically_increasing_id().alias("_id")))
    part, at = F.shiftright("_id", PLACE_BITS).alias("_part"), F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1)
    totals = ranged.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_total"), F.min(at).alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept(totals.select(*keys, "_part", (F.coalesce(F.sum("_total").over(before), F.lit(0)) - F.col("_first") + 1).alias("_before")))
    return ranged.withColumn("_part", part).join(offsets, [*keys, "_part"]).select(*df.columns, (at + F.col("_before")).alias(name))
