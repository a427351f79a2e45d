"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each row gets a uniform number from a hash of its id and the seed; the Poisson distribution whose mean is its
source's repetition rate is inverted at that number; the row is exploded by the count and all copies are shuffled.

Defined results: rows of a source without a target weight, or with weight 0, get no copy; a null source is a source
like any other; repeated rows with one id get the same count, and all rows with a null id share one; an empty table stays
empty. Texts of any length, empty and null ones are carried along. All columns of the table are kept, whatever their
names, but for one called `replica`, which the copy's number replaces. Copies that tie in the shuffle's hash stand in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtide.llm.common import unused

SEED = 20
#: Share of the target that a source of natural share p gets is p ** TEMPERATURE, normalised.
TEMPERATURE = 0.5
#: Expected copies over rows.
EPOCHS = 1.0
#: Source tables of more rows than this are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def uniform(column: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of the MD5 of "seed:value" (a null value counts as empty)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_count(rate: Column, u: Column) -> Column:
    """The smallest k at which the Poisson distribution function of mean `rate` reaches `u`. Both must be columns, as each step looks at them. The walk covers `rate` plus 12 deviations and 40; beyond, less than 1e-20 of the mass is left."""
    last = F.ceil(rate + F.sqrt(rate) * 12 + 40).cast("int")
    term = lambda k: F.exp(k * F.log(rate) - rate - F.aggregate(F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double"))))
    # Rates to 500 multiply up from exp(-rate); larger ones start at the mean less 14 deviations, where exp(-rate) would vanish.
    first = F.when(rate <= 500, F.lit(0)).otherwise(F.floor(rate - F.sqrt(rate) * 14)).cast("int")
    start = F.struct(F.lit(-1).alias("k"), F.when(rate <= 500, F.exp(-rate)).otherwise(term(first)).alias("p"), F.lit(0.0).alias("cdf"))
    step = lambda s, k: F.when(s["k"] >= 0, s).otherwise(F.struct(F.when(s["cdf"] + s["p"] >= u, k).otherwise(F.lit(-1)).alias("k"), (s["p"] * rate / (k + 1)).alias("p"), (s["cdf"] + s["p"]).alias("cdf")))
    return F.when(rate > 0, F.aggregate(F.sequence(first, last), start, step, lambda s: F.when(s["k"] < 0, last).otherwise(s["k"]))).otherwise(F.lit(0))


def source_rates(df: DataFrame, source: str = "source", weights: DataFrame | None = None, epochs: float = EPOCHS, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n_rows, rate): rate is the mean number of copies. `weights`: (source, weight), of any sum; without it, natural shares to the power `temperature`."""
    counts = df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(temperature)))
    else:
        given = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").alias("weight"))
        counts = counts.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "n_rows", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()
    scale = float(epochs) * total["n"] / total["w"] if total["w"] else 0.0
    return counts.select("source", "n_rows", (F.col("weight") * scale / F.col("n_rows")).alias("rate"))


def replicate(df: DataFrame, key: str = "doc_id", source: str = "source", weights: DataFrame | None = None, epochs: float = EPOCHS, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """All columns of `df` and `replica` (1, 2, ...), in a global random order: partition and place within it follow a hash of the key, the copy and the seed."""
    own, rate, u, times, place = unused(df, "_source", "_rate", "_u", "_count", "_place")
    rates = source_rates(df, source, weights, epochs, temperature).select(F.col("source").alias(own), F.col("rate").alias(rate))
    small = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = df.join(F.broadcast(rates) if small else rates, F.col(source).eqNullSafe(F.col(own)))
    copies = joined.withColumn(u, uniform(F.col(key), seed)).withColumn(times, poisson_count(F.col(rate), F.col(u))).filter(F.col(times) > 0).withColumn("replica", F.explode(F.sequence(F.lit(1), F.col(times))))
    dealt = copies.withColumn(place, F.xxhash64(F.lit(seed + 1), F.col(key), F.col("replica"))).repartition(place).sortWithinPartitions(place)
    return dealt.select(*[F.col(c) for c in df.columns if c.lower() != "replica"], "replica")
