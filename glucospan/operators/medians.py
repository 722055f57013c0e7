"""Exact medians whose memory does not grow with the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Coarse buckets per doubling of the magnitude, and fine buckets inside a coarse one.
COARSE_PER_DOUBLING = 16
FINE_BUCKETS = 65_536


def exact_median(df: DataFrame, keys: Sequence[str], value: str, *, out: str = "median") -> DataFrame:
    """Median per key: the middle value, or the mean of the two middle values; NULL and NaN skipped,
    as are rows with a NULL key.

    Spark's own exact percentile keeps every distinct value of a group in one buffer. Here the
    values are first counted per (key, value), which spreads a hot key over all tasks. A coarse
    bucket that never reverses the order (logarithm of the magnitude) says in which bucket the
    middle ranks fall; only that bucket is cut again, linearly, and only the chosen fine bucket is
    finally put in order. Each step looks at a bounded number of buckets per key.
    """
    # A struct is never NULL itself, so that rows with a NULL key meet in the joins below as well.
    whole, keys = F.struct(*keys).alias("_key"), ["_key"]
    number = F.col(value).cast("double")
    counts = (
        df.where(number.isNotNull() & ~F.isnan(number))
        .groupBy(whole, number.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # The bound only matters for infinite values, whose logarithm fits no integer.
    magnitude = F.least(F.log2(F.abs("_v") + 1.0) * COARSE_PER_DOUBLING, F.lit(1e6))
    coarse = counts.withColumn("_b1", (F.signum("_v") * F.floor(magnitude)).cast("int"))
    # Spark adds such filters to one side of a join only; stated for all branches, they leave the
    # branches equal, so that the counts are worked out and shuffled once.
    coarse = _complete(coarse, [*keys, "_b1"])

    chosen = _middle_buckets(coarse, keys, ["_b1"], first=True)
    fine = coarse.join(chosen, [*keys, "_b1"]).withColumn(
        "_b2",
        F.when(
            F.col("_high") > F.col("_low"),
            F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * FINE_BUCKETS),
        )
        .otherwise(0)
        .cast("int"),
    )
    fine = _complete(fine, ["_b2"])

    last = _middle_buckets(fine, keys, ["_b1", "_b2"], first=False)
    final = fine.select(*keys, "_b1", "_b2", "_v", "_n").join(last, [*keys, "_b1", "_b2"])
    order = Window.partitionBy(*keys, "_b1", "_b2").orderBy("_v")
    reached = F.col("_before") + F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    picked = final.withColumn("_to", reached).withColumn("_from", F.col("_to") - F.col("_n"))
    lower = F.when(_holds(_lower_rank()), F.col("_v"))
    upper = F.when(_holds(_upper_rank()), F.col("_v"))
    middle = picked.groupBy(*keys).agg(((F.max(lower) + F.max(upper)) / 2.0).alias(out))
    return middle.select("_key.*", out)


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for name in columns:
        df = df.where(F.col(name).isNotNull())
    return df


def _lower_rank():
    return F.floor((F.col("_total") - 1) / 2)


def _upper_rank():
    return F.floor(F.col("_total") / 2)


def _holds(rank):
    """The rank (from 0) falls in [_from, _to)."""
    return (F.col("_from") <= rank) & (rank < F.col("_to"))


def _middle_buckets(rows: DataFrame, keys: list[str], buckets: list[str], *, first: bool) -> DataFrame:
    """The one or two buckets per key that hold the middle ranks, and the rows before them."""
    carried = [] if first else [F.first("_total").alias("_total"), F.first("_before").alias("_base")]
    table = rows.groupBy(*keys, *buckets).agg(
        F.sum("_n").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), *carried
    )
    if first:
        whole, base = Window.partitionBy(*keys), F.lit(0)
        table = table.withColumn("_total", F.sum("_rows").over(whole))
        order = Window.partitionBy(*keys).orderBy(*buckets)
    else:
        # Ranks inside a coarse bucket count on from the rows before that bucket.
        base = F.col("_base")
        order = Window.partitionBy(*keys, buckets[0]).orderBy(*buckets[1:])
    reached = F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, 0)) + base
    ranged = table.withColumn("_to", reached).withColumn("_from", F.col("_to") - F.col("_rows"))
    return ranged.where(_holds(_lower_rank()) | _holds(_upper_rank())).select(
        *keys,
        *buckets,
        "_total",
        F.col("_from").alias("_before"),
        *(["_low", "_high"] if first else []),
    )
