"""Nearest match in time within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucospan.operators.slices import MINUTE_US, SERIES_KEY, SLICE, US, measured_width, sliced


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    *,
    tolerance_minutes: float | Column,
    width_us: int | None = None,
    prefix: str = "matched_",
) -> DataFrame:
    """Left rows with the right row nearest in time (columns prefixed; NULL when none is near).

    The tolerance is inclusive, may be a column of ``left``, and an equal distance goes to the
    earlier row. Inside a slice, running
    "last seen" values over ascending and over descending time give both neighbours with one shuffle
    and two sorts. Where a neighbour lies in another slice it comes from a table with the first and
    last right row of each slice, so slices can be as short as the data are dense.
    """
    keys = list(keys)
    width_us = width_us or min(
        measured_width(left, keys, left_time), measured_width(right, keys, right_time)
    )
    payload = [name for name in right.columns if name not in keys]
    limit = tolerance_minutes if isinstance(tolerance_minutes, Column) else F.lit(float(tolerance_minutes))
    probes = sliced(left, left_time, width_us).select(
        *keys,
        SLICE,
        US,
        F.lit(1).alias("_probe"),
        F.round(limit * MINUTE_US).cast("bigint").alias("_tolerance_us"),
        F.struct(*left.columns).alias("_left"),
    )
    samples = sliced(right, right_time, width_us).select(
        *keys, SLICE, US, F.lit(0).alias("_probe"), F.struct(US, *payload).alias("_seen")
    )
    # One struct for all keys: it is never NULL, so rows without an id find each other as well.
    both = probes.unionByName(samples, allowMissingColumns=True).withColumn(SERIES_KEY, F.struct(*keys))
    run = (Window.unboundedPreceding, Window.currentRow)
    earlier_rows = (Window.unboundedPreceding, -1)

    def seen(column: str) -> Column:
        return F.last(column, ignorenulls=True)

    along = Window.partitionBy(SERIES_KEY)
    edges = (
        both.groupBy(SERIES_KEY, SLICE)
        .agg(F.min("_seen").alias("_first"), F.max("_seen").alias("_last"))
        .select(
            SERIES_KEY,
            SLICE,
            seen("_last").over(along.orderBy(SLICE).rowsBetween(*earlier_rows)).alias("_before"),
            seen("_first").over(along.orderBy(F.col(SLICE).desc()).rowsBetween(*earlier_rows)).alias("_after"),
        )
    )
    place = Window.partitionBy(SERIES_KEY, SLICE)
    # At equal times samples come before probes in both directions, so an exact hit is seen.
    inside = both.withColumns(
        {
            "_earlier": seen("_seen").over(place.orderBy(US, "_probe").rowsBetween(*run)),
            "_later": seen("_seen").over(place.orderBy(F.col(US).desc(), "_probe").rowsBetween(*run)),
        }
    ).where("_probe = 1")
    found = inside.join(edges, [SERIES_KEY, SLICE]).withColumns(
        {"_earlier": F.coalesce("_earlier", "_before"), "_later": F.coalesce("_later", "_after")}
    )
    back = F.col(US) - F.col(f"_earlier.{US}")
    ahead = F.col(f"_later.{US}") - F.col(US)
    use_earlier = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    nearest = F.when(use_earlier, F.col("_earlier")).otherwise(F.col("_later"))
    near = F.least(back, ahead) <= F.col("_tolerance_us")
    return found.withColumn("_match", F.when(near, nearest)).select(
        "_left.*", *[F.col(f"_match.{name}").alias(prefix + name) for name in payload]
    )


def future_matches(
    samples: DataFrame,
    keys: Sequence[str],
    time: str,
    *,
    ahead_minutes: float = 30,
    tolerance_minutes: float | Column = 7.5,
    width_us: int | None = None,
) -> DataFrame:
    """Each sample with the sample nearest to ``ahead_minutes`` later.

    Adds ``matched_timestamp`` and ``hit``; a match at or before the sample itself is no hit.
    """
    width_us = width_us or measured_width(samples, keys, time)
    whole, rest = divmod(ahead_minutes * 60, 60)
    shift = F.make_dt_interval(mins=F.lit(int(whole)), secs=F.lit(float(rest)))
    matched = asof_nearest(
        samples.withColumn("_wanted", F.col(time) + shift),
        samples.select(*keys, F.col(time).alias("timestamp")),
        keys,
        "_wanted",
        "timestamp",
        tolerance_minutes=tolerance_minutes,
        width_us=width_us,
    )
    hit = F.coalesce(F.col("matched_timestamp") > F.col(time), F.lit(False))
    return matched.withColumn("hit", hit).drop("_wanted")
