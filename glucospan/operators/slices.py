"""Time-sliced layout: how one very long series is spread over many tasks.

A window partitioned by the series id alone puts a whole series into one task, and one series may
hold a third of all rows. Every ordered operator here therefore partitions by
``(series, slice)``, where a slice is a fixed stretch of time:

* an operator that adds up a bounded stretch of time sends values to the slices they reach (``sums``);
* an operator that needs the position within the whole series adds up row counts of earlier slices
  in the slice table, which holds one row per (series, slice) (``slice_table``, ``ranked``);
* a fact known per series (cadence, static attributes) reaches the rows through the slice table as
  well, so the join key is (series, slice) and never the hot series id alone.

The slice width follows the densest hour of the densest series (``measured_width``).
Times are counted in microseconds, zone-less ones on a clock without daylight-saving changes whatever
the session's zone. Rows without an id form one series of their own: joins go by ``SERIES_KEY``, a
struct of the id columns, which is never NULL itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucospan.storage import stored

US = "_us"
SLICE = "_slice"
SERIES_KEY = "_series"

MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US


def minutes(count: float) -> int:
    return int(round(count * MINUTE_US))


def micros(time: str) -> Column:
    """Microseconds since 1970; a zone-less time counts as it stands, whatever the session's zone.

    The type is known when the plan is made, so one of the two forms is left in it.
    """
    local = F.col(time).cast("timestamp_ntz")
    clock = (F.hour(local) * 60 + F.minute(local)).cast("bigint") * MINUTE_US
    within = (F.extract(F.lit("SECOND"), local) * 1_000_000).cast("bigint")
    zoneless = F.unix_date(local.cast("date")).cast("bigint") * DAY_US + clock + within
    return F.when(F.typeof(time) == "timestamp", F.unix_micros(F.col(time).cast("timestamp"))).otherwise(zoneless)


def slice_of(us: Column, width_us: int) -> Column:
    """Integer slice number, exact also before 1970 (a double division is not)."""
    shifted = us - F.pmod(us, F.lit(width_us))
    return (shifted / F.lit(width_us)).cast("bigint")


def measured_width(
    df: DataFrame,
    series: Sequence[str],
    time: str,
    *,
    at_most_us: int = 28 * DAY_US,
    rows_per_slice: int = 250_000,
) -> int:
    """Slice width at which no slice of any series has many more than ``rows_per_slice`` rows.

    Rows are counted by the hour. Where an hour has too many, the width follows the time that its rows really
    take up, and is counted again, so that a burst of any density is cut; rows of a single time cannot be. Each
    pass reads the id and time columns and counts map-side; a single row reaches the driver.
    """
    rows = df.where(F.col(time).isNotNull()).select(*series, micros(time).alias(US))
    cell = HOUR_US
    while True:
        cells = rows.groupBy(*series, slice_of(F.col(US), cell).alias("_cell")).agg(
            F.count(F.lit(1)).alias("n"), (F.max(US) - F.min(US)).alias("span")
        )
        crowded = (F.col("n") > rows_per_slice) & (F.col("span") > 0)
        # n rows have n - 1 gaps.
        room = F.floor(F.col("span") * F.lit(rows_per_slice) / (F.col("n") - 1))
        found = cells.agg(F.max("n").alias("n"), F.min(F.when(crowded, room)).alias("room")).first()
        if found["n"] is None:
            return at_most_us
        if found["room"] is None:
            if cell == HOUR_US:
                cell = max(cell, HOUR_US * rows_per_slice // found["n"])
            return min(at_most_us, cell)
        cell = max(1, min(cell // 2, int(found["room"])))


#: Raw rows for each task of a wide shuffle.
ROWS_PER_TASK = 100_000


def tasks_for(spark, rows: int) -> int:
    """Partitions of a wide shuffle. Spark would merge them by compressed bytes, which say little about memory."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def sliced(df: DataFrame, time: str, width_us: int) -> DataFrame:
    """Add microseconds and slice number; rows without a time are dropped."""
    return (
        df.where(F.col(time).isNotNull())
        .withColumn(US, micros(time))
        .withColumn(SLICE, slice_of(F.col(US), width_us))
    )


def slice_table(rows: DataFrame, series: Sequence[str]) -> DataFrame:
    """One row per (series, slice): its rows, the rows before it, the series totals and edges.

    The aggregate combines map-side, so the windows below only see slice-level rows.
    """
    order = Window.partitionBy(*series).orderBy(SLICE)
    whole = Window.partitionBy(*series)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.groupBy(*series, SLICE)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.min(US).alias("_first_us"),
            F.max(US).alias("_last_us"),
        )
        .select(
            *series,
            SLICE,
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("_rows").over(whole).alias("series_rows"),
            F.min("_first_us").over(whole).alias("series_start_us"),
            F.lag("_last_us", 1).over(order).alias("previous_last_us"),
        )
    )


def with_slice_facts(
    rows: DataFrame,
    series: Sequence[str],
    columns: Sequence[str],
    *,
    facts: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Join columns of the slice table, and per-series ``facts``, to sliced rows on (series, slice).

    Adds ``SERIES_KEY`` too: a window by (``SERIES_KEY``, slice) that follows needs no second shuffle.
    Series without facts drop out. ``tasks`` is the number of partitions of that shuffle, or Spark's own choice.
    """
    key = F.struct(*series).alias(SERIES_KEY)
    table = slice_table(rows, series).select(key, SLICE, *columns)
    if facts is not None:
        known = facts.select(key, *[n for n in facts.columns if n not in series])
        table = table.join(known, SERIES_KEY)
    keyed = rows.select("*", key)
    placed = keyed.repartition(tasks, SERIES_KEY, SLICE) if tasks else keyed
    return placed.join(table, [SERIES_KEY, SLICE])


def ranked(
    df: DataFrame,
    series: Sequence[str],
    time: str,
    *,
    tiebreak: Sequence[str] = (),
    width_us: int | None = None,
    rank: str = "rn",
    facts: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Position of each row in its whole series (from 1) plus ``series_rows``.

    Equals ``row_number() over (partition by series order by time, tiebreak)`` without ever
    sorting a whole series in one task. ``facts`` are columns per series to add on the way.
    """
    width_us = width_us or measured_width(df, series, time)
    rows = with_slice_facts(sliced(df, time, width_us), series, ["rows_before", "series_rows"], facts=facts, tasks=tasks)
    local = Window.partitionBy(SERIES_KEY, SLICE).orderBy(US, *tiebreak)
    return rows.withColumn(rank, F.row_number().over(local) + F.col("rows_before")).drop(
        US, SLICE, SERIES_KEY, "rows_before"
    )


def global_rank(df: DataFrame, order: Sequence[str | Column], rank: str = "rn") -> DataFrame:
    """Consecutive position from 1 over a full order.

    Rows are range-partitioned by the order and stored, numbered inside each range, and moved on by
    the number of rows in earlier ranges: one small row per range, no task that sees all rows.
    """
    keys = {f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    keyed = df.withColumns(keys)
    parts = stored(keyed.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    sizes = parts.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*keys)
    return (
        parts.withColumn(rank, F.row_number().over(inside))
        .join(before, "_range")
        .withColumn(rank, F.col(rank) + F.col("_before"))
        .drop("_range", "_before", *keys)
    )


def with_series_facts(
    rows: DataFrame, facts: DataFrame, series: Sequence[str], *, place: bool = False, tasks: int | None = None
) -> DataFrame:
    """Join per-series facts to sliced rows on (series, slice); series without facts drop out.

    ``place`` shuffles the rows by (series, slice) before the join, for windows that follow: should
    the join turn out to be a broadcast, the first window would otherwise shuffle by its own longer
    key, and the next one again. ``tasks`` is the number of partitions then.
    """
    slices = rows.groupBy(*series, SLICE).agg(F.lit(1).alias("_one")).drop("_one")
    placed = rows.repartition(*([tasks] if tasks else []), *series, SLICE) if place else rows
    return placed.join(slices.join(facts, list(series)), [*series, SLICE])
