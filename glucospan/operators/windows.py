"""Time-bounded windows, lags and gaps over the sliced layout (see ``slices`` and ``sums``)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucospan.functions.text import nan_to_null
from glucospan.operators import medians
from glucospan.operators.arrow import whole_groups
from glucospan.operators.slices import (
    MINUTE_US,
    SERIES_KEY,
    SLICE,
    US,
    measured_width,
    micros,
    minutes,
    ranked,
    sliced,
    with_slice_facts,
)
from glucospan.operators.sums import window_sums


@dataclass(frozen=True)
class Trailing:
    """One trailing aggregate over ``value``.

    ``closed="both"`` takes [t - minutes, t], ``closed="right"`` takes (t - minutes, t].
    ``default`` is the result when the window holds no value.
    """

    name: str
    value: Column
    minutes: float
    agg: str = "sum"
    closed: str = "both"
    default: float | None = None


def trailing(
    df: DataFrame,
    series: Sequence[str],
    time: str,
    specs: Sequence[Trailing],
    *,
    width_us: int | None = None,
    keep: Sequence[str] | None = None,
    where: Column | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Trailing aggregates of every row (see ``sums``); all specs share one shuffle.

    NaN counts as missing, rows without a time drop out, and rows without an id form one series. Only columns in
    ``keep`` and rows ``where`` a condition holds are sent along and returned; the windows hold the values of all rows.
    ``tasks`` is the number of partitions of the shuffle, or Spark's own choice.
    """
    width_us = width_us or measured_width(df, series, time)
    held = {f"_v{i}": nan_to_null(spec.value.cast("double")) for i, spec in enumerate(specs)}
    # A window that includes its start is one microsecond longer than one that does not.
    lengths = {
        f"_v{i}": minutes(spec.minutes) + (1 if spec.closed == "both" else 0) for i, spec in enumerate(specs)
    }
    sample = F.struct(*(df.columns if keep is None else keep))
    rows = df.select(
        *[F.col(c) for c in dict.fromkeys([*series, time])],
        (sample if where is None else F.when(where, sample)).alias("_sample"),
        *[v.alias(n) for n, v in held.items()],
    )
    found = window_sums(rows, series, time, "_sample", lengths, width_us, tasks)
    out = {}
    for i, spec in enumerate(specs):
        total = F.col(f"_v{i}") / F.col(f"_v{i}_n") if spec.agg == "mean" else F.col(f"_v{i}")
        out[spec.name] = F.coalesce(total, F.lit(spec.default).cast("double"))
    return found.select("_sample.*", *[c.alias(n) for n, c in out.items()])


def steps(span_minutes: float, cadence: Column) -> Column:
    """Rows that make up ``span_minutes`` at a cadence: half rounds to even, one row at least."""
    return F.greatest(F.lit(1), F.bround(F.lit(float(span_minutes)) / cadence, 0).cast("int"))


def tolerance_minutes(cadence: Column) -> Column:
    return F.greatest(F.lit(2.0), cadence * 2.0)


MAX_GAP_MINUTES = 30


def timed_shifts(
    df: DataFrame,
    series: Sequence[str],
    time: str,
    value: str,
    *,
    lags: Sequence[float] = (15, 30),
    horizon: float = 30,
    pace: DataFrame | None = None,
    tiebreak: Sequence[str] = (),
    width_us: int | None = None,
    lag_name: str = "glucose_lag_{}m",
    target: str = "target_30m",
    target_time: str = "target_timestamp",
    tasks: int | None = None,
) -> DataFrame:
    """Lags and a lead by a per-series number of rows, kept only where the elapsed time fits.

    The step follows the cadence of the series, which comes from ``pace`` (``series``,
    ``cadence_minutes``) or is measured, and is added to the rows. Each row is numbered in its series, and the
    series is cut into blocks of at least four steps. Rows near an edge of a block are copied, values alone, to the
    block beside it; everything else is sent once, and a step may have any size.
    """
    width_us = width_us or measured_width(df, series, time)
    if pace is None:
        pace = cadence(df, series, time, width_us=width_us)
    pace_column = F.col("cadence_minutes")
    rows = ranked(df, series, time, tiebreak=tiebreak, width_us=width_us, rank="_at", facts=pace, tasks=tasks).drop("series_rows")
    moves = [-steps(span, pace_column) for span in lags] + [steps(horizon, pace_column)]
    rows = rows.select(
        *series,
        F.struct(*[n for n in rows.columns if n != "_at"]).alias("_row"),
        F.struct(F.col(value).alias("v"), F.col(time).alias("t"), micros(time).alias("us")).alias("_seen"),
        F.array(*[m.cast("bigint") for m in moves]).alias("_moves"),
        F.col("_at").cast("bigint").alias("_at"),
    )
    size = F.greatest(F.lit(BLOCK_ROWS), F.array_max(F.transform("_moves", F.abs)) * 4)
    home = F.floor(F.col("_at") / size)
    # A row is read by those that lie as far behind it as their lag, or as far before it as their lead.
    readers = F.transform("_moves", lambda m: F.floor((F.col("_at") - m) / size))
    rows = rows.withColumn("_home", home).withColumn("_block", F.explode(F.array_distinct(F.concat(F.array(home), readers))))
    at_home = F.col("_block") == F.col("_home")
    placed = rows.select(
        *series, "_block", "_at", at_home.alias("_here"), F.when(at_home, F.col("_row")).alias("_row"), "_seen", "_moves"
    )
    keys = [*series, "_block"]
    placed = placed.repartition(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys, "_at")
    kind = placed.schema["_seen"].dataType
    schema = T.StructType(
        [T.StructField("_row", placed.schema["_row"].dataType), T.StructField("_seen", kind)]
        + [T.StructField(f"_seen{i}", kind) for i in range(len(moves))]
    )
    met = placed.mapInArrow(_looked_up(keys, len(moves)), schema)
    tolerance = tolerance_minutes(F.col("_row.cadence_minutes"))
    fits = F.lit(True)
    for i, span in enumerate([*lags, horizon]):
        apart = F.abs(F.col(f"_seen{i}.us") - F.col("_seen.us")) / F.lit(MINUTE_US)
        fits = fits & (F.abs(apart - F.lit(float(span))) <= tolerance)
    ahead = f"_seen{len(moves) - 1}"
    return met.where(fits).select(
        "_row.*",
        *[F.col(f"_seen{i}.v").alias(lag_name.format(int(span))) for i, span in enumerate(lags)],
        F.col(f"{ahead}.v").alias(target),
        F.col(f"{ahead}.t").alias(target_time),
    )


#: Positions of a series that are looked up together, at least.
BLOCK_ROWS = 4096


def _looked_up(keys: Sequence[str], moves: int):
    """For each row at home what lies at its position plus each move, within the same block."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(parts, list(keys)):
            column = {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
            place = group << 40 | column["_at"].to_numpy()
            here = column["_here"].to_numpy(zero_copy_only=False)
            steps = column["_moves"].flatten().to_numpy().reshape(-1, moves)[here]
            out = [column["_row"].filter(pa.array(here)), column["_seen"].filter(pa.array(here))]
            for i in range(moves):
                wanted = place[here] + steps[:, i]
                found = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
                out.append(column["_seen"].take(pa.array(found, mask=place[found] != wanted)))
            yield pa.RecordBatch.from_arrays(out, names=["_row", "_seen", *(f"_seen{i}" for i in range(moves))])

    return batches


def gaps(
    df: DataFrame,
    series: Sequence[str],
    time: str,
    *,
    width_us: int | None = None,
    name: str = "gap_us",
    tasks: int | None = None,
) -> DataFrame:
    """Microseconds since the previous row of the series; NULL on its first row.

    The first row of a slice takes the last time of the nearest earlier slice from the slice table,
    however long ago that was.
    """
    width_us = width_us or measured_width(df, series, time)
    rows = with_slice_facts(sliced(df, time, width_us), series, ["previous_last_us"], tasks=tasks)
    inside = F.lag(US, 1).over(Window.partitionBy(SERIES_KEY, SLICE).orderBy(US))
    return rows.withColumn(name, F.col(US) - F.coalesce(inside, F.col("previous_last_us"))).drop(
        US, SLICE, SERIES_KEY, "previous_last_us"
    )


def cadence(
    df: DataFrame,
    series: Sequence[str],
    time: str,
    *,
    max_gap_minutes: float = MAX_GAP_MINUTES,
    width_us: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Median of the positive gaps up to ``max_gap_minutes``, one row per series that has any."""
    between = gaps(df.select(*series, time), series, time, width_us=width_us, tasks=tasks)
    usable = between.where((F.col("gap_us") > 0) & (F.col("gap_us") <= minutes(max_gap_minutes)))
    middle = medians.exact_median(usable, series, "gap_us", out="_median_us")
    return middle.select(*series, (F.col("_median_us") / F.lit(MINUTE_US)).alias("cadence_minutes"))


def shift_rows(
    df: DataFrame,
    series: Sequence[str],
    time: str,
    shifts: dict[str, tuple[str, int]],
    *,
    tiebreak: Sequence[str] = (),
    width_us: int | None = None,
    rows_per_block: int = 1_000_000,
) -> DataFrame:
    """Lag (positive) and lead (negative) by fixed row counts, whatever the elapsed time.

    ``shifts`` maps an output column to (input column, rows). Rows are numbered over the series and
    cut into blocks of equal row count; rows near a block edge are copied to the next block. Every
    block has the same size however the times are spread.
    """
    reach = max(abs(count) for _, count in shifts.values())
    block_rows = max(rows_per_block, reach)
    position = F.col("_rn") - 1
    rows = (
        ranked(df, series, time, tiebreak=tiebreak, width_us=width_us, rank="_rn")
        .withColumn(
            "_block",
            F.explode(
                F.sequence(
                    slice_number(F.greatest(position - reach, F.lit(0)), block_rows),
                    slice_number(position + reach, block_rows),
                )
            ),
        )
        .withColumn("_own", F.col("_block") == slice_number(position, block_rows))
    )
    order = Window.partitionBy(*series, "_block").orderBy("_rn")
    out = {
        name: (F.lag(column, count) if count > 0 else F.lead(column, -count)).over(order)
        for name, (column, count) in shifts.items()
    }
    return rows.withColumns(out).where("_own").drop("_rn", "_block", "_own", "series_rows")


def slice_number(position: Column, size: int) -> Column:
    return ((position - F.pmod(position, F.lit(size))) / F.lit(size)).cast("bigint")


def first_per_time(
    df: DataFrame, series: Sequence[str], time: str, tiebreak: Sequence[str | Column]
) -> DataFrame:
    """First row of each (series, time). Spark limits each map task to one row per group first."""
    order = Window.partitionBy(*series, time).orderBy(*tiebreak)
    return df.withColumn("_first", F.row_number().over(order)).where("_first = 1").drop("_first")
