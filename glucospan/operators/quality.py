"""Row validation and sensor diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucospan.operators import asof, medians, windows
from glucospan.operators.slices import MINUTE_US, measured_width
from glucospan.storage import stored


@dataclass(frozen=True)
class Bound:
    """``low <= column <= high``; with ``open_high`` the upper end is excluded."""

    column: str
    low: float
    high: float
    open_high: bool = False

    @property
    def reason(self) -> str:
        return f"{self.column} outside [{self.low:g}, {self.high:g}{')' if self.open_high else ']'}"

    def broken(self) -> Column:
        return self.broken_value(F.col(self.column))

    def broken_value(self, value: Column) -> Column:
        above = value >= self.high if self.open_high else value > self.high
        return F.coalesce((value < self.low) | above | F.isnan(value), F.lit(True))


@dataclass(frozen=True)
class OneOf:
    """The column holds one of the allowed texts."""

    column: str
    allowed: tuple[str, ...]

    @property
    def reason(self) -> str:
        return f"{self.column} not one of {', '.join(self.allowed)}"

    def broken(self) -> Column:
        return ~F.coalesce(F.col(self.column).isin(*self.allowed), F.lit(False))


@dataclass(frozen=True)
class Each:
    """Every struct in an array column keeps a bound on one of its fields."""

    array: str
    bound: Bound

    @property
    def reason(self) -> str:
        return f"{self.array}: {self.bound.reason}"

    def broken(self) -> Column:
        field = self.bound.column
        return F.coalesce(
            F.exists(self.array, lambda item: self.bound.broken_value(item[field])), F.lit(False)
        )


Rule = Bound | OneOf | Each

# The limits of a profile, of a scenario and of its events.
PROFILE_BOUNDS = [
    OneOf("phenotype", ("balanced", "insulin_resistant", "active")),
    Bound("age", 18, 90),
    Bound("baseline_glucose", 70, 220),
    Bound("carb_sensitivity", 0.2, 1.8),
    Bound("activity_sensitivity", 5, 45),
    Bound("stress_sensitivity", 0, 40),
    Bound("circadian_amplitude", 0, 25),
]
SCENARIO_BOUNDS = [
    Bound("stress", 0, 1),
    Bound("sleep_hours", 3, 12),
    Bound("sleep_quality", 0, 1),
]
MEAL_BOUNDS = [Bound("hour", 0, 24, open_high=True), Bound("carbs_g", 0, 250)]
EXERCISE_BOUNDS = [
    Bound("hour", 0, 24, open_high=True),
    Bound("duration_min", 0, 240),
    Bound("intensity", 0, 1),
]
NESTED_BOUNDS = [Each("meals", b) for b in MEAL_BOUNDS] + [Each("exercise", b) for b in EXERCISE_BOUNDS]
REQUEST_BOUNDS = [Bound("step_minutes", 1, 30)]


def validate(df: DataFrame, bounds: Sequence[Rule]) -> DataFrame:
    """Add ``reasons`` (which limits a row breaks) and ``is_valid``; a missing value breaks its limit."""
    reasons = F.array_compact(F.array(*[F.when(b.broken(), F.lit(b.reason)) for b in bounds]))
    return df.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


def split_valid(df: DataFrame, bounds: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    checked = validate(df, bounds)
    valid = checked.where("is_valid").drop("reasons", "is_valid")
    return valid, checked.where("not is_valid").drop("is_valid")


def sort_nested(events: Column, by: str = "hour") -> Column:
    """Order an array of structs by one field; equal fields keep their given order."""
    placed = F.transform(events, lambda e, i: F.struct(e[by].alias("by"), i.alias("at"), e.alias("event")))
    return F.transform(F.array_sort(placed), lambda p: p["event"])


@dataclass(frozen=True)
class Sensor:
    name: str
    value: str
    tolerance_minutes: float


def sensor_diagnostics(
    df: DataFrame,
    series: str,
    time: str,
    sensors: Sequence[Sensor],
    *,
    ahead_minutes: float = 30,
    width_us: int | None = None,
) -> DataFrame:
    """Per series: raw and parsed rows, then per sensor its distinct times, median gap and matches.

    ``df`` holds every raw row, those without a parsed time included. The sample times of all sensors
    form one table keyed by (series, sensor), so gaps, medians and matches each run once.
    """
    width_us = width_us or measured_width(df, [series], time)
    raw = df.groupBy(series).agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count(time).alias("parsed_rows")
    )
    cells = F.array(*[
        F.struct(
            F.lit(s.name).alias("sensor"),
            F.lit(float(s.tolerance_minutes)).alias("tolerance"),
            F.col(s.value).isNotNull().alias("_present"),
        )
        for s in sensors
    ])
    stamps = stored(
        df.where(F.col(time).isNotNull())
        .select(series, time, F.inline(cells))
        .where("_present")
        .select(series, "sensor", "tolerance", time)
        .distinct()
    )
    keys = [series, "sensor"]
    between = windows.gaps(stamps.select(*keys, time), keys, time, width_us=width_us)
    middle = medians.exact_median(between, keys, "gap_us", out="_gap")
    hits = (
        asof.future_matches(
            stamps,
            keys,
            time,
            ahead_minutes=ahead_minutes,
            tolerance_minutes=F.col("tolerance"),
            width_us=width_us,
        )
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("hit")).alias("_pairs"))
    )
    found = hits.join(middle, keys, "left")

    def of(sensor: Sensor, column: Column) -> Column:
        return F.max(F.when(F.col("sensor") == sensor.name, column))

    columns = []
    for s in sensors:
        columns += [
            F.coalesce(of(s, F.col("_rows")), F.lit(0)).alias(f"{s.name}_rows"),
            F.coalesce(of(s, F.col("_pairs")), F.lit(0)).alias(f"{s.name}_future_pairs"),
            of(s, F.col("_gap") / F.lit(MINUTE_US)).alias(f"{s.name}_median_gap_minutes"),
        ]
    counts = [n for s in sensors for n in (f"{s.name}_rows", f"{s.name}_future_pairs")]
    wide = found.groupBy(series).agg(*columns)
    return raw.join(wide, series, "left").fillna(0, subset=counts)


def diagnostics_totals(report: DataFrame, series: str) -> DataFrame:
    """Per-series counts with a grand-total row (series NULL, ``is_total``) in the same pass."""
    counted = [n for n in report.columns if n != series and not n.endswith("_median_gap_minutes")]
    return report.rollup(series).agg(
        *[F.sum(name).alias(name) for name in counted],
        (F.grouping(series) == 1).alias("is_total"),
    )
