"""From typed raw series to the forecasting table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glucospan.functions.clinical import cyclical, diagnosis_band, hour_of_day
from glucospan.operators.joins import attach_static
from glucospan.operators.slices import (
    SLICE,
    US,
    measured_width,
    sliced,
    tasks_for,
    with_series_facts,
)
from glucospan.operators.windows import Trailing, cadence, timed_shifts, trailing
from glucospan.schema import FEATURES, FORECAST_SCHEMA, SERIES, TARGET, TARGET_TIME, TIME, VALUE, ForecastTable
from glucospan.sources.series_csv import POSITION, read_series, read_static
from glucospan.storage import stored

# Which signals each request may use, best first. A request for the first sensor
# falls through to the second where a series has no usable value of the first.
SIGNALS = {"dexcom": ["dexcom", "libre"], "auto": ["dexcom", "libre"], "libre": ["libre"]}
MIN_ROWS = 60
EVENT_MINUTES = 120
NUTRIENTS = ["carbs", "protein", "fat", "fiber"]


class SeriesError(ValueError):
    """A series cannot be used: no signal or no recognisable cadence."""


def pick_signal(
    df: DataFrame, series: str, signals: list[str], *, usable: DataFrame | None = None
) -> DataFrame:
    """Per series the first signal with any value; series without any are absent."""
    if usable is None:
        usable = df.groupBy(series).agg(*[F.count(name).alias(name) for name in signals])
    choice = F.coalesce(*[F.when(F.col(name) > 0, F.lit(name)) for name in signals])
    return usable.select(series, choice.alias("source")).where("source is not null")


def source_label(facts: DataFrame) -> str:
    """The one source in use, or ``mixed``."""
    row = facts.agg(F.min("source").alias("a"), F.max("source").alias("b")).first()
    if row["a"] is None:
        raise SeriesError("no series has enough usable rows")
    return row["a"] if row["a"] == row["b"] else "mixed"


def series_facts(
    raw: DataFrame, glucose_source: str = "dexcom", *, width_us: int | None = None
) -> DataFrame:
    """Per series: the signal in use, its distinct sample times and its cadence.

    Both signals are looked at in one pass, keyed by (series, source).
    """
    wanted = glucose_source.lower().strip()
    if wanted not in SIGNALS:
        raise ValueError(f"glucose_source must be one of {sorted(SIGNALS)}")
    names = SIGNALS[wanted]
    values = F.array(*[
        F.struct(F.lit(i).alias("preference"), F.lit(n).alias("source"), F.col(n).alias("v"))
        for i, n in enumerate(names)
    ])
    # Counted, numbered and compared below: three readers.
    stamps = stored(
        raw.where(F.col(SERIES).isNotNull() & F.col(TIME).isNotNull())
        .select(SERIES, TIME, F.inline(values))
        .where("v is not null")
        .select(SERIES, "preference", "source", TIME)
        .distinct()
    )
    best = (
        stamps.groupBy(SERIES, "preference", "source")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy(SERIES)
        .agg(F.min_by(F.struct("source", "rows"), "preference").alias("_best"))
        .select(SERIES, "_best.*")
    )
    best = stored(best)
    width_us = width_us or measured_width(raw, [SERIES], TIME)
    # Only the times of the signal in use make a cadence.
    chosen = attach_static(stamps.drop("preference"), best.select(SERIES, F.col("source").alias("_chosen")), SERIES)
    chosen = chosen.where(F.col("source") == F.col("_chosen"))
    tasks = tasks_for(raw.sparkSession, stamps.count())
    pace = cadence(chosen, [SERIES, "source"], TIME, width_us=width_us, tasks=tasks)
    return best.join(pace, [SERIES, "source"], "left")


def series_status(raw: DataFrame, facts: DataFrame) -> DataFrame:
    """What became of each series: ok, too_few_rows (dropped quietly), no_signal or no_cadence."""
    status = (
        F.when(F.col("source").isNull(), "no_signal")
        .when(F.col("rows") < MIN_ROWS, "too_few_rows")
        .when(F.col("cadence_minutes").isNull(), "no_cadence")
        .otherwise("ok")
    )
    return raw.select(SERIES).distinct().join(facts, SERIES, "left").withColumn("status", status)


def forecast_rows(
    raw: DataFrame,
    static: DataFrame,
    facts: DataFrame,
    *,
    horizon_minutes: int = 30,
    width_us: int | None = None,
) -> DataFrame:
    """The forecasting table of all usable series.

    Rows find their signal through the slice table, the choice among repeated times and the trailing
    windows follow, and the samples with their features are stored: positions are counted over them
    before lags and lead are looked up by position. No step has a shortest slice, so a dense series is
    cut as finely as its rows call for.
    """
    width_us = width_us or measured_width(raw, [SERIES], TIME)
    tasks = tasks_for(raw.sparkSession, raw.count())
    # One row per series, read for the choice of the signal and again for the lags.
    known = stored(
        facts.where((F.col("rows") >= MIN_ROWS) & F.col("cadence_minutes").isNotNull())
        .select(SERIES, "source", "cadence_minutes")
        .join(static, SERIES, "left")
    )
    rows = with_series_facts(sliced(raw, TIME, width_us), known.select(SERIES, "source"), [SERIES], place=True, tasks=tasks)
    rows = rows.withColumn(VALUE, F.when(F.col("source") == "dexcom", F.col("dexcom")).otherwise(F.col("libre")))

    # Of repeated times only the first row with a value is a sample; any row may record an event.
    same_time = Window.partitionBy(SERIES, SLICE, US, F.col(VALUE).isNotNull()).orderBy(*POSITION, VALUE)
    rows = rows.withColumn("_sample_no", F.row_number().over(same_time)).withColumn(
        "_is_sample", F.col(VALUE).isNotNull() & (F.col("_sample_no") == 1)
    )
    specs = [
        Trailing(f"{name}_last_120m", F.when(F.col("is_event"), F.col(name)), EVENT_MINUTES, default=0.0)
        for name in NUTRIENTS
    ] + [
        Trailing("heart_rate_mean_30m", F.when(F.col("_is_sample"), F.col("heart_rate")), 30, "mean", "right"),
        Trailing("mets_mean_60m", F.when(F.col("_is_sample"), F.col("mets")), 60, "mean", "right"),
        Trailing("activity_calories_60m", F.when(F.col("_is_sample"), F.col("activity_calories")), 60, "sum", "right"),
    ]
    measured = [SERIES, TIME, VALUE, "heart_rate", "mets", "activity_calories"]
    samples = stored(
        trailing(
            rows.drop(US, SLICE), [SERIES], TIME, specs, width_us=width_us, keep=measured, where=F.col("_is_sample"), tasks=tasks
        )
    )
    rows = timed_shifts(
        samples, [SERIES], TIME, VALUE, horizon=horizon_minutes, pace=known.drop("source"), width_us=width_us,
        target=TARGET, target_time=TARGET_TIME, tasks=tasks_for(raw.sparkSession, samples.count()),
    )
    hour = hour_of_day(F.col(TIME))
    sin_time, cos_time = cyclical(hour)
    return rows.withColumns(
        {
            "hour": hour,
            "sin_time": sin_time,
            "cos_time": cos_time,
            "diagnosis": diagnosis_band(F.col("hba1c")),
            "glucose_delta_15m": F.col(VALUE) - F.col("glucose_lag_15m"),
        }
    ).select(*[F.col(f.name).cast(f.dataType) for f in FORECAST_SCHEMA])


def load_series_dataset(
    spark,
    root: str,
    *,
    glucose_source: str = "dexcom",
    horizon_minutes: int = 30,
    strict: bool = False,
    staging: str | None = None,
    width_us: int | None = None,
) -> ForecastTable:
    """Read a folder of series files and its static file into a forecasting table.

    A series without a signal or cadence is left out; ``strict`` makes it an error instead. The text is
    parsed once and the typed rows are kept as Parquet, in ``staging`` if that folder is named and
    otherwise among the session's intermediates.
    """
    raw = read_series(spark, root, strict=strict)
    if staging:
        raw.write.mode("overwrite").parquet(staging)
        raw = spark.read.parquet(staging)
    else:
        raw = stored(raw)
    width_us = width_us or measured_width(raw, [SERIES], TIME)
    facts = series_facts(raw, glucose_source, width_us=width_us)
    if strict:
        bad = series_status(raw, facts).where("status in ('no_signal', 'no_cadence')").groupBy("status").count()
        found = {r["status"]: r["count"] for r in bad.collect()}
        if found:
            raise SeriesError(f"unusable series by status: {found}; series_status has a row for each")
    static = read_static(spark, root, raw.select(SERIES))
    used = facts.where((F.col("rows") >= MIN_ROWS) & F.col("cadence_minutes").isNotNull())
    return ForecastTable(
        frame=forecast_rows(raw, static, facts, horizon_minutes=horizon_minutes, width_us=width_us),
        glucose_source=source_label(used),
        horizon_minutes=horizon_minutes,
        feature_columns=list(FEATURES),
    )
