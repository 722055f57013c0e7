"""Range metrics per series, error metrics and their summaries. All aggregates combine map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucospan.functions.clinical import HIGH, LOW, VERY_HIGH, VERY_LOW
from glucospan.functions.text import label, nan_to_null
from glucospan.operators import medians
from glucospan.storage import stored


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100.0


def range_metrics(
    df: DataFrame, keys: Sequence[str], value: str, *, digits: int | None = None
) -> DataFrame:
    """Mean, extremes, variation and time in, below and above range; ``digits`` rounds half-even.

    Rows without a value are left out, so a series without any has no metrics row.
    """
    v = nan_to_null(F.col(value).cast("double"))
    mean = F.avg("_v")
    # The metric names.
    out = {
        "mean_glucose": mean,
        "min_glucose": F.min("_v"),
        "max_glucose": F.max("_v"),
        "coefficient_of_variation_pct": F.when(mean == 0.0, 0.0).otherwise(
            F.lit(100.0) * F.stddev_pop("_v") / F.nullif(mean, F.lit(0.0))
        ),
        "time_in_range_pct": _share((F.col("_v") >= LOW) & (F.col("_v") <= HIGH)),
        "time_below_range_pct": _share(F.col("_v") < LOW),
        "time_above_range_pct": _share(F.col("_v") > HIGH),
        "time_very_low_pct": _share(F.col("_v") < VERY_LOW),
        "time_very_high_pct": _share(F.col("_v") > VERY_HIGH),
    }
    aggregates = [
        (F.bround(column, digits) if digits is not None else column).alias(name)
        for name, column in out.items()
    ]
    return (
        df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull()).groupBy(*keys).agg(*aggregates)
    )


def range_bands(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Five shares that split the whole time: very low, low, in range, high, very high."""
    return metrics.select(
        *keys,
        F.col("time_very_low_pct").alias("very_low_pct"),
        F.greatest(F.lit(0.0), F.col("time_below_range_pct") - F.col("time_very_low_pct")).alias("low_pct"),
        F.col("time_in_range_pct").alias("in_range_pct"),
        F.greatest(F.lit(0.0), F.col("time_above_range_pct") - F.col("time_very_high_pct")).alias("high_pct"),
        F.col("time_very_high_pct").alias("very_high_pct"),
    )


def distinct_series(df: DataFrame, series: str) -> DataFrame:
    return df.select(series).where(F.col(series).isNotNull()).distinct().orderBy(series)


def series_header(
    df: DataFrame, series: str, time: str, group: str, measure: str
) -> DataFrame:
    """First and last time of a series with the group and measure of its first row."""
    first = F.min_by(F.struct(group, measure), F.col(time))
    return (
        df.where(F.col(time).isNotNull())
        .groupBy(series)
        .agg(F.min(time).alias("start"), F.max(time).alias("end"), first.alias("_first"))
        .select(
            series,
            F.coalesce(F.nullif(F.col(f"_first.{group}"), F.lit("")), F.lit("unknown")).alias(group),
            F.col(f"_first.{measure}").alias(measure),
            "start",
            "end",
        )
        .withColumn(f"{group}_label", label(F.col(group)))
    )


def paired_compare(
    current: DataFrame,
    reference: DataFrame,
    series: Sequence[str],
    slot: str,
    value: str,
) -> DataFrame:
    """Two runs of the same series on shared slots: metrics of each and current minus reference."""
    pairs = current.select(*series, slot, F.col(value).alias("_current")).join(
        reference.select(*series, slot, F.col(value).alias("_reference")), [*series, slot]
    )

    def side(column: str) -> dict[str, Column]:
        v = F.col(column)
        return {
            "mean": F.avg(v),
            "peak": F.max(v),
            "in_range_pct": _share((v >= LOW) & (v <= HIGH)),
        }

    aggregates = [F.count(F.lit(1)).alias("slots")]
    for name, column in [("current", "_current"), ("reference", "_reference")]:
        aggregates += [c.alias(f"{name}_{metric}") for metric, c in side(column).items()]
    both = pairs.groupBy(*series).agg(*aggregates)
    return both.withColumns(
        {
            f"delta_{metric}": F.col(f"current_{metric}") - F.col(f"reference_{metric}")
            for metric in ["mean", "peak", "in_range_pct"]
        }
    )


def error_metrics(
    predictions: DataFrame,
    keys: Sequence[str],
    *,
    prediction: str,
    target: str,
    current: str,
    series: str,
    digits: int | None = 2,
) -> DataFrame:
    """MAE and RMSE of a prediction beside the MAE of "nothing changes", with the test sizes.

    ``digits`` rounds half-even (2 as in reports, None keeps full precision).
    """

    def shown(column: Column) -> Column:
        return F.bround(column, digits) if digits is not None else column

    error = F.col(prediction) - F.col(target)
    return predictions.groupBy(*keys).agg(
        shown(F.avg(F.abs(error))).alias("mae_mg_dl"),
        shown(F.sqrt(F.avg(error * error))).alias("rmse_mg_dl"),
        shown(F.avg(F.abs(F.col(target) - F.col(current)))).alias("persistence_mae_mg_dl"),
        F.count(F.lit(1)).alias("test_samples"),
        F.count_distinct(F.col(series)).alias("test_participants"),
    )


def benchmark_summary(results: DataFrame, *, digits: int | None = 2) -> DataFrame:
    """Mean and median of the per-series errors, and how many series beat or tie persistence.

    The improvement is taken from the errors as given: pass rounded errors for a report that agrees
    with its own per-series table, raw ones for exact differences. The median improvement is the
    median of the differences. ``model_name`` and ``split_strategy`` are kept if the results have them.
    """
    # The summarised columns.
    measures = ["mae_mg_dl", "rmse_mg_dl", "persistence_mae_mg_dl", "mae_improvement_vs_persistence"]
    gain = F.col("persistence_mae_mg_dl") - F.col("mae_mg_dl")
    if digits is not None:
        # A difference of two rounded numbers carries binary noise that would hide a tie.
        gain = F.bround(gain, digits)
    # One row per series, read by the means and by each step of the medians.
    labels = [n for n in ("model_name", "split_strategy") if n in results.columns]
    rows = stored(results.withColumn("mae_improvement_vs_persistence", gain).select(*measures, *labels))
    long = rows.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("measure"), F.col(name).cast("double").alias("v")) for name in measures
    ])))
    middle = medians.exact_median(long, ["measure"], "v")

    def shown(column: Column) -> Column:
        return F.bround(column, digits) if digits is not None else column

    medians_row = middle.agg(
        *[
            shown(F.max(F.when(F.col("measure") == name, F.col("median")))).alias(f"median_{name}")
            for name in measures
        ]
    )
    means_row = rows.agg(
        F.count(F.lit(1)).alias("participants"),
        *[F.max(name).alias(name) for name in labels],
        *[shown(F.avg(name)).alias(f"mean_{name}") for name in measures],
        F.count_if(F.col("mae_improvement_vs_persistence") > 0).alias("participants_beating_persistence"),
        F.count_if(F.col("mae_improvement_vs_persistence") == 0).alias("participants_tying_persistence"),
    )
    # Both sides are one-row aggregates.
    return means_row.withColumn("_row", F.lit(1)).join(
        medians_row.withColumn("_row", F.lit(1)), "_row"
    ).drop("_row")
