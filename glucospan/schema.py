"""Column names, the forecasting-table schema and its descriptor."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SERIES = "participant_id"
TIME = "timestamp"
VALUE = "glucose_mg_dl"
TARGET = "target_30m"
TARGET_TIME = "target_timestamp"

# The model inputs, in the order the models expect them.
FEATURES = [
    "glucose_mg_dl",
    "glucose_lag_15m",
    "glucose_lag_30m",
    "glucose_delta_15m",
    "sin_time",
    "cos_time",
    "carbs_last_120m",
    "protein_last_120m",
    "fat_last_120m",
    "fiber_last_120m",
    "heart_rate_mean_30m",
    "mets_mean_60m",
    "activity_calories_60m",
    "age",
    "bmi",
    "hba1c",
    "fasting_glucose",
    "fasting_insulin",
]

# The forecasting table, column by column.
FORECAST_SCHEMA = T.StructType(
    [
        T.StructField("participant_id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("glucose_mg_dl", T.DoubleType()),
        T.StructField("hour", T.DoubleType()),
        T.StructField("sin_time", T.DoubleType()),
        T.StructField("cos_time", T.DoubleType()),
        T.StructField("carbs_last_120m", T.DoubleType()),
        T.StructField("protein_last_120m", T.DoubleType()),
        T.StructField("fat_last_120m", T.DoubleType()),
        T.StructField("fiber_last_120m", T.DoubleType()),
        T.StructField("heart_rate", T.DoubleType()),
        T.StructField("mets", T.DoubleType()),
        T.StructField("activity_calories", T.DoubleType()),
        T.StructField("heart_rate_mean_30m", T.DoubleType()),
        T.StructField("mets_mean_60m", T.DoubleType()),
        T.StructField("activity_calories_60m", T.DoubleType()),
        T.StructField("age", T.DoubleType()),
        T.StructField("bmi", T.DoubleType()),
        T.StructField("hba1c", T.DoubleType()),
        T.StructField("fasting_glucose", T.DoubleType()),
        T.StructField("fasting_insulin", T.DoubleType()),
        T.StructField("diagnosis", T.StringType()),
        T.StructField("glucose_lag_15m", T.DoubleType()),
        T.StructField("glucose_lag_30m", T.DoubleType()),
        T.StructField("glucose_delta_15m", T.DoubleType()),
        T.StructField("target_30m", T.DoubleType()),
        T.StructField("target_timestamp", T.TimestampNTZType()),
    ]
)


@dataclass(frozen=True)
class ForecastTable:
    """A forecasting table together with what a model needs to know about it."""

    frame: DataFrame
    glucose_source: str
    horizon_minutes: int = 30
    feature_columns: list[str] = field(default_factory=lambda: list(FEATURES))
    target_column: str = TARGET

    def participants(self) -> DataFrame:
        """Distinct series ids in order (one row per series, never collected here)."""
        from glucospan.operators.metrics import distinct_series

        return distinct_series(self.frame, SERIES)
