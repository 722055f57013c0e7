"""Row-level expressions: bands, time of day, clamps, interval bounds, response kernels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glucose range limits in mg/dL.
VERY_LOW, LOW, HIGH, VERY_HIGH = 54.0, 70.0, 180.0, 250.0
# HbA1c limits in percent and the group names.
HBA1C_HEALTHY_BELOW, HBA1C_PREDIABETES_UP_TO = 5.7, 6.4
DIAGNOSES = ["healthy", "prediabetes", "type2_diabetes"]
# Sensor limits used when clamping, and the limits of a prediction band.
SENSOR_MIN, SENSOR_MAX = 45.0, 400.0
BAND_MIN, BAND_MAX, BAND_MIN_SPREAD, BAND_Z = 40.0, 400.0, 5.0, 1.64


def diagnosis_band(
    value: Column,
    healthy_below: float = HBA1C_HEALTHY_BELOW,
    prediabetes_up_to: float = HBA1C_PREDIABETES_UP_TO,
) -> Column:
    return (
        F.when(value.isNull() | F.isnan(value), "unknown")
        .when(value < healthy_below, DIAGNOSES[0])
        .when(value <= prediabetes_up_to, DIAGNOSES[1])
        .otherwise(DIAGNOSES[2])
    )


def hour_of_day(time: Column) -> Column:
    """Fractional hour; seconds are left out on purpose."""
    return F.hour(time) + F.minute(time) / F.lit(60.0)


def cyclical(hour: Column) -> tuple[Column, Column]:
    angle = hour * F.lit(2.0 * math.pi) / F.lit(24.0)
    return F.sin(angle), F.cos(angle)


def clamp(value: Column, low: float = SENSOR_MIN, high: float = SENSOR_MAX) -> Column:
    """Bound a value; NULL stays NULL (``greatest`` alone would turn it into the bound)."""
    return F.when(
        value.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))
    )


def prediction_band(prediction: Column, rmse: Column, z: float = BAND_Z) -> tuple[Column, Column]:
    spread = F.greatest(F.lit(BAND_MIN_SPREAD), rmse * z)
    lower = F.greatest(F.lit(BAND_MIN), prediction - spread)
    upper = F.least(F.lit(BAND_MAX), prediction + spread)
    usable = prediction.isNotNull() & rmse.isNotNull()
    return F.when(usable, lower), F.when(usable, upper)
