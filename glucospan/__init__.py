"""Spark-native feature building and evaluation for wearable-sensor time series."""

from glucospan.schema import FEATURES, FORECAST_SCHEMA, ForecastTable

__all__ = ["FEATURES", "FORECAST_SCHEMA", "ForecastTable"]
