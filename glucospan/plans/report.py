"""One series as a report: header, range metrics and a thinned line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from glucospan.operators.metrics import range_metrics, series_header
from glucospan.operators.selection import every_kth, one_series
from glucospan.schema import SERIES, TIME, VALUE


@dataclass(frozen=True)
class SeriesReport:
    header: DataFrame
    metrics: DataFrame
    points: DataFrame


def series_report(df: DataFrame, series: str, max_points: int = 600) -> SeriesReport:
    """Metrics come from all rows of the series, the points are every k-th of them."""
    if not 100 <= max_points <= 1200:
        raise ValueError("max_points must be between 100 and 1200")
    rows = one_series(df, SERIES, series)
    return SeriesReport(
        header=series_header(rows, SERIES, TIME, "diagnosis", "hba1c"),
        metrics=range_metrics(rows, [SERIES], VALUE, digits=1),
        points=every_kth(rows, [SERIES], TIME, max_points=max_points).select(TIME, VALUE).orderBy(TIME),
    )
