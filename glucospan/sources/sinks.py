"""Writing and re-reading results. Every sink is a Spark write, one directory per result."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucospan.functions.text import nan_to_null
from glucospan.schema import SERIES, TIME, ForecastTable
from glucospan.storage import stored


# Times in text keep their microseconds; by default they would lose three digits.
TEXT_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def save_forecast_table(table: ForecastTable, path: str, *, fmt: str = "parquet") -> str:
    """Write rows below ``path``/rows and the descriptor below ``path``/descriptor.

    Parquet is the default, so later reads prune columns and push filters down; rows are sorted by
    (id, time), so a filter on an id skips files and row groups. ``fmt="csv"`` writes gzip CSV. The rows are stored
    first: the sort reads them twice, once for its ranges.
    """
    writer = stored(table.frame).orderBy(SERIES, TIME).write.mode("overwrite")
    if fmt == "csv":
        writer.options(header=True, compression="gzip", **TEXT_TIMES).csv(f"{path}/rows")
    elif fmt == "parquet":
        writer.parquet(f"{path}/rows")
    else:
        raise ValueError("fmt must be parquet or csv")
    spark = table.frame.sparkSession
    descriptor = {
        "format": fmt,
        "glucose_source": table.glucose_source,
        "horizon_minutes": table.horizon_minutes,
        "feature_columns": table.feature_columns,
        "target_column": table.target_column,
        "schema": table.frame.schema.jsonValue(),
    }
    write_text(spark, json.dumps(descriptor), f"{path}/descriptor")
    return path


def load_forecast_table(spark: SparkSession, path: str) -> ForecastTable:
    """Read a saved table; columns, source and horizon come from its own descriptor."""
    told = json.loads(spark.read.text(f"{path}/descriptor").first()[0])
    schema = T.StructType.fromJson(told["schema"])
    reader = spark.read.schema(schema)
    if told["format"] == "csv":
        rows = reader.options(header=True, **TEXT_TIMES).csv(f"{path}/rows")
        for field in schema:
            if field.dataType.typeName() == "double":
                rows = rows.withColumn(field.name, nan_to_null(F.col(field.name)))
    else:
        rows = reader.parquet(f"{path}/rows")
    return ForecastTable(
        frame=rows,
        glucose_source=told["glucose_source"],
        horizon_minutes=told["horizon_minutes"],
        feature_columns=told["feature_columns"],
        target_column=told["target_column"],
    )


def run_summary(table: ForecastTable, provenance: dict[str, str] | None = None) -> DataFrame:
    """One row about a table: sizes, source, horizon, features and where the data came from.

    The ids themselves are not put into the row, which would grow with them: ``save_summary`` writes them beside it.
    """
    return table.frame.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(SERIES)).alias("participants")
    ).withColumns(
        {
            "glucose_source": F.lit(table.glucose_source),
            "horizon_minutes": F.lit(table.horizon_minutes),
            "features": F.array(*[F.lit(name) for name in table.feature_columns]),
            **{name: F.lit(text) for name, text in (provenance or {}).items()},
        }
    )


def save_summary(table: ForecastTable, path: str, provenance: dict[str, str] | None = None) -> str:
    """The summary as JSON in ``path``/summary and the ids, in order, as JSON lines in ``path``/participants."""
    write_json(run_summary(table, provenance), f"{path}/summary")
    write_json(table.participants().orderBy(SERIES), f"{path}/participants")
    return path


def subset_metadata(chosen: DataFrame, provenance: dict[str, str], hours: float) -> DataFrame:
    """The chosen windows with the rule that chose them, one row per group."""
    rule = f"one series per group, its first {hours:g} hours"
    return chosen.withColumns(
        {"selection": F.lit(rule), **{name: F.lit(text) for name, text in provenance.items()}}
    )


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(**TEXT_TIMES).json(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(header=True, **TEXT_TIMES).csv(path)
    return path


def write_text(spark: SparkSession, text: str, path: str) -> str:
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(path)
    return path


def with_provenance(df: DataFrame, provenance: dict[str, str] | None) -> DataFrame:
    return df.withColumns({name: F.lit(text) for name, text in (provenance or {}).items()})


def save_run(trained, path: str, provenance: dict[str, str] | None = None) -> str:
    """One training run: model, evaluation as JSON, predictions as CSV."""
    from glucospan.plans.training import save_model

    save_model(trained, path)
    write_json(with_provenance(trained.evaluation, provenance), f"{path}/metrics")
    write_csv(trained.predictions, f"{path}/predictions")
    return path


def save_benchmark(
    results: DataFrame, summary: DataFrame, path: str, provenance: dict[str, str] | None = None
) -> str:
    """Per-series results as CSV in id order and their summary as JSON."""
    write_csv(results.orderBy(SERIES), f"{path}/by_series")
    write_json(with_provenance(summary, provenance), f"{path}/summary")
    return path


def save_subset(
    rows: DataFrame, chosen: DataFrame, path: str, *, hours: float, provenance: dict[str, str] | None = None
) -> str:
    """A chosen subset as CSV in (id, time) order with its metadata as JSON."""
    if hours < 12:
        raise ValueError("a subset window must be at least 12 hours")
    write_csv(rows.orderBy(SERIES, TIME), f"{path}/rows")
    write_json(subset_metadata(chosen, provenance or {}, hours), f"{path}/metadata")
    return path
