"""A model of its own for every series, all series in one plan.

``hgb`` are boosted trees (``operators.boosting``): many series together in a task, long ones spread over all.
``ridge`` is a standardised ridge regression, a cheap linear stand-in. Its training data reduce to sums of products,
which combine map-side, so a series of any length never has to fit into one task. Only the solved
system (one row per series) goes through Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucospan.operators import boosting, medians
from glucospan.operators.metrics import error_metrics
from glucospan.operators.selection import chronological_split
from glucospan.operators.slices import measured_width, sliced, with_series_facts
from glucospan.plans.training import BOOSTED, PREDICTION, long_features
from glucospan.schema import FEATURES, SERIES, TARGET, TIME, VALUE
from glucospan.storage import stored


def _centred(features: Sequence[str]) -> list:
    """Feature minus the training median of its series: a missing value becomes 0, and so does a
    feature that has no value in training."""
    return [
        F.coalesce(F.col(name).cast("double") - F.col("centres")[name], F.lit(0.0)) for name in features
    ]


def fit_coefficients(
    rows: DataFrame, series: str, features: Sequence[str], target: str, current: str, penalty: float
) -> DataFrame:
    """One row per series: intercept first, then one coefficient per centred feature.

    ``rows`` are training rows with ``centres``. The target enters as its change from ``current``.
    """
    names = [f"_z{i}" for i in range(len(features))]
    change = (F.col(target) - F.col(current)).alias("_y")
    z = rows.select(series, change, *[c.alias(n) for c, n in zip(_centred(features), names, strict=True)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = z.groupBy(series).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_y").alias("sy"),
        F.array(*[F.sum(n) for n in names]).alias("sx"),
        F.array(*[F.sum(F.col(n) * F.col("_y")) for n in names]).alias("sxy"),
        F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("sxx"),
    )

    def solve(batches):
        import numpy as np
        import pandas as pd

        size = len(names)
        upper = np.triu_indices(size)
        for batch in batches:
            weights = []
            for n, sy, sx, sxy, sxx in zip(
                batch["n"], batch["sy"], batch["sx"], batch["sxy"], batch["sxx"], strict=True
            ):
                mean = np.asarray(sx) / n
                gram = np.zeros((size, size))
                gram[upper] = sxx
                gram = gram + np.triu(gram, 1).T
                cov = gram / n - np.outer(mean, mean)
                cross = np.asarray(sxy) / n - mean * (sy / n)
                spread = np.sqrt(np.clip(np.diag(cov), 0.0, None))
                # A constant column carries no information; rounding leaves it a tiny spread.
                varied = spread > 1e-9 * (1.0 + np.abs(mean))
                beta = np.zeros(size)
                if varied.any():
                    s = spread[varied]
                    system = cov[np.ix_(varied, varied)] / np.outer(s, s)
                    system = system + np.eye(len(s)) * (penalty / n)
                    beta[varied] = np.linalg.solve(system, cross[varied] / s) / s
                weights.append([sy / n - float(mean @ beta), *beta.tolist()])
            yield pd.DataFrame({series: batch[series], "weights": weights})

    kind = rows.schema[series].dataType.simpleString()
    return sums.mapInPandas(solve, f"{series} {kind}, weights array<double>")


def predict_each(
    table: DataFrame,
    *,
    series: str = SERIES,
    time: str = TIME,
    features: Sequence[str] = tuple(FEATURES),
    target: str = TARGET,
    current: str = VALUE,
    train_fraction: float = 0.7,
    model: str = "ridge",
    penalty: float = 1.0,
    settings: boosting.Settings = boosting.Settings(),
    tiebreak: Sequence[str] = (),
    width_us: int | None = None,
) -> DataFrame:
    """Test rows (the later part of each series) with the prediction of the series' own model.

    ``model``: ``ridge`` (with ``penalty``) or ``hgb`` (with ``settings``). Missing features take the training
    median of their series.
    """
    if model not in ("ridge", *BOOSTED):
        raise ValueError("model must be ridge or hgb")
    width_us = width_us or measured_width(table, [series], time)
    needed = dict.fromkeys([series, time, current, target, *features, *tiebreak])
    # Read by the medians, the sums of products and the scoring.
    split = stored(
        chronological_split(
            table.select(*needed),
            [series],
            time,
            train_fraction=train_fraction,
            tiebreak=tiebreak,
            width_us=width_us,
        )
    )
    middle = medians.exact_median(
        long_features(split.where("not is_test"), features, [series]), [series, "feature"], "v"
    )
    # At most one entry per feature, so the map stays small whatever the series. Training and
    # scoring both read it.
    centres = stored(
        middle.groupBy(series).agg(
            F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("centres")
        )
    )
    rows = with_series_facts(sliced(split, time, width_us), centres, [series])
    if model != "ridge":
        filled = {n: F.coalesce(F.col(n).cast("double"), F.col("centres")[n], F.lit(0.0)) for n in features}
        names = [f"_f{i}" for i in range(len(features))]
        filled = [
            F.coalesce(F.col(n).cast("double"), F.col("centres")[n], F.lit(0.0)).alias(new)
            for n, new in zip(features, names, strict=True)
        ]
        rows = stored(rows.select(series, time, current, F.col(target).cast("double"), "is_test", *filled))
        scored = boosting.predictions(rows, F.col(series), names, target, "is_test", PREDICTION, settings)
        return scored.select(series, time, current, target, PREDICTION)
    weights = fit_coefficients(rows.where("not is_test"), series, features, target, current, penalty)
    test = with_series_facts(rows.where("is_test"), weights, [series])
    change = F.col("weights")[0]
    for i, part in enumerate(_centred(features)):
        change = change + part * F.col("weights")[i + 1]
    return test.withColumn(PREDICTION, F.col(current) + change).select(
        series, time, current, target, PREDICTION
    )


def evaluate_each(
    table: DataFrame,
    *,
    group: str | None = None,
    digits: int | None = 2,
    train_fraction: float = 0.7,
    **options,
) -> DataFrame:
    """Per-series errors and sizes with the group of its first row and the gain over persistence.

    ``model_name`` says which model (``model``, see ``predict_each``) the errors belong to.
    """
    series, time = options.get("series", SERIES), options.get("time", TIME)
    scored = predict_each(table, train_fraction=train_fraction, **options)
    errors = error_metrics(
        scored,
        [series],
        prediction=PREDICTION,
        target=options.get("target", TARGET),
        current=options.get("current", VALUE),
        series=series,
        digits=digits,
    )
    gain = F.col("persistence_mae_mg_dl") - F.col("mae_mg_dl")
    first = [F.min_by(group, time).alias(group)] if group is not None else []
    sizes = table.groupBy(series).agg(F.count(time).alias("_rows"), *first)
    return (
        errors.join(sizes, series)
        .withColumns(
            {
                "model_name": F.lit(options.get("model", "ridge")),
                "split_strategy": F.lit("within_patient_chronological"),
                "train_participants": F.lit(1).cast("bigint"),
                "train_samples": F.col("_rows") - F.col("test_samples"),
                "mae_improvement_vs_persistence": F.bround(gain, digits) if digits is not None else gain,
            }
        )
        .drop("_rows")
    )
