"""Imputation, tree models, evaluation against persistence, scoring and model storage."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucospan.operators import medians
from glucospan.operators.metrics import error_metrics
from glucospan.operators.selection import (
    chronological_split,
    day_split,
    group_split,
    one_series,
)
from glucospan.plans.forest import ForestRegressor
from glucospan.plans.leafwise import LeafwiseRegressor
from glucospan.schema import SERIES, TIME, VALUE, ForecastTable
from glucospan.sources.sinks import write_text
from glucospan.storage import stored

# Accepted model names.
BOOSTED = ["hgb", "hist_gradient_boosting", "histgradientboosting"]
FOREST = ["rf", "random_forest", "randomforest"]
PREDICTION = "prediction_30m"


def estimator(name: str, *, target: str, seed: int = 42, **overrides) -> LeafwiseRegressor | ForestRegressor:
    """Tree model by name. Keyword arguments override any parameter, for example ``maxIter=60``."""
    wanted = name.lower().strip()
    columns = {"featuresCol": "features", "labelCol": target, "predictionCol": PREDICTION, "seed": seed}
    if wanted in BOOSTED:
        return LeafwiseRegressor(**{**columns, **overrides})
    if wanted in FOREST:
        # Trees, depth, smallest leaf, share of features and of rows per tree.
        settings = {
            "numTrees": 120,
            "maxDepth": 18,
            "minInstancesPerNode": 8,
            "featureSubsetStrategy": "0.75",
            "subsamplingRate": 0.35,
        }
        return ForestRegressor(**{**columns, **settings, **overrides})
    raise ValueError("model name must be one of: hgb, random_forest")


def day_split_estimator(*, target: str, seed: int = 7, **overrides) -> LeafwiseRegressor:
    """Boosted trees as used with the split by day."""
    # Step size, rounds and L2 penalty.
    settings = {"stepSize": 0.07, "maxIter": 220, "l2": 0.4}
    return estimator("hgb", target=target, seed=seed, **{**settings, **overrides})


def long_features(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("v")) for name in features
    ])
    return df.select(*keys, F.inline(cells)).where("v is not null")


def feature_medians(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact median per feature (one row each); a feature without any value is absent."""
    return medians.exact_median(long_features(df, features), ["feature"], "v")


def imputer_stages(train: DataFrame, features: Sequence[str]) -> tuple[list, list[str]]:
    """Pipeline stages that fill gaps with training medians, and the features that have one."""
    fill = {r["feature"]: r["median"] for r in feature_medians(train, features).collect()}
    used = [name for name in features if name in fill]
    if not used:
        raise ValueError("no feature has a value in the training rows")
    filled = ", ".join(
        f"coalesce(cast(`{n}` as double), cast({fill[n]!r} as double)) as `{n}_filled`" for n in used
    )
    stages = [
        SQLTransformer(statement=f"select *, {filled} from __THIS__"),
        VectorAssembler(inputCols=[f"{n}_filled" for n in used], outputCol="features"),
    ]
    return stages, used


def impute(df: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fill missing features with the medians of ``train``; features without a median stay NULL."""
    fill = {r["feature"]: r["median"] for r in feature_medians(train, features).collect()}
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(fill[n])) for n in features if n in fill})


@dataclass(frozen=True)
class TrainedPredictor:
    model: PipelineModel
    features: list[str]
    evaluation: DataFrame
    predictions: DataFrame


@dataclass(frozen=True)
class Prepared:
    """A stored split with what every model fitted on it needs: medians as stages, and sizes."""

    table: ForecastTable
    rows: DataFrame
    strategy: str
    stages: list
    used: list[str]
    train_samples: int
    train_participants: int


def _prepare(table: ForecastTable, split: DataFrame, strategy: str, *, if_empty: str) -> Prepared:
    """The split is stored and read once for the sizes and once for the medians, however many models
    are fitted on it."""
    needed = [SERIES, TIME, VALUE, *table.feature_columns, table.target_column, "is_test"]
    rows = stored(split.select(*dict.fromkeys(needed)))
    train = rows.where("not is_test")
    sizes = train.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(SERIES)).alias("series")
    ).first()
    if sizes["n"] == 0:
        raise ValueError(if_empty)
    stages, used = imputer_stages(train, table.feature_columns)
    return Prepared(table, rows, strategy, stages, used, sizes["n"], sizes["series"])


def _fit(prepared: Prepared, regressor, *, model_name: str) -> TrainedPredictor:
    """Fit on the training rows, score the test rows, and set the errors beside persistence."""
    table, rows = prepared.table, prepared.rows
    model = Pipeline(stages=[*prepared.stages, regressor]).fit(rows.where("not is_test"))
    scored = model.transform(rows.where("is_test")).select(
        SERIES, TIME, VALUE, table.target_column, PREDICTION
    )
    evaluation = error_metrics(
        scored, [], prediction=PREDICTION, target=table.target_column, current=VALUE, series=SERIES
    ).select(
        F.lit(model_name).alias("model_name"),
        F.lit(prepared.strategy).alias("split_strategy"),
        "mae_mg_dl",
        "rmse_mg_dl",
        "persistence_mae_mg_dl",
        F.lit(prepared.train_samples).alias("train_samples"),
        "test_samples",
        F.lit(prepared.train_participants).alias("train_participants"),
        "test_participants",
    )
    return TrainedPredictor(model, prepared.used, evaluation, scored.orderBy(SERIES, TIME))


def prepare_grouped(table: ForecastTable, *, test_fraction: float = 0.2, seed: int = 42) -> Prepared:
    split = group_split(table.frame, SERIES, test_fraction=test_fraction, seed=seed)
    return _prepare(table, split, "participant_holdout", if_empty="the split leaves no training rows")


def prepare_personalized(table: ForecastTable, series: str, *, train_fraction: float = 0.7) -> Prepared:
    rows = one_series(table.frame, SERIES, series)
    split = chronological_split(rows, [SERIES], TIME, train_fraction=train_fraction)
    message = f"series {series} is unknown or does not have enough usable rows"
    return _prepare(table, split, "within_patient_chronological", if_empty=message)


def train_prepared(prepared: Prepared, *, model_name: str = "hgb", seed: int = 42, **overrides) -> TrainedPredictor:
    """Fit one more model on a split that was made before."""
    regressor = estimator(model_name, target=prepared.table.target_column, seed=seed, **overrides)
    return _fit(prepared, regressor, model_name=model_name)


def train_grouped(
    table: ForecastTable,
    *,
    model_name: str = "hgb",
    test_fraction: float = 0.2,
    seed: int = 42,
    **overrides,
) -> TrainedPredictor:
    """Hold out whole series, so the test only has people the model never saw."""
    regressor = estimator(model_name, target=table.target_column, seed=seed, **overrides)
    return _fit(prepare_grouped(table, test_fraction=test_fraction, seed=seed), regressor, model_name=model_name)


def train_personalized(
    table: ForecastTable,
    series: str,
    *,
    model_name: str = "hgb",
    train_fraction: float = 0.7,
    seed: int = 42,
    **overrides,
) -> TrainedPredictor:
    """Train on the earlier part of one series and test on the later part."""
    regressor = estimator(model_name, target=table.target_column, seed=seed, **overrides)
    prepared = prepare_personalized(table, series, train_fraction=train_fraction)
    return _fit(prepared, regressor, model_name=model_name)


def train_by_day(
    table: ForecastTable, day: str, *, train_fraction: float = 0.78, seed: int = 7, **overrides
) -> TrainedPredictor:
    """Train on the earlier days of all rows and test on the later days."""
    split = day_split(table.frame.dropna(), day, train_fraction=train_fraction)
    regressor = day_split_estimator(target=table.target_column, seed=seed, **overrides)
    prepared = _prepare(table, split, "day_cutoff", if_empty="the split leaves no training rows")
    return _fit(prepared, regressor, model_name="hgb")


def compare_models(
    table: ForecastTable,
    *,
    split: str = "grouped",
    series: str | None = None,
    seed: int = 42,
    overrides: dict[str, dict] | None = None,
) -> DataFrame:
    """Evaluation rows of both models on the same split, best first. The split is made once.

    The models are fitted side by side, since boosting is one task after the other and a forest is many at a time.
    """
    if split == "grouped":
        prepared = prepare_grouped(table, seed=seed)
    elif split != "personalized":
        raise ValueError(f"unknown split {split!r}: choose grouped or personalized")
    elif series is None:
        raise ValueError("a personalized comparison needs a series")
    else:
        prepared = prepare_personalized(table, series)
    def fitted(name: str) -> DataFrame:
        regressor = estimator(name, target=table.target_column, seed=seed, **(overrides or {}).get(name, {}))
        return _fit(prepared, regressor, model_name=name).evaluation

    with ThreadPoolExecutor() as both:
        boosted, forest = both.map(fitted, ["hgb", "random_forest"])
    return rank_models(boosted.unionByName(forest))


def rank_models(evaluations: DataFrame) -> DataFrame:
    return evaluations.orderBy("mae_mg_dl")


def save_model(trained: TrainedPredictor, path: str) -> str:
    """The fitted pipeline with its features and evaluation beside it."""
    trained.model.write().overwrite().save(f"{path}/model")
    spark = trained.predictions.sparkSession
    about = {"features": trained.features, "evaluation": trained.evaluation.first().asDict()}
    write_text(spark, json.dumps(about), f"{path}/about")
    return path


def load_model(spark, path: str) -> tuple[PipelineModel, dict]:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return PipelineModel.load(f"{path}/model"), about


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Predict any number of rows at once; inputs keep their columns."""
    return model.transform(rows).select(*rows.columns, PREDICTION)
