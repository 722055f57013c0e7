import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from glucospan.operators import metrics, selection
from glucospan.plans import per_series, report, training
from glucospan.plans.features import load_series_dataset
from glucospan.schema import FEATURES, ForecastTable
from glucospan.sources import sinks

SMALL = {"hgb": {"maxIter": 3}, "random_forest": {"numTrees": 5, "maxDepth": 4}}


@pytest.fixture(scope="module")
def table(spark, series_root, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table"))
    sinks.save_forecast_table(load_series_dataset(spark, str(series_root)), path)
    return sinks.load_forecast_table(spark, path)


def test_grouped_and_personalized(spark, table, tmp_path):
    grouped = training.train_grouped(table, model_name="hgb", seed=3, **SMALL["hgb"])
    row = grouped.evaluation.first()
    assert row["split_strategy"] == "participant_holdout"
    assert (row["train_participants"], row["test_participants"]) == (3, 1)
    assert (row["train_samples"], row["test_samples"]) == (80 + 128 + 77, 81)
    assert row["mae_mg_dl"] >= 0

    own = training.train_personalized(table, "1", model_name="rf", seed=3, **SMALL["random_forest"])
    row = own.evaluation.first()
    assert row["split_strategy"] == "within_patient_chronological"
    assert (row["train_samples"], row["test_samples"], row["train_participants"]) == (56, 24, 1)
    assert {r[0] for r in own.predictions.select("participant_id").distinct().collect()} == {"001"}

    sinks.save_run(own, str(tmp_path / "run"), {"license": "test"})
    model, about = training.load_model(spark, str(tmp_path / "run"))
    assert about["features"] == own.features and about["evaluation"] == row.asDict()
    again = training.score(model, table.frame.where("participant_id = '001'"))
    want = {r["timestamp"]: r["prediction_30m"] for r in own.predictions.collect()}
    got = {r["timestamp"]: r["prediction_30m"] for r in again.collect()}
    assert all(got[t] == v for t, v in want.items())
    assert spark.read.json(str(tmp_path / "run" / "metrics")).first()["license"] == "test"


def test_comparison_and_errors(table):
    rows = training.compare_models(table, split="personalized", series="002", overrides=SMALL).collect()
    assert {r["model_name"] for r in rows} == {"hgb", "random_forest"}
    assert rows[0]["mae_mg_dl"] <= rows[1]["mae_mg_dl"]
    with pytest.raises(ValueError, match="needs a series"):
        training.compare_models(table, split="personalized")
    with pytest.raises(ValueError, match="grouped or personalized"):
        training.compare_models(table, split="random")
    with pytest.raises(ValueError, match="model name"):
        training.estimator("linear", target="y")
    few = ForecastTable(table.frame.limit(59), "dexcom")
    with pytest.raises(ValueError, match="enough usable rows"):
        training.train_personalized(few, few.frame.first()["participant_id"])


def test_default_estimators():
    forest = training.estimator(" RF ", target="y")
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (120, 18, 8)
    assert (forest.getFeatureSubsetStrategy(), forest.getSubsamplingRate()) == ("0.75", 0.35)
    boosted = training.estimator("hist_gradient_boosting", target="y")
    assert (boosted.getStepSize(), boosted.getMaxIter()) == (0.055, 300)
    daily = training.day_split_estimator(target="y")
    assert (daily.getStepSize(), daily.getMaxIter()) == (0.07, 220)


def test_imputation_uses_training_rows_only(spark):
    rows = [(1, 1.0, None), (2, 2.0, None), (3, None, None), (4, 10.0, None), (9, 500.0, 1.0), (9, None, None)]
    df = spark.createDataFrame(rows, "day int, a double, b double")
    train = df.where("day < 9")
    out = training.impute(df, train, ["a", "b"]).orderBy("day").collect()
    assert [r["a"] for r in out][:4] == [1.0, 2.0, 2.0, 10.0]
    assert {r["a"] for r in out[4:]} == {500.0, 2.0}
    stages, used = training.imputer_stages(train, ["a", "b"])
    assert used == ["a"]
    days = spark.range(1, 31).withColumnRenamed("id", "day")
    assert selection.day_split(days, "day").where("is_test").agg(F.min("day")).first()[0] == 24
    assert selection.day_split(days.where("day = 1"), "day").where("is_test").count() == 0


def test_day_cutoff_model(table):
    daily = ForecastTable(table.frame.withColumn("day", F.dayofyear("timestamp")), "dexcom")
    row = training.train_by_day(daily, "day", maxIter=2).evaluation.first()
    assert row["split_strategy"] == "day_cutoff"
    assert (row["train_participants"], row["test_participants"]) == (2, 3)


def ridge(rows, features, penalty=1.0):
    """The same model from its textbook form, one series at a time."""
    n = len(rows)
    cut = min(max(int(n * 0.7), 30), n - 20)
    x = np.array([[np.nan if r[f] is None else r[f] for f in features] for r in rows], float)
    used = [j for j in range(len(features)) if not np.isnan(x[:cut, j]).all()]
    x = x[:, used]
    fill = np.nanmedian(x[:cut], axis=0)
    x = np.where(np.isnan(x), fill, x)
    y = np.array([r["target_30m"] - r["glucose_mg_dl"] for r in rows])
    mean, spread = x[:cut].mean(0), x[:cut].std(0)
    keep = spread > 1e-9
    z = (x[:, keep] - mean[keep]) / spread[keep]
    zt, yt = z[:cut], y[:cut] - y[:cut].mean()
    beta = np.linalg.solve(zt.T @ zt + penalty * np.eye(z.shape[1]), zt.T @ yt)
    return cut, [r["glucose_mg_dl"] for r in rows] + y[:cut].mean() + z @ beta


def test_each_series_gets_its_own_ridge(spark):
    rng = np.random.default_rng(8)
    rows = []
    for s, n in [("001", 150), ("002", 61), ("003", 59)]:
        for i in range(n):
            v = 120 + 20 * np.sin(i / 5) + rng.normal()
            rows.append((
                s, datetime(2024, 1, 1) + timedelta(minutes=5 * i), float(v), float(v + 3 * np.cos(i / 5)),
                None if s == "002" else float(rng.normal()), None if rng.random() < 0.2 else float(rng.normal(1e4, 5)), 7.0,
            ))
    schema = "participant_id string, timestamp timestamp_ntz, glucose_mg_dl double, target_30m double, a double, b double, c double"
    frame = spark.createDataFrame(rows, schema)
    features = ["glucose_mg_dl", "a", "b", "c"]
    scored = per_series.predict_each(frame, features=features, width_us=3_600_000_000).collect()
    got = {(r["participant_id"], r["timestamp"]): r["prediction_30m"] for r in scored}
    names = schema.replace(",", "").split()[::2]
    wanted = 0
    for s in ["001", "002"]:
        mine = [dict(zip(names, r, strict=True)) for r in rows if r[0] == s]
        cut, predicted = ridge(mine, features)
        for r, p in list(zip(mine, predicted, strict=True))[cut:]:
            assert got[s, r["timestamp"]] == pytest.approx(p, abs=1e-6)
            wanted += 1
    assert len(got) == wanted


def test_benchmark_of_every_series(spark, table, tmp_path):
    results = per_series.evaluate_each(table.frame, group="diagnosis", features=FEATURES)
    summary = metrics.benchmark_summary(results)
    sinks.save_benchmark(results, summary, str(tmp_path / "b"), {"source": "test"})
    rows = spark.read.option("header", True).csv(str(tmp_path / "b" / "by_series")).collect()
    assert sorted((r["participant_id"], r["train_samples"], r["test_samples"]) for r in rows) == [
        ("001", "56", "24"), ("002", "89", "39"), ("003", "56", "25"), ("004", "53", "24")
    ]
    assert {(r["model_name"], r["train_participants"], r["test_participants"]) for r in rows} == {("ridge", "1", "1")}
    told = json.loads(spark.read.text(str(tmp_path / "b" / "summary")).first()[0])
    assert told["participants"] == 4 and told["source"] == "test" and told["model_name"] == "ridge"


def test_series_report(table):
    out = report.series_report(table.frame, "3", max_points=100)
    head = out.header.first()
    assert (head["participant_id"], head["diagnosis_label"]) == ("003", "Type2 Diabetes")
    assert head["start"] == datetime(2024, 2, 28, 19, 36)
    assert out.metrics.first()["time_in_range_pct"] == 100.0
    assert out.points.count() == 81
    with pytest.raises(ValueError, match="max_points"):
        report.series_report(table.frame, "3", max_points=5)


def test_subset_sink(spark, table, tmp_path):
    rows, best = selection.first_windows(table.frame, "diagnosis", "participant_id", "timestamp", hours=12, at_least=50)
    sinks.save_subset(rows, best, str(tmp_path / "subset"), hours=12, provenance={"source": "test"})
    about = spark.read.json(str(tmp_path / "subset" / "metadata")).collect()
    assert {(r["diagnosis"], r["participant_id"], r["rows"]) for r in about} == {
        ("healthy", "001", 80), ("prediabetes", "002", 128), ("type2_diabetes", "003", 81)
    }
    assert about[0]["selection"] == "one series per group, its first 12 hours"
    with pytest.raises(ValueError, match="at least 12 hours"):
        sinks.save_subset(rows, best, str(tmp_path / "no"), hours=6)
