from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler

from glucospan.operators import boosting, forest
from glucospan.plans import training
from glucospan.plans.forest import ForestRegressor, subset

NAMES = ["a", "b", "c"]


def sample(spark, n=6000, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = 40 * (x[:, 0] > 0) + 10 * x[:, 1] + rng.normal(size=n)
    return x, y, spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double").coalesce(2)


def assembled(df):
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df)


def trees(model):
    return {r["tree"]: {n: np.frombuffer(r[n], k) for n, k in forest.KINDS.items()} for r in model.trees.collect()}


def regressor(**options):
    usual = {"numTrees": 6, "maxDepth": 7, "minInstancesPerNode": 8, "featureSubsetStrategy": "0.75", "subsamplingRate": 0.35}
    return ForestRegressor(labelCol="y", predictionCol="p", seed=3, **{**usual, **options})


def brute(x, w, units, tree, node, depth, settings):
    """(feature, bin, rows, sum) of each node below ``node``, by recursion over lists of rows."""
    total, count = int((w * units).sum()), int(w.sum())
    best, looks = (0.0, -1, 0), forest.looked_at(tree, np.array([node]), x.shape[1], settings)[0]
    for f in np.flatnonzero(looks) if depth < settings.depth else []:
        for cut in range(int(x.max())):
            low = x[:, f] <= cut
            n, g = int(w[low].sum()), int((w * units)[low].sum())
            if min(n, count - n) >= settings.least:
                gain = (float(g * count) - float(total * n)) ** 2 / (n * (count - n) * count)
                if gain > best[0]:
                    best = (gain, int(f), cut)
    out = [(node, best[1], best[2] if best[1] >= 0 else 0, total / count)]
    if best[1] >= 0:
        low = x[:, best[1]] <= best[2]
        for child, part in ((2 * node, low), (2 * node + 1, ~low)):
            out += brute(x[part], w[part], units[part], tree, child, depth + 1, settings)
    return out


def test_a_tree_is_that_of_plain_recursion():
    rng = np.random.default_rng(1)
    settings = forest.Settings(depth=4, least=5, features=2, seed=9)
    x, units, w = rng.integers(0, 9, (300, 3)).astype(np.uint8), rng.integers(-900, 900, 300), rng.integers(1, 4, 300)
    made = forest.grown(x, w, units, 7, 1, settings)
    ids = np.ones(len(made["left"]), int)
    for i, low in enumerate(made["left"]):
        if low:
            ids[low], ids[low + 1] = 2 * ids[i], 2 * ids[i] + 1
    got = sorted(zip(ids.tolist(), made["feature"].tolist(), made["cut"].tolist(), made["value"].tolist()))
    want = sorted(brute(x, w, units, 7, 1, 0, settings))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert int(max(ids)).bit_length() - 1 <= 4


def test_spread_trees_are_those_of_one_task(spark):
    _, _, df = sample(spark)
    whole = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"), regressor()]).fit(df).stages[1]
    spread = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"), regressor(ownTask=300)]).fit(df).stages[1]
    rows = assembled(df)
    assert len(trees(whole)) == len(trees(spread)) == 6
    assert all(len(t["left"]) == len(trees(spread)[k]["left"]) for k, t in trees(whole).items())
    key = ["a", "b", "c", "y"]
    one, other = (Counter(tuple(r) for r in m.transform(rows).select(*key, "p").collect()) for m in (whole, spread))
    assert one == other


def test_work_does_not_grow_with_the_nodes(spark):
    """Spark's own forest passes all rows by once for every few nodes: jobs must not follow the depth."""
    _, _, df = sample(spark)
    rows, tracker = assembled(df).cache(), spark.sparkContext.statusTracker()

    def jobs(name, depth):
        spark.sparkContext.setJobGroup(name, name)
        regressor(maxDepth=depth).fit(rows)
        return len(tracker.getJobIdsForGroup(name))

    try:
        assert jobs("deep", 12) == jobs("shallow", 2)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_saved_model_and_errors(spark, tmp_path):
    x, y, df = sample(spark, 3000)
    model = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features"), regressor(numTrees=20)]).fit(df)
    scored = model.transform(df).select("a", "b", "c", "y", "p").collect()
    assert np.mean([abs(r["p"] - r["y"]) for r in scored]) < 4 < np.mean(np.abs(y - y.mean()))
    assert all(y.min() <= r["p"] <= y.max() for r in scored)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(df).select("a", "b", "c", "y", "p").collect()
    assert Counter(map(tuple, scored)) == Counter(map(tuple, again))
    with pytest.raises(Exception, match="no target"):
        regressor().fit(assembled(df.selectExpr("a", "b", "c", "nullif(a, 0.5) * null as y")))
    with pytest.raises(ValueError, match="no rows"):
        regressor().fit(assembled(df.limit(0)))


def test_few_and_equal_rows(spark):
    df = assembled(spark.createDataFrame([(1.0, 2.0, 3.0, 0.1)], "a double, b double, c double, y double"))
    assert [r["p"] for r in regressor().fit(df).transform(df).collect()] == [0.1]
    many = assembled(spark.createDataFrame([(float(i), 0.0, 0.0, 0.1) for i in range(900)], "a double, b double, c double, y double"))
    for own in (10, 1000):  # nothing to split by, more rows than a task may hold or fewer
        model = regressor(ownTask=own).fit(many)
        assert {r["p"] for r in model.transform(many).collect()} == {0.1}
        assert all(len(t["left"]) == 1 for t in trees(model).values())


def test_large_forests_are_scored_some_trees_at_a_time(spark, monkeypatch):
    _, _, df = sample(spark, 2000)
    rows = assembled(df)
    model = regressor().fit(rows)
    want = Counter((r["a"], r["b"], r["c"], round(r["p"], 9)) for r in model.transform(rows).collect())
    monkeypatch.setattr("glucospan.plans.forest.NODES", 100)
    assert Counter((r["a"], r["b"], r["c"], round(r["p"], 9)) for r in model.transform(rows).collect()) == want


def test_feature_subsets():
    assert [subset(s, 7, 120) for s in ["0.75", "all", "auto", "onethird", "sqrt", "log2", "3", "9", "1.0"]] == [6, 7, 3, 3, 3, 3, 3, 7, 7]
    assert subset("auto", 7, 1) == 7


def test_boosted_rows_end_where_their_tree_says():
    """Residuals follow the nodes in which rows ended while the tree grew; no row goes through it again."""
    rng = np.random.default_rng(2)
    n = 4000
    model = np.sort(rng.integers(0, 3, n))
    bins = rng.integers(0, 16, (n, 3)).astype(np.uint8)
    y = bins[:, 0] * 2.0 + (bins[:, 1] > 7) * 9 + rng.normal(size=n)
    settings = boosting.Settings(rounds=6, leaves=7, least=5)
    exponents = np.full(3, boosting.unit_exponent(float(np.abs(y).max())))
    for m, (base, grown) in enumerate(boosting.fit_batch(bins, y, model, exponents, settings)):
        mine = model == m
        for rounds in range(1, 7):
            x, left = bins[mine], y[mine] - boosting.predict(bins[mine], base, grown[: rounds - 1])
            tree = grown[rounds - 1]
            leaf = tree.apply(x)
            for value in np.unique(leaf):
                rows = leaf == value
                assert value == pytest.approx(settings.step * left[rows].sum() / (rows.sum() + settings.l2), abs=1e-6)


def test_both_models_are_compared_on_one_split(spark):
    rows = [
        (f"{s:03d}", datetime(2024, 1, 1) + timedelta(minutes=5 * i), 100.0 + 7 * s + i % 9, float(i % 9), 100.0 + 7 * s + (i + 6) % 9)
        for s in range(10) for i in range(40)
    ]
    frame = spark.createDataFrame(rows, "participant_id string, timestamp timestamp_ntz, glucose_mg_dl double, k double, target_30m double")
    table = training.ForecastTable(frame, "dexcom", feature_columns=["glucose_mg_dl", "k"])
    few = {"hgb": {"maxIter": 5}, "random_forest": {"numTrees": 8, "minInstancesPerNode": 2}}
    out = training.compare_models(table, overrides=few).collect()
    assert {r["model_name"] for r in out} == {"hgb", "random_forest"}
    assert {(r["train_samples"], r["test_samples"]) for r in out} == {(320, 80)}
    assert all(r["rmse_mg_dl"] >= r["mae_mg_dl"] for r in out)


def test_only_the_smaller_child_is_counted(monkeypatch):
    """The other one's histogram is the rest of its parent's. Without room to keep the parents', all rows are counted."""
    rng = np.random.default_rng(5)
    n, bincount, counted = 20_000, np.bincount, []
    x, w, units = rng.integers(0, 32, (n, 3)).astype(np.uint8), rng.integers(1, 4, n).astype(np.uint8), rng.integers(-9000, 9000, n)

    def spied(cells, *args, **options):
        counted.append(len(cells))
        return bincount(cells, *args, **options)

    monkeypatch.setattr(np, "bincount", spied)
    made, work = [], []
    for cells in (4_000_000, 0):
        counted.clear()
        made.append(forest.grown(x, w, units, 7, 1, forest.Settings(depth=6, least=5, features=2, cells=cells)))
        work.append(sum(counted))
    assert all(np.array_equal(made[0][k], made[1][k]) for k in forest.KINDS) and len(made[0]["left"]) > 50
    assert work[0] < 0.75 * work[1]
