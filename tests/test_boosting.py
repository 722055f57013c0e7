"""Leaf-wise boosted trees against their definition; one task against many; odd keys and rows."""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from threading import Barrier

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from glucospan.operators import boosting
from glucospan.plans.leafwise import LeafwiseRegressor

SMALL = boosting.Settings(rounds=3, step=0.3, leaves=6, least=4, bins=16)


def by_definition(bins, y, exponent, s):
    """Predictions of the training rows: the leaf of greatest gain is split, one after the other."""
    unit = 2.0**exponent
    now = np.full(len(y), np.rint(y * unit).sum() / len(y) / unit)

    def best(g, rows):
        found, total = None, g[rows].sum()
        for f in range(bins.shape[1]):
            for cut in range(int(bins.max())):
                left = bins[rows, f] <= cut
                n, m = left.sum(), (~left).sum()
                if min(n, m) < s.least:
                    continue
                a = g[rows][left].sum()
                gain = a * a / (n + s.l2) + (total - a) * (total - a) / (m + s.l2) - total * total / (n + m + s.l2)
                if gain > 0 and (found is None or gain > found[0]):
                    found = gain, f, cut
        return found

    for _ in range(s.rounds):
        g, leaves = np.rint((y - now) * unit), [np.arange(len(y))]
        splits = [best(g, leaves[0])]
        while len(leaves) < s.leaves and any(splits):
            i = max((x[0], -k) for k, x in enumerate(splits) if x)[1] * -1
            _, f, cut = splits[i]
            rows, left = leaves[i], bins[leaves[i], f] <= cut
            leaves[i], splits[i] = rows[left], best(g, rows[left])
            leaves.append(rows[~left])
            splits.append(best(g, rows[~left]))
        for rows in leaves:
            now[rows] += s.step * (g[rows].sum() / (len(rows) + s.l2)) / unit
    return now


def data(count, seed=0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(count, 3)).round(2)
    return x, 90 + 20 * x[:, 0] * x[:, 1] + 9 * (x[:, 2] > 0) + draw.normal(size=count).round(3)


@pytest.mark.parametrize("cells", [4_000_000, 40])
def test_trees_are_those_of_the_definition(cells):
    models, bins, y = np.repeat([0, 1, 2], [120, 3, 90]), [], []
    for m, count in enumerate((120, 3, 90)):
        x, target = data(count, m)
        bins.append(boosting.binned(x, [np.unique(np.quantile(c, np.arange(1, 9) / 9, method="inverted_cdf")) for c in x.T]))
        y.append(target)
    exponents = np.array([boosting.unit_exponent(np.abs(t).max()) for t in y])
    made = boosting.fit_batch(np.concatenate(bins), np.concatenate(y), models, exponents, replace(SMALL, cells=cells))
    for m in range(3):
        want = by_definition(bins[m], y[m], exponents[m], SMALL)
        assert np.array_equal(boosting.predict(bins[m], *made[m]), want)
        assert all(sum(left == 0 for left in t.left) <= SMALL.leaves for t in made[m][1])


def rows(spark):
    out = []
    for key, count in (("a", 90), ("b", 260), (None, 70), ("tiny", 5), ("untaught", 0)):
        x, y = data(count, len(out)) if count else (np.zeros((0, 3)), np.zeros(0))
        out += [(key, i, *map(float, v), float(t), i % 5 == 0) for i, (v, t) in enumerate(zip(x, y))]
    out += [("untaught", 1, 1.0, 2.0, 3.0, 4.0, True), ("a", 900, None, float("nan"), 1.0, None, False), ("a", 901, None, 0.5, 1.0, None, True)]
    return spark.createDataFrame(out, "key string, n int, x0 double, x1 double, x2 double, y double, held boolean")


NAMES = ["x0", "x1", "x2"]


def test_one_task_and_many_give_the_same(spark, tmp_path):
    rows(spark).repartition(5).write.parquet(str(tmp_path / "rows"))
    split = spark.read.parquet(str(tmp_path / "rows"))
    found = []
    for own in (1_000_000, 60, 1):
        s = replace(SMALL, own_task=own, rounds=10 if own == 60 else 3)
        plain = replace(s, own_task=1_000_000)
        got = boosting.predictions(split, F.col("key"), NAMES, "y", "held", "p", s).select("key", "n", "p")
        one = boosting.predictions(split, F.col("key"), NAMES, "y", "held", "p", plain).select("key", "n", "p")
        found.append({(r.key, r.n): r.p for r in got.collect()})
        assert found[-1] == {(r.key, r.n): r.p for r in one.collect()}
    assert len(found[0]) == split.where("held").count() and found[0] == found[2]
    assert found[0]["untaught", 1] is None and found[0]["a", 901] is not None
    kept = boosting.models(split, F.col("key"), NAMES, "y", "held", replace(SMALL, own_task=60)).collect()
    assert {r["_key"] for r in kept} == {"a", "b", None, "tiny"}
    base, trees, cuts = boosting.from_json(next(r.model for r in kept if r["_key"] == "b"))
    first = split.where("key = 'b' and n = 0").first()
    at = boosting.binned(np.array([[first.x0, first.x1, first.x2]]), cuts)
    assert boosting.predict(at, base, trees)[0] == found[0]["b", 0]


def test_stage_of_a_pipeline(spark, tmp_path):
    train = rows(spark).where("y is not null")
    stages = [VectorAssembler(inputCols=NAMES, outputCol="features"), LeafwiseRegressor(labelCol="y", maxIter=20, maxLeaves=4, predictionCol="p")]
    model = Pipeline(stages=stages).fit(train)
    want = {(r.key, r.n): r.p for r in model.transform(train).collect()}
    model.write().save(str(tmp_path / "model"))
    assert {(r.key, r.n): r.p for r in PipelineModel.load(str(tmp_path / "model")).transform(train).collect()} == want
    error, spread = (np.array([abs(r.y - g) for r in train.collect() for g in [f(r)]]).mean() for f in (lambda r: want[r.key, r.n], lambda r: 90.0))
    assert error < spread
    few = LeafwiseRegressor(labelCol="y", maxIter=20, maxLeaves=4, predictionCol="p", ownTask=50)
    many = Pipeline(stages=[stages[0], few]).fit(train)
    assert {(r.key, r.n): r.p for r in many.transform(train).collect()} == want
    with pytest.raises(ValueError, match="no rows"):
        Pipeline(stages=stages).fit(train.limit(0))


def test_penalty_and_caps_matter():
    x, y = data(400)
    bins = boosting.binned(x, [np.quantile(c, np.arange(1, 16) / 16) for c in x.T])
    one, none = np.zeros(400, int), np.array([boosting.unit_exponent(np.abs(y).max())])
    fit = lambda **o: boosting.predict(bins, *boosting.fit_batch(bins, y, one, none, replace(SMALL, rounds=30, **o))[0])
    assert np.abs(fit(l2=0.0) - y).mean() < np.abs(fit(l2=50.0) - y).mean()
    assert np.abs(fit(leaves=12) - y).mean() < np.abs(fit(leaves=2) - y).mean()


def test_rounds_cost_no_jobs(spark, monkeypatch):
    """A job for each wave of splits of each round took 6,000,000 events hours: all rounds of long keys are one stage."""
    split, tracker = rows(spark).cache(), spark.sparkContext.statusTracker()

    def fitted(name, rounds):
        spark.sparkContext.setJobGroup(name, name)
        made = boosting.models(split, F.col("key"), NAMES, "y", "held", replace(SMALL, own_task=60, rounds=rounds)).collect()
        return {r["_key"]: r["model"] for r in made}, len(tracker.getJobIdsForGroup(name))

    try:
        (two, jobs), (nine, more) = fitted("two rounds", 2), fitted("nine rounds", 9)
        assert more <= jobs and set(two) == set(nine) == {"a", "b", None, "tiny"}
        # Where tasks cannot wait for each other, or hold too few rows, jobs give the same trees.
        monkeypatch.setattr(boosting, "_tasks_at_once", lambda _: 0)
        assert fitted("jobs", 2)[0] == two
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_trees_do_not_depend_on_which_task_holds_a_row():
    x, y = data(500)
    cuts = [np.unique(np.quantile(c, np.arange(1, 9) / 9, method="inverted_cdf")) for c in x.T]
    bins, exponent, settings = boosting.binned(x, cuts), boosting.unit_exponent(np.abs(y).max()), replace(SMALL, leaves=9)
    base, want = boosting.fit_batch(bins, y, np.zeros(500, int), np.array([exponent]), settings)[0]
    for dealt in ([slice(None)], [slice(0, 340), slice(0, 0), slice(340, 500)]):
        meeting, told = Barrier(len(dealt), timeout=60), {}

        def grown(part):
            def added(*arrays):
                told[part] = arrays
                meeting.wait()
                sums = [np.sum(of_tasks, axis=0, dtype=float) for of_tasks in zip(*told.values())]
                meeting.wait()
                return sums

            own = dealt[part]
            return boosting.fit_part(np.ascontiguousarray(bins[own].T), y[own], base, exponent, settings.bins, settings, added)

        with ThreadPoolExecutor(len(dealt)) as pool:
            assert all(trees == want for trees in pool.map(grown, range(len(dealt))))
