import math
import random
import statistics

import pytest

from glucospan.operators.medians import exact_median


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(4)
    return {
        "one": [5.0],
        "pair": [-1.0, 2.0],
        "even": [1.0, 2.0, 3.0, 10.0],
        "same": [7.25] * 9,
        "negative": [-rng.expovariate(0.01) for _ in range(301)],
        "across zero": [rng.gauss(0, 0.001) for _ in range(400)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12) for _ in range(500)],
        "near": [1e9 + rng.random() for _ in range(1000)],
        "ties": [float(rng.randint(0, 3)) for _ in range(1000)],
        "infinite": [-math.inf, 1.0, math.inf, math.inf],
    }


def test_matches_statistics(spark, groups):
    rows = [(k, v) for k, values in groups.items() for v in values]
    rows += [("even", None), ("even", math.nan), ("empty", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}


def test_without_keys_and_on_integers(spark):
    df = spark.range(1, 1_000_001).selectExpr("id * 7 as v")
    assert exact_median(df, [], "v").first()[0] == 3_500_003.5
