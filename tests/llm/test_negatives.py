"""Hard negatives against brute force: copies, ties, odd vectors, many and few labels, nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glucospan.llm import negatives

SCALE = 4


def rows(labels=4):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(500, 6)).round(1) * draw.choice([0.1, 1, 5], 500)[:, None]
    x[100:260] = x[5]  # one vector many times, under all labels
    x[300] = 0
    out = [(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, draw.integers(0, labels, 500)))]
    odd = [(500, None, 1), (501, [float("nan")] * 6, 1), (510, [None] + [1.0] * 5, 1), (520, [1.0, 2.0], 1), (530, [1.0] * 6, None)]
    return out + odd + [(None, [1.0] * 6, 1), out[7]]


def brute(data):
    known = {}
    for i, v, label in data:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        known[i] = (np.floor(SCALE * np.array(v + [0.0] * (6 - len(v)))), label)
    out = set()
    for a in (i for i in known if i % 10 == 0):
        q, label = known[a]
        scored = sorted((-int(q @ v), i, l == label) for i, (v, l) in known.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fits = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out |= {(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)}
    return out


@pytest.mark.parametrize("labels, cut", [(4, (16, 4, 0.9, 40, 7)), (4, (2048, 256, 0.95, 32768, 32768)), (200, (16, 8, 0.9, 50, 1000)), (1, (64, 8, 0.9, 64, 64))])
def test_negatives_are_brute_force(spark, labels, cut):
    data = rows(labels)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    df = df.withColumn("c", F.lit("x")).withColumn("v", F.lit(1)).withColumn("id", F.lit(-1))
    bucket, least, ratio, tile, asking = cut
    got = negatives.hard_negatives(
        df, "vec_id", "embedding", "label", F.col("id") % 10 == 0, scale=SCALE,
        bucket=bucket, least=least, ratio=ratio, tile=tile, asking=asking,
    )
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(data)
    assert labels == 1 or len(found) > 100


def test_candidates_lose_nothing_and_prune():
    draw = np.random.default_rng(1)
    v = draw.normal(size=(800, 5))
    v[:, 0] *= 4
    length = np.linalg.norm(v, axis=1)
    bucket = negatives._Bucket(v, length, np.arange(800), np.zeros(800))
    pruned = 0
    for q in draw.normal(size=(40, 5)):
        unit = q / np.linalg.norm(q)
        cosines = v @ unit / length
        for bound in (0.5, 0.9, 0.99):
            some = bucket.candidates(unit, bound, 3)
            if some is not None:
                assert set(np.flatnonzero(cosines >= bound)) <= set(some.tolist())
                pruned += len(some) < 200
    assert pruned > 40


def test_nothing(spark):
    for data in ([], [(0, None, None)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]):
        df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
        assert negatives.hard_negatives(df, "vec_id", "embedding", "label", F.col("id") % 10 == 0).count() == 0
