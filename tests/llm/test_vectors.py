"""Vector searches against brute force: copies, ties, odd vectors, nothing at all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glucospan.llm import ann, hilbert, topk


def rows():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(400, 8)).round(1)
    x[100:220] = x[5]  # one vector many times
    x[300] = 0
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(400, None), (401, [float("nan")] * 8), (402, [None] + [1.0] * 7), (403, [1.0, 2.0]), (None, [1.0] * 8)]
    return out + odd


def table(spark, data):
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    return frame.withColumn("c", F.lit("x")).withColumn("block", F.lit(1))


def usable(zero):
    out = {}
    for i, v in rows():
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = np.array(v + [0.0] * (8 - len(v)))
        if zero or v.any():
            out[i] = v
    return out


@pytest.mark.parametrize("annulus", [16, 4096])
def test_products_are_brute_force(spark, annulus):
    known = {i: np.floor(64 * v) for i, v in usable(True).items()}
    want = set()
    for q in (i for i in known if i % 20 == 0):
        best = sorted((-int(known[q] @ v), i) for i, v in known.items() if i != q)[:20]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = topk.greatest_products(table(spark, rows()), "vec_id", "embedding", F.col("id") % 20 == 0, pivots=6, annulus=annulus)
    assert {tuple(r) for r in got.collect()} == want


def test_large_components_stay_exact(spark):
    data = [(i, [3e9 + i, 1.0]) for i in range(12)]
    got = topk.greatest_products(table(spark, data), "vec_id", "embedding", F.col("id") == 0, k=3).collect()
    own = [int(64 * (3e9 + i)) for i in range(12)]
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [
        (k + 1, i, min(own[0] * own[i] + 64 * 64, 2**63 - 1)) for k, i in enumerate(sorted(range(1, 12), key=lambda i: (-min(own[0] * own[i] + 4096, 2**63 - 1), i))[:3])
    ]


def test_neighbours(spark):
    known = usable(False)
    got = ann.nearest(table(spark, rows()), "vec_id", "embedding", F.col("id") % 100 == 0, block=32).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert r.score == pytest.approx(float(np.linalg.norm(known[r.query_id] - known[r.vec_id])), abs=1e-12)
    assert set(found) == {i for i in known if i % 100 == 0}
    hits = total = 0
    for q, near in found.items():
        near.sort()
        assert [k for k, _, _ in near] == list(range(1, 11)) and [(s, i) for _, i, s in near] == sorted((s, i) for _, i, s in near)
        best = sorted((float(np.linalg.norm(known[q] - v)), i) for i, v in known.items() if i != q)[:10]
        hits += len({i for _, i in best} & {i for _, i, _ in near})
        total += 10
    assert hits / total >= 0.9


def test_nothing(spark):
    empty = table(spark, [])
    assert topk.greatest_products(empty, "vec_id", "embedding", F.col("id") % 20 == 0).count() == 0
    assert ann.nearest(empty, "vec_id", "embedding", F.col("id") % 100 == 0).count() == 0


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    place = hilbert.places(grid, bits)
    assert sorted(place) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


def spread(count, width=24, seed=3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(count, width))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("factor", [1, 1e3, 1e6, 1e300])
def test_recall_holds_beside_a_long_vector(spark, factor, monkeypatch):
    v = spread(1500)
    v[7] *= factor
    windows, fit = [], ann.fitting_window

    def fitted(*args):
        windows.append(fit(*args))
        return windows[-1]

    monkeypatch.setattr(ann, "fitting_window", fitted)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, "vec_id", "embedding", F.col("id") % 20 == 0, curves=32).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q in range(0, 1500, 20):
        with np.errstate(over="ignore"):
            away = np.sqrt(((v - v[q]) ** 2).sum(1))
        away[q] = np.inf
        hits += len(set(np.argsort(away, kind="stable")[:10].tolist()) & set(found[q]))
    assert hits / 750 >= 0.9
    assert 2 * 32 * windows[0] < 1.0  # distances for each query and row
