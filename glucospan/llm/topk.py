"""Exact top-k by inner product with a pivot-distance index.

A coordinate added to every vector makes all lengths equal; then the greatest inner product with a query
is the least distance from it. Each vector is keyed by its nearest pivot and its distance from it, and a
pivot's vectors in the order of distance are cut into annuli. A query first looks into the annulus that
holds its own distance from its nearest pivot; the k-th distance found bounds the rest: by the triangle
inequality an annulus whose distances all differ from the query's by more cannot hold a better one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucospan.llm import vectors
from glucospan.storage import stored

#: Sums of integers below this are exact in doubles.
EXACT = 2.0**53
SALTS = 16


def _pivots(found: DataFrame, longest: float, count: int, sample: int) -> np.ndarray:
    """Vectors far from each other among ``sample`` classes, with the added coordinate."""
    rows = found.orderBy(F.xxhash64("c"), "c").limit(sample).select("v").collect()
    if not rows:
        return np.zeros((0, 0))
    v = _lifted(np.stack([np.frombuffer(r.v, "<f8") for r in rows]), longest)
    chosen, far = [0], np.linalg.norm(v - v[0], axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(v - v[chosen[-1]], axis=1))
    return v[chosen]


def _lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """With the added coordinate: all get the length ``longest``."""
    return np.column_stack([v, np.sqrt(np.maximum(longest**2 - (v * v).sum(1), 0))])


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(v - p, axis=1) for p in pivots], axis=1)


def _keyed(found: DataFrame, pivots: np.ndarray, longest: float) -> DataFrame:
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            away = _distances(_lifted(vectors.matrix(part.column(1)), longest), pivots)
            near = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(near), pa.array(away[np.arange(len(near)), near])],
                names=["c", "v", "pivot", "away"],
            )

    return found.select("c", "v").mapInArrow(batches, "c long, v binary, pivot long, away double")


def _cut(size: int):
    """Number consecutive rows of a pivot in runs of ``size``, over all partitions distinct."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, last = (TaskContext.get().partitionId() << 32) - 1, 0, None
        for part in parts:
            pivots = part.column(2).to_numpy()
            out = np.empty(len(pivots), np.int64)
            at = 0
            while at < len(pivots):
                if pivots[at] != last or rows == size:
                    block, rows, last = block + 1, 0, pivots[at]
                same = np.flatnonzero(pivots[at:] != last)
                step = min(size - rows, int(same[0]) if len(same) else len(pivots) - at)
                out[at : at + step] = block
                rows, at = rows + step, at + step
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], names=[*part.schema.names, "block"])

    return batches


def _asked(found: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Asking classes with their distances from all pivots; a query's added coordinate is zero."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v = vectors.matrix(part.column(1))
            away = _distances(np.column_stack([v, np.zeros(len(v))]), pivots)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array((v * v).sum(1)), pa.array(list(away), pa.list_(pa.float64()))],
                names=["c", "v", "square", "aways"],
            )

    return found.filter("asked").select("c", "v").mapInArrow(batches, "c long, v binary, square double, aways array<double>")


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; where sums may pass doubles' exact range, with Python's integers, held in a long."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < EXACT:
        return np.rint(q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = whole(q) @ whole(x).T
    return np.clip(out, -(2**63), 2**63 - 1).astype(np.int64)


def _scorer(most: int):
    def score(held, asked):
        s = _products(asked["v"], held["v"])
        least = asked["least"].astype(np.int64)
        if s.shape[1] > most:
            least = np.maximum(least, np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most])
        a, b = np.nonzero(s >= least[:, None])
        hit = s[a, b]
        keep = vectors.best(a, -hit.astype(float) if np.abs(hit).max(initial=0) < EXACT else ~hit, held["c"][b], most)
        yield asked["c"][a[keep]], held["c"][b[keep]], hit[keep]

    return score


def greatest_products(
    df: DataFrame, key: str, vector: str, is_query: Column, k: int = 20, scale: int = 64,
    pivots: int = 32, sample: int = 2048, annulus: int = 4096,
) -> DataFrame:
    """The ``k`` greatest integer inner products of each query row (``is_query``, over ``id``) with all other rows.

    A component x counts as floor(scale * x). Columns query_id, rank, vec_id, score; ties go to the smaller id.
    Rows with a null id or vector, or with null or non-finite components, take no part; shorter vectors are
    filled up with zeros. Products past a long are held at its ends. The pivots come from ``sample`` vectors,
    but all vectors are indexed, and the answers are exact whatever the pivots.
    """
    width = vectors.longest(df, vector)
    rows = vectors.packed(df, key, vector, lambda v: np.floor(scale * v), width, zero=True)
    found, queries = vectors.classes(rows, k + 1, is_query)
    longest = vectors.greatest_norm(found)
    centres = _pivots(found, longest, pivots, sample)
    keyed = _keyed(found, centres, longest).repartitionByRange("pivot", "away", "c").sortWithinPartitions("pivot", "away", "c")
    index = stored(keyed.mapInArrow(_cut(annulus), "c long, v binary, pivot long, away double, block long"))
    rings = index.groupBy("block").agg(F.first("pivot").alias("pivot"), F.min("away").alias("low"), F.max("away").alias("high"))
    following = Window.partitionBy("pivot").orderBy("low", "high", "block")
    rings = rings.withColumns(
        {
            "from": F.when(F.row_number().over(following) == 1, F.lit(0.0)).otherwise(F.col("low")),
            "to": F.coalesce(F.lead("low").over(following), F.lit(float("inf"))),
        }
    )
    rings = stored(rings.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    asked = stored(_asked(found, centres).withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int")))

    def scored(pairs: DataFrame) -> DataFrame:
        """Hits of pairs (q, block, least) of asking classes and blocks."""
        own = index.select("block", F.lit(False).alias("asks"), "c", "v", F.lit(0).cast("long").alias("least"))
        copies = pairs.join(asked.select(F.col("c").alias("q"), "v"), "q").select("block", F.lit(True).alias("asks"), F.col("q").alias("c"), "v", "least")
        return vectors.against_blocks(own.unionByName(copies), _scorer(k + 1), "q long, c long, score long")

    first = F.array_position("aways", F.array_min("aways")) - 1
    own = asked.select(F.col("c").alias("q"), "salt", first.alias("pivot"), F.array_min("aways").alias("d"))
    held = (F.col("d") >= F.col("from")) & (F.col("d") < F.col("to"))
    lowest = F.lit(-(2**63)).cast("long")
    start = own.join(rings, ["pivot", "salt"]).filter(held).select("q", "block", lowest.alias("least"))
    begun = stored(scored(start))

    bound = begun.groupBy("q").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
    bound = bound.filter(F.col("_n") > k).select("q", F.col("_least").alias("least"))
    rest = asked.select(F.col("c").alias("q"), "salt", "square", "aways").join(bound, "q", "left")
    # Distances within this of the query can still be among the best; a little more, for rounding.
    within = F.sqrt(F.greatest(F.lit(0.0), F.col("square") + longest**2 - 2 * F.col("least"))) * (1 + 1e-9) + 1e-6 * max(longest, 1.0)
    rest = rest.withColumn("within", F.when(F.col("least").isNull(), F.lit(float("inf"))).otherwise(within))
    rest = rest.select("q", "salt", "within", F.coalesce("least", lowest).alias("least"), F.posexplode("aways").alias("pivot", "d"))
    near = (F.col("d") - F.col("high") <= F.col("within")) & (F.col("low") - F.col("d") <= F.col("within"))
    pairs = rest.withColumn("pivot", F.col("pivot").cast("long")).join(rings, ["pivot", "salt"]).filter(near)
    pairs = pairs.select("q", "block", "least").join(start.select("q", "block"), ["q", "block"], "left_anti")
    return vectors.answers(begun.unionByName(scored(pairs)), found, queries, k, rising=False)
