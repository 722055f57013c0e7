"""Approximate nearest neighbours by several shifted Hilbert orderings.

Each curve projects the vectors onto a few random directions, places each projection by its quantile, shifts the
places, and orders all vectors along a Hilbert curve through them. A vector's candidates are the windows around its
places on all curves; distances in single precision choose among them, and the best are scored exactly.

The window follows a recall: a sample of the queries is searched exhaustively, and their true neighbours' places
tell how wide a window has to be to hold the wanted share of them on at least one curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucospan.llm import hilbert, vectors
from glucospan.storage import stored

#: Single-precision components are held within this, so that their squares stay finite.
HELD = 1e18


def _sample(rows: DataFrame, size: int) -> np.ndarray:
    """Some of the vectors ``v``, those of least hash."""
    rows = rows.orderBy(F.xxhash64("c"), "c").limit(size).select("v").collect()
    return np.stack([np.frombuffer(r.v, "<f8") for r in rows]) if rows else np.zeros((0, 0))


def _on_curves(found: DataFrame, curves: int, axes: int, bits: int, width: int, sample: np.ndarray, seed: int) -> DataFrame:
    """(curve, place, c, asked, w) for each class and curve; w is the vector in single precision."""
    random = np.random.default_rng(seed)
    axes = min(axes, width)
    bases = [np.linalg.qr(random.normal(size=(width, axes)))[0] for _ in range(curves)]
    shifts = [random.uniform(0, 1, axes) for _ in range(curves)]
    shares = np.linspace(0, 1, 1 + min(256, max(1, len(sample) - 1)))
    with np.errstate(over="ignore"):
        edges = [np.quantile(sample @ base, shares, axis=0) for base in bases] if len(sample) else []

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v = vectors.matrix(part.column(1))
            w = np.clip(v, -HELD, HELD).astype("<f4")
            w = pa.array([row.tobytes() for row in w], pa.binary())
            for curve, (base, shift, edge) in enumerate(zip(bases, shifts, edges)):
                p = v @ base
                share = np.column_stack([np.interp(p[:, i], edge[:, i], shares) for i in range(axes)])
                cells = np.floor((share + shift) / 2 * (1 << bits))
                place = hilbert.places(np.clip(cells, 0, (1 << bits) - 1), bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), curve)), pa.array(place), part.column(0), part.column(2), w],
                    names=["curve", "place", "c", "asked", "w"],
                )

    return found.select("c", "v", "asked").mapInArrow(batches, "curve long, place long, c long, asked boolean, w binary")


def _numbered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for rows in parts:
        n = rows.num_rows
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(np.full(n, part)), pa.array(np.arange(at, at + n))],
            names=[*rows.schema.names, "part", "at"],
        )
        at += n


def _along(curve: DataFrame) -> DataFrame:
    """(curve, c, asked, w, pos): every class's place in the order of each curve, from 0."""
    ordered = curve.repartitionByRange("curve", "place", "c").sortWithinPartitions("curve", "place", "c")
    ordered = stored(ordered.mapInArrow(_numbered, "curve long, place long, c long, asked boolean, w binary, part long, at long"))
    # A row for each partition and curve: where its rows begin on the curve.
    pieces = ordered.groupBy("curve", "part").agg(F.count("*").alias("_n"), F.min("at").alias("_least"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("curve", "part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"))
    pieces = F.broadcast(pieces)  # no more rows than partitions and curves together
    return ordered.join(pieces, ["curve", "part"]).select("curve", "c", "asked", "w", (F.col("at") + F.col("_shift")).alias("pos"))


def _exhaustive(found: DataFrame, asked: list, k: int) -> list[tuple[int, int]]:
    """(asking class, neighbour) for the ``k`` nearest other classes of a few classes."""
    ids = np.array([r.c for r in asked])
    q = np.stack([np.frombuffer(r.v, "<f8") for r in asked])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            c, x = part.column(0).to_numpy(), vectors.matrix(part.column(1))
            for low in range(0, len(c), 4096):
                some = slice(low, low + 4096)
                with np.errstate(over="ignore", invalid="ignore"):
                    squares = (q * q).sum(1)[:, None] + (x[some] * x[some]).sum(1) - 2 * (q @ x[some].T)
                squares[ids[:, None] == c[some]] = np.inf
                squares = np.nan_to_num(squares, nan=np.inf)
                near = np.argsort(squares, axis=1, kind="stable")[:, :k]
                a = np.repeat(ids, near.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(c[some][near].ravel()), pa.array(np.take_along_axis(squares, near, 1).ravel())],
                    names=["q", "c", "s"],
                )

    near = Window.partitionBy("q").orderBy("s", "c")
    hits = found.select("c", "v").mapInArrow(batches, "q long, c long, s double").filter(F.col("s") < float("inf"))
    hits = hits.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= k)
    return [(r.q, r.c) for r in hits.select("q", "c").collect()]


def fitting_window(found: DataFrame, placed: DataFrame, total: int, k: int, recall: float, tried: int) -> float:
    """The share of the vectors on either side that holds ``recall`` of the true neighbours of ``tried`` queries."""
    asked = found.filter("asked").orderBy(F.xxhash64("c", F.lit(1)), "c").limit(tried).select("c", "v").collect()
    pairs = _exhaustive(found, asked, k) if asked else []
    if not pairs:
        return 0.0
    wanted = sorted({c for pair in pairs for c in pair})  # at most tried * (k + 1)
    places = placed.filter(F.col("c").isin(wanted)).select("curve", "c", "pos").collect()
    pos: dict[int, dict[int, int]] = {}
    for r in places:
        pos.setdefault(r.c, {})[r.curve] = r.pos
    gaps = [min(abs(pos[a][curve] - pos[b][curve]) for curve in pos[a]) for a, b in pairs]
    return float(np.quantile(gaps, recall, method="higher")) / total


def nearest(
    df: DataFrame, key: str, vector: str, is_query: Column, k: int = 10, curves: int = 32, axes: int = 6, bits: int = 9,
    window: float | None = None, recall: float = 0.94, tried: int = 128, sample: int = 4096, block: int = 4096, seed: int = 11,
) -> DataFrame:
    """The ``k`` nearest found for each query row (``is_query``, over the column ``id``), by Euclidean distance.

    Columns query_id, rank, vec_id, score; ties go to the smaller id, and a query's own id is left out. Vectors
    that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id; shorter
    vectors are filled up with zeros. An id with several vectors counts as several rows. Equal vectors stand
    on the curves once, so any number of copies costs nothing. Other columns are left alone, whatever their names.

    ``window``: share of the vectors on either side; by default as wide as holds ``recall`` of the neighbours of
    ``tried`` queries. Directions' quantiles come from ``sample`` vectors; all vectors stand on all curves.
    """
    width = vectors.longest(df, vector)
    found, queries = vectors.classes(vectors.packed(df, key, vector, lambda v: v, width, zero=False), k + 1, is_query)
    placed = _along(_on_curves(found, curves, axes, bits, width, _sample(found, sample), seed))
    total = found.count()
    if window is None:
        window = fitting_window(found, placed, total, k, recall, tried)
    side = max(2 * (k + 1), math.ceil(window * total))
    top, spread = (max(total, 1) - 1) // block, total // block + 1

    own = placed.select((F.col("curve") * spread + F.floor(F.col("pos") / block)).alias("block"), F.lit(False).alias("asks"), "c", "w", "pos")
    low = F.greatest(F.lit(0), F.floor((F.col("pos") - side) / block))
    high = F.least(F.lit(top), F.floor((F.col("pos") + side) / block))
    asking = placed.filter("asked").select(
        F.col("curve"), F.explode(F.sequence(low, high)).alias("_b"), "c", "w", "pos"
    ).select((F.col("curve") * spread + F.col("_b")).alias("block"), F.lit(True).alias("asks"), "c", "w", "pos")
    kept = 2 * (k + 1)

    def score(held, asked):
        if "x" not in held:
            order = np.argsort(held["pos"])
            held["pos"], held["c"] = held["pos"][order], held["c"][order]
            held["x"] = np.frombuffer(b"".join(held["w"].tolist()), "<f4").reshape(len(order), -1)[order]
        q = np.frombuffer(b"".join(asked["w"].tolist()), "<f4").reshape(len(asked["c"]), -1)
        begin = np.searchsorted(held["pos"], asked["pos"] - side)
        end = np.searchsorted(held["pos"], asked["pos"] + side, "right")
        hits = []
        for i, (a, b) in enumerate(zip(begin, end)):  # nothing but the window is compared
            difference = held["x"][a:b] - q[i]
            squares = np.einsum("ij,ij->i", difference, difference)
            near = np.argpartition(squares, kept)[:kept] if b - a > kept else np.arange(b - a)
            hits.append((np.full(len(near), asked["c"][i]), held["c"][a + near], squares[near].astype(float)))
        yield tuple(np.concatenate(x) for x in zip(*hits))

    hits = vectors.against_blocks(own.unionByName(asking), score, "q long, c long, near double")
    each = Window.partitionBy("q").orderBy("near", "c")
    hits = hits.dropDuplicates(["q", "c"]).withColumn("_r", F.row_number().over(each)).filter(F.col("_r") <= kept)
    return vectors.answers(_exact(hits.select("q", "c"), found), found, queries, k, rising=True)


def _exact(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(q, c, score): the distances of pairs of classes."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            a, b = vectors.matrix(part.column(2)), vectors.matrix(part.column(3))
            score = np.sqrt(((a - b) ** 2).sum(axis=1)) if part.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], names=["q", "c", "score"])

    asking = found.filter("asked").select(F.col("c").alias("q"), F.col("v").alias("a"))
    both = pairs.join(asking, "q").join(found.select("c", F.col("v").alias("b")), "c").select("q", "c", "a", "b")
    return both.mapInArrow(batches, "q long, c long, score double")
