"""Vectors as packed rows: classes of equal vectors, blocks against queries, and answers by id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucospan.storage import stored

QUERY_SLICE = 256


def matrix(column: pa.Array) -> np.ndarray:
    """Binary rows of equal length as a matrix of doubles."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1 if rows else 0)


def rows_of(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(values, "<f8")], pa.binary())


def packed(df: DataFrame, key: str, vector: str, change: Callable[[np.ndarray], np.ndarray], width: int, zero: bool, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, v): the usable vectors, changed, as binary doubles, and the long columns ``also``.

    Rows with a null id, a null vector, or null or non-finite components are left out, and vectors of zeros
    only unless ``zero``. Shorter vectors are filled up with zeros to ``width``.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.values.cast(pa.float64())
            first = column.offsets[0].as_py()
            flat = flat.slice(first, int(lengths.sum())).to_numpy(zero_copy_only=False)
            grid = np.zeros((len(lengths), width))
            grid[np.arange(width)[None, :] < lengths[:, None]] = flat
            good = np.isfinite(grid).all(axis=1)
            if not zero:
                good &= (grid != 0).any(axis=1)
            at = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at)), rows_of(change(grid[at])), *(c.take(pa.array(at)) for c in part.columns[2:])],
                names=["id", "v", *also],
            )

    usable = F.col(f"`{key}`").isNotNull() & F.col(f"`{vector}`").isNotNull()
    rows = df.filter(usable).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`"), *also)
    return rows.mapInArrow(batches, ", ".join(["id long", "v binary", *(f"{c} long" for c in also)]))


def longest(df: DataFrame, vector: str) -> int:
    return df.agg(F.max(F.size(F.col(f"`{vector}`")))).first()[0] or 0


def greatest_norm(rows: DataFrame) -> float:
    """The length of the longest of the vectors ``v``; 0 if there are none."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            most = np.linalg.norm(matrix(part.column(0)), axis=1).max(initial=0.0)
            yield pa.RecordBatch.from_arrays([pa.array([float(most)])], names=["n"])

    return rows.select("v").mapInArrow(batches, "n double").agg(F.max("n")).first()[0] or 0.0


def classes(rows: DataFrame, members: int, is_query: Column) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors, (c, v, ids, asked), and queries, (id, c); both stored.

    ``ids`` are the smallest ``members`` ids of a class and ``c`` the smallest. ``asked``: a query is in it.
    The ranks are cut before the shuffle too, so one vector may belong to a large part of all rows.
    """
    rows = stored(rows.dropDuplicates(["id", "v"]))
    rank = Window.partitionBy("v").orderBy("id")
    least = rows.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= members)
    grouped = least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    grouped = grouped.select(F.element_at("ids", 1).alias("c"), "v", "ids")
    asked = rows.filter(is_query)
    found = stored(grouped.join(asked.select("v").distinct().withColumn("asked", F.lit(True)), "v", "left").fillna(False, "asked"))
    queries = asked.join(found.filter("asked").select("c", "v"), "v").select("id", "c")
    return found, stored(queries)


def against_blocks(
    rows: DataFrame, score: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], Iterator], schema: str
) -> DataFrame:
    """Run ``score(block, queries)`` for the rows of each block and each slice of its queries.

    ``rows``: (block long, asks boolean, c long, v binary, ...); those that do not ask make up the block,
    which must be of bounded size, and any number of queries may follow. ``score`` gets all columns as arrays
    (``v`` as a matrix) and yields tuples of columns.
    """
    names = rows.columns

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None
        for part in parts:
            if not part.num_rows:
                continue
            columns = {n: matrix(part.column(i)) if n == "v" else part.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
            change = (np.diff(columns["block"]) != 0) | (np.diff(columns["asks"].astype(np.int8)) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), part.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if columns["block"][a] != current:
                    current, held, block = columns["block"][a], [], None
                some = {n: x[a:b] for n, x in columns.items()}
                if not some["asks"][0]:
                    held.append(some)
                    continue
                if not held:
                    continue
                if block is None:
                    block = {n: np.concatenate([h[n] for h in held]) for n in names}
                for first in range(0, b - a, QUERY_SLICE):
                    yield from map(
                        made, score(block, {n: x[first : first + QUERY_SLICE] for n, x in some.items()})
                    )

    fields = [f.split()[0] for f in schema.split(", ")]

    def made(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=fields)

    ordered = rows.repartition("block").sortWithinPartitions("block", "asks")
    return ordered.mapInArrow(batches, schema)


def best(query: np.ndarray, rank: np.ndarray, member: np.ndarray, most: int) -> np.ndarray:
    """Which hits are among the ``most`` of their query by (rank, member)."""
    order = np.lexsort((member, rank, query))
    q = query[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < most]


def answers(hits: DataFrame, found: DataFrame, queries: DataFrame, most: int, rising: bool) -> DataFrame:
    """(query_id, rank, vec_id, score) from hits (q, c, score) between classes; ties go to the smaller id.

    ``hits`` must hold the best ``most + 1`` classes of each asking class, in any order and repeated or not.
    """
    score = F.col("score") if rising else -F.col("score")
    top = Window.partitionBy("q").orderBy(score, "c")
    near = hits.dropDuplicates(["q", "c"]).withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= most + 1)
    ids = found.select("c", "ids")
    each = near.join(ids, "c").select("q", "score", F.explode("ids").alias("vec_id"))
    member = Window.partitionBy("q").orderBy(score, "vec_id")
    each = each.withColumn("_r", F.row_number().over(member)).filter(F.col("_r") <= most + 1)
    lists = each.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("near"))
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    return (
        queries.select(F.col("id").alias("query_id"), F.col("c").alias("q"))
        .join(lists, "q")
        .select("query_id", F.posexplode(F.slice(own, 1, most)).alias("_at", "_x"))
        .select("query_id", (F.col("_at") + 1).alias("rank"), "_x.vec_id", "_x.score")
    )
