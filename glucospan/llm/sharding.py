"""Shards of nearly equal bytes in the order of a key: histogram sort.

Bytes and rows below candidate boundaries are counted exactly over all partitions. The first candidates
divide all keys evenly; each further round puts finer ones only where a splitter is still too coarse.
When every splitter is within the tolerance, the rows are exchanged once, straight to their place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucospan.storage import stored

#: Sorts after every hexadecimal digit.
PAST = "g"


@dataclass
class Splitter:
    """Rows with a key below ``boundary`` come before it: so many bytes and rows."""

    boundary: str
    bytes: int
    rows: int


def _closest(target: int, low: Splitter, high: Splitter) -> Splitter:
    return low if target - low.bytes <= high.bytes - target else high


def splitters(keys: DataFrame, targets: list[int], digits: int, tolerance: int, first: int = 3, step: int = 2) -> list[Splitter]:
    """For each target (rising), the key boundary with about so many bytes below it.

    ``keys``: a stored table (key, size); keys are ``digits`` lower-case hexadecimal digits. A boundary is
    off by ``tolerance`` at most, or by what lies on a single key. A round sends the driver the counts of
    ``16 ** first`` candidates, and of ``16 ** step`` more for each splitter still open. It reads only the keys
    of open splitters and begins where those of a splitter first differ, so that many keys of one beginning cost
    no rounds of their own.
    """
    out: list[Splitter | None] = [None] * len(targets)
    open_at = {"": list(range(len(targets)))}
    below = {"": (0, 0)}
    rows, grain = keys.select("key", "size", F.lit(0).alias("at")), first
    while open_at:
        rows = rows.withColumn("prefix", F.col("key").substr(F.lit(1), F.least(F.col("at") + grain, F.lit(digits))))
        counts = rows.groupBy("at", "prefix").agg(
            F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")
        ).collect()
        by_parent: dict[str, list] = {p: [] for p in open_at}
        for r in sorted(counts, key=lambda r: r.prefix):
            by_parent[r.prefix[: r.at]].append(r)
        still: dict[str, list[int]] = {}
        further, jumps = {}, []
        for parent, waiting in open_at.items():
            some, rank = below[parent]
            at = 0
            for r in by_parent[parent]:
                low = Splitter(r.prefix, some, rank)
                some, rank = some + r.bytes, rank + r.rows
                high = Splitter(r.prefix + PAST, some, rank)
                common = commonprefix([r.low, r.high])
                while at < len(waiting) and targets[waiting[at]] <= some:
                    target = waiting[at]
                    if r.bytes <= tolerance or r.low == r.high or targets[target] == some:
                        out[target] = _closest(targets[target], low, high)
                    else:
                        if common not in still:
                            jumps.append((r.prefix, len(common)))
                        still.setdefault(common, []).append(target)
                        further[common] = (low.bytes, low.rows)
                    at += 1
        open_at, below, grain = still, further, step
        if open_at:
            wanted = keys.sparkSession.createDataFrame(jumps, "prefix string, jump int")  # one row for each open splitter at most
            rows = stored(rows.join(F.broadcast(wanted), "prefix").select("key", "size", F.col("jump").alias("at")))
    return out


def shards(
    df: DataFrame, key: Column, digits: int, size: Column, count: int,
    tolerance: float = 0.001, range_bytes: int = 128 << 20,
) -> DataFrame:
    """Add ``size``, ``shard`` (from 0) and ``slot`` (its place in the shard, gapless from 0).

    ``key``: the sort key as ``digits`` lower-case hexadecimal digits, never null; ``size``: bytes as a long.
    Shards hold equal bytes up to ``tolerance`` of a shard and one row. Rows with one key stay together, so the
    key should tell rows apart; rows alike in the whole key come in any order. A shard is exchanged in ranges
    of about ``range_bytes``, so that no task holds a whole one. An empty table gives no rows; columns of the
    new names are replaced.
    """
    df = df.withColumns({"size": size, "_key": key})
    keys = stored(df.select(F.col("_key").alias("key"), "size"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, math.ceil(total / count / range_bytes))
    targets = [total * i // (count * parts) for i in range(1, count * parts)]
    found = splitters(keys, targets, digits, max(1, int(total / count * tolerance)), step=2) if total else []
    starts = [Splitter("", 0, 0), *found]
    boundaries = np.array([s.boundary for s in found], object)
    table = df.sparkSession.createDataFrame(
        [(i, i // parts, s.rows - starts[i // parts * parts].rows) for i, s in enumerate(starts)],
        "_range int, shard int, _ahead long",
    )

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(boundaries, keys.to_numpy(object), "right").astype(np.int32))

    inside = Window.partitionBy("_range").orderBy("_key")
    placed = df.drop("shard", "slot").withColumn("_range", range_of("_key"))
    placed = placed.withColumn("_at", F.row_number().over(inside) - 1)
    placed = placed.join(F.broadcast(table), "_range")  # one row for each range
    return placed.withColumn("slot", F.col("_at") + F.col("_ahead")).drop("_key", "_range", "_at", "_ahead")
