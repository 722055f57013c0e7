"""Random regression forests: every tree on its own draw of the rows, many trees at a time.

Features are cut at quantiles, as for boosted trees. A tree takes each row as often as a Poisson draw says, and each
node looks at some features of its own. Targets are counted in whole units of a power of two, so sums are exact
and the trees of stored rows do not depend on how a tree's rows are dealt over tasks.

* A tree, or what lies below one of its nodes, is grown in one task once it has at most ``own_task`` rows: the rows
  drawn are shuffled by (tree, node).
* Above that the rows stay where they are. Each level adds up histograms map-side, then by (tree, node); only the
  best split of a node comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucospan.operators.boosting import _matrix, binned, facts, unit_exponent
from glucospan.storage import stored


@dataclass(frozen=True)
class Settings:
    trees: int = 120
    depth: int = 18
    least: int = 8
    #: Features a node looks at.
    features: int = 1
    rate: float = 0.35
    bins: int = 32
    seed: int = 42
    #: Rows drawn that one task may hold (about 50 bytes and two bytes a feature each).
    own_task: int = 1_000_000
    #: Rows drawn that are shuffled at a time (12 bytes and more each): several trees' or one tree's.
    moved: int = 200_000_000
    #: Histogram cells (nodes * features * bins) a task holds at a time.
    cells: int = 4_000_000


BLOCK = 4096
#: Rows drawn for a tree below which it may well be none.
FEW = 1000
SCHEMA = "tree int, start long, feature binary, cut binary, left binary, value binary, nodes long"
#: Types of a tree's arrays. Children follow their parents; ``left`` is 0 at a leaf and right is left + 1.
KINDS = {"feature": np.int16, "cut": np.uint8, "left": np.int32, "value": np.float64}


def draws(block: int, rows: int, tree: int, settings: Settings) -> np.ndarray:
    """How often a tree takes each row of a block."""
    return np.random.default_rng([settings.seed % 2**32, tree, block]).poisson(settings.rate, rows)


def looked_at(tree: int, nodes: np.ndarray, count: int, settings: Settings) -> np.ndarray:
    """Which of ``count`` features each node of a tree looks at; nodes go by their number in a full binary tree."""
    x = nodes.astype(np.uint64)[:, None] * np.uint64(count) + np.arange(count, dtype=np.uint64)
    x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(hash((settings.seed, tree)) % 2**64)
    for shift, factor in [(30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)]:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x.argsort(axis=1).argsort(axis=1) < settings.features


def best_cuts(g: np.ndarray, n: np.ndarray, total: np.ndarray, count: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest gain in squared error and its bin, for nodes' histograms (node, bin) of one feature."""
    g, n = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    total, count = total[:, None], count[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (g * count - total * n) ** 2 / (n * (count - n) * count)
    gain = np.where((n >= least) & (count - n >= least), gain, 0.0)
    at = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), at], at


def grown(x: np.ndarray, w: np.ndarray, units: np.ndarray, tree: int, start: int, settings: Settings) -> dict[str, np.ndarray]:
    """What lies below node ``start``: bins (row, feature), how often each row was drawn, and targets in units.

    Values are sums of units over draws. Among equal gains the first feature, then the first bin.
    """
    x, w = np.ascontiguousarray(x.T), w.astype(float)
    g, width, count = w * units, int(x.max(initial=0)) + 1, len(x)
    out: dict[str, list] = {n: [] for n in KINDS}
    at, ids, base, depth = np.zeros(len(w), np.int64), np.array([start], np.uint64), 0, start.bit_length() - 1
    above = None  # histograms of the nodes split on the level before
    while True:
        k = len(ids)
        total, size = np.bincount(at, g, k), np.bincount(at, w, k)
        feature, cut = np.full(k, -1, np.int16), np.zeros(k, np.uint8)
        held = None
        if depth < settings.depth and width > 1:
            gain, looks = np.zeros(k), looked_at(tree, ids, count, settings)
            keep = 2 * k * count * width <= settings.cells
            if keep:
                held = np.empty((2, count, k, width))
            if above is not None:  # count the smaller child of two, the other one is the rest
                small = 2 * np.arange(k // 2) + (size[1::2] < size[::2])
                counted = np.zeros(k, bool)
                # Two children too small for a split need no histogram.
                counted[small] = np.maximum(size[1::2], size[::2]) >= 2 * settings.least
                rows = np.flatnonzero(counted[at])
                place, own, mine = (at.take(rows) >> 1) * width, x.take(rows, axis=1), (g.take(rows), w.take(rows))
            else:
                place, own, mine = at * width, x, (g, w)
            for f in range(count):
                cell = place + own[f]
                if above is not None:
                    both = []
                    for v, before in zip(mine, above):
                        one, pair = np.bincount(cell, v, k // 2 * width).reshape(-1, width), np.empty((k, width))
                        pair[small], pair[small ^ 1] = one, before[f] - one
                        both.append(pair)
                else:
                    both = [np.bincount(cell, v, k * width).reshape(k, width) for v in mine]
                if keep:
                    held[0, f], held[1, f] = both
                found, where = best_cuts(*both, total, size, settings.least)
                better = looks[:, f] & (found > gain)
                feature[better], cut[better], gain[better] = f, where[better], found[better]
        split = feature >= 0
        child = 2 * (np.cumsum(split) - 1)
        out["feature"].append(feature)
        out["cut"].append(cut)
        out["left"].append(np.where(split, base + k + child, 0).astype(np.int32))
        out["value"].append(total / np.maximum(size, 1))
        if not split.any():
            return {n: np.concatenate(v) for n, v in out.items()}
        above = None if held is None else held[:, :, split]
        rows = np.flatnonzero(split[at])
        node = at.take(rows)
        at = child[node] + (x.ravel().take(feature[node].astype(np.int64) * x.shape[1] + rows) > cut[node])
        x, w, g = x.take(rows, axis=1), w.take(rows), g.take(rows)
        parents = ids[split] * np.uint64(2)
        ids = np.column_stack([parents, parents + np.uint64(1)]).ravel()
        base, depth = base + k, depth + 1


def values(x: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    """The value of each row of bin numbers."""
    at, live = np.zeros(len(x), np.int32), np.arange(len(x))
    feature, cut, left = tree["feature"], tree["cut"], tree["left"]
    while len(live):
        node = at[live]
        inner = left[node] > 0
        live, node = live[inner], node[inner]
        at[live] = left[node] + (x[live, feature[node]] > cut[node])
    return tree["value"][at]


def _routed(x: np.ndarray, steps: dict[int, tuple[int, int]]) -> np.ndarray:
    """The number of the node in which each row ends after the splits in ``steps``."""
    node = np.ones(len(x), np.int64)
    for p, (f, cut) in sorted(steps.items()):
        at = np.flatnonzero(node == p)
        node[at] = 2 * p + (x[at, f] > cut)
    return node


def _blocks(parts: Iterator[pa.RecordBatch], count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in parts:
        for block, bins, units in zip(*(batch.column(i) for i in range(3))):
            yield block.as_py(), np.frombuffer(bins.as_py(), np.uint8).reshape(-1, count), np.frombuffer(units.as_py(), np.int32)


def fit(rows: DataFrame, features: Sequence[str], target: str, settings: Settings) -> tuple[DataFrame, list, float, float]:
    """(trees, cut points, least and greatest target): a stored row for each tree. ``rows`` are the training rows, stored.

    Features are numbers without gaps, targets are not NULL.
    """
    known = facts(rows.withColumn("_test", F.lit(False)), F.lit(0), features, target, "_test", settings.bins).first()
    if known is None or not known["_n"]:
        raise ValueError("no rows to fit on")
    ends = rows.agg(F.min(target).alias("least"), F.max(target).alias("most"), F.avg(target).alias("mean")).first()
    cuts, unit, count = [list(c) for c in known["_cuts"]], float(np.ldexp(1.0, unit_exponent(known["_greatest"]))), len(features)

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in parts:
            x = binned(_matrix(batch, features), cuts)
            units = np.rint(_matrix(batch, [target])[:, 0] * unit).astype(np.int32)
            for low in range(0, len(x), BLOCK):
                part = slice(low, low + BLOCK)
                yield pa.RecordBatch.from_pydict({"block": [block], "bins": [x[part].tobytes()], "units": [units[part].tobytes()]})
                block += 1

    work = stored(rows.select(*dict.fromkeys([*features, target])).mapInArrow(packed, "block long, bins binary, units binary"))
    drawn = max(1.0, settings.rate * known["_n"])
    if drawn > settings.own_task:
        tops = _tops(work, count, settings, unit)
    else:  # of a few rows a tree may draw none
        tops = {t: ({}, {1: ends["mean"]} if drawn < FEW else {}, [1]) for t in range(settings.trees)}
    at_once, made = max(1, int(settings.moved / drawn)), None
    for low in range(0, settings.trees, at_once):
        some = _below(work, {t: tops[t] for t in range(low, min(low + at_once, settings.trees))}, count, settings, unit)
        made = some if made is None else made.unionByName(some)
    return made, cuts, float(ends["least"]), float(ends["most"])


def _below(work: DataFrame, tops: dict, count: int, settings: Settings, unit: float) -> DataFrame:
    """Whole trees: the nodes that a task can hold are grown, each in one task, and put below the tops."""

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, x, units in _blocks(parts, count):
            out: dict[str, list] = {"tree": [], "start": [], "bins": [], "units": [], "times": []}
            for tree, (steps, _, starts) in tops.items():
                times = draws(block, len(x), tree, settings)
                hit = np.flatnonzero(times)
                node = _routed(x[hit], steps)
                for start in starts:
                    mine = hit[node == start] if steps else hit
                    if len(mine):
                        row = (tree, start, x[mine].tobytes(), units[mine].tobytes(), times[mine].astype(np.uint8).tobytes())
                        for held, cell in zip(out.values(), row):
                            held.append(cell)
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    def tree_below(table: pa.Table) -> pa.Table:
        tree, start = table["tree"][0].as_py(), table["start"][0].as_py()
        bins, units, times = (b"".join(table[n].to_pylist()) for n in ("bins", "units", "times"))
        x = np.frombuffer(bins, np.uint8).reshape(-1, count)
        made = grown(x, np.frombuffer(times, np.uint8), np.frombuffer(units, np.int32), tree, start, settings)
        made["value"] = made["value"] / unit
        return _row(tree, start, made)

    def whole(table: pa.Table) -> pa.Table:
        tree = table["tree"][0].as_py()
        parts = {r["start"]: {n: np.frombuffer(r[n], k) for n, k in KINDS.items()} for r in table.to_pylist()}
        return _row(tree, 1, _joined(*tops[tree][:2], parts))

    nodes = sum(len(starts) for _, _, starts in tops.values())
    shares = work.mapInArrow(pieces, "tree int, start long, bins binary, units binary, times binary")
    by = ["tree", "start"]
    found = shares.repartition(max(1, nodes), *by).groupBy(*by).applyInArrow(tree_below, SCHEMA)
    if any(steps or leaves for steps, leaves, _ in tops.values()):
        # A tree may have nothing grown below its top.
        empty = work.sparkSession.createDataFrame([(t, 0, b"", b"", b"", b"", 0) for t in tops], SCHEMA)
        found = stored(found).unionByName(empty).groupBy("tree").applyInArrow(whole, SCHEMA)
    return stored(found)


def _row(tree: int, start: int, made: dict[str, np.ndarray]) -> pa.Table:
    cells = {n: pa.array([made[n].astype(k).tobytes()], pa.binary()) for n, k in KINDS.items()}
    return pa.table({"tree": pa.array([tree], pa.int32()), "start": [start], **cells, "nodes": [len(made["left"])]})


def _joined(steps: dict[int, tuple[int, int]], leaves: dict[int, float], parts: dict[int, dict]) -> dict[str, np.ndarray]:
    """A tree of its top and what was grown below: top nodes come in order of their numbers, so children are neighbours."""
    ids = sorted({1, *(c for p in steps for c in (2 * p, 2 * p + 1))})
    place = {node: i for i, node in enumerate(ids)}
    out = {
        "feature": [np.array([steps[p][0] if p in steps else -1 for p in ids], np.int16)],
        "cut": [np.array([steps[p][1] if p in steps else 0 for p in ids], np.uint8)],
        "left": [np.array([place[2 * p] if p in steps else 0 for p in ids], np.int32)],
        "value": [np.array([leaves.get(p, 0.0) for p in ids])],
    }
    base = len(ids)
    for start, made in parts.items():
        if not len(made["left"]):
            continue
        moved = {**made, "left": np.where(made["left"] > 0, made["left"] + np.int32(base - 1), 0)}
        for n in KINDS:
            out[n][0][place[start]] = moved[n][0]
            out[n].append(moved[n][1:])
        base += len(made["left"]) - 1
    return {n: np.concatenate(v) for n, v in out.items()}


def _tops(work: DataFrame, count: int, settings: Settings, unit: float) -> dict[int, tuple[dict, dict, list[int]]]:
    """(splits, leaves, nodes that a task can hold) of each tree, level by level."""
    tops: dict[int, tuple[dict, dict, list[int]]] = {t: ({}, {}, []) for t in range(settings.trees)}
    most = max(1, settings.cells // (count * settings.bins))
    asked = [(t, 1) for t in tops]
    while asked:
        found = {}
        for low in range(0, len(asked), most):
            found |= _level(work, {t: tops[t][0] for t in tops}, asked[low : low + most], count, settings)
        asked = []
        for (tree, node), r in found.items():
            steps, leaves, starts = tops[tree]
            if r["rows"] <= settings.own_task:
                starts.append(node)
            elif r["feature"] < 0:
                leaves[node] = r["total"] / r["rows"] / unit
            else:
                steps[node] = r["feature"], r["cut"]
                for child, size in ((2 * node, r["left"]), (2 * node + 1, r["rows"] - r["left"])):
                    (asked.append((tree, child)) if size > settings.own_task else starts.append(child))
    return tops


def _level(work: DataFrame, steps: dict, asked: list[tuple[int, int]], count: int, settings: Settings) -> dict:
    """Best split, sum and rows of each (tree, node) asked for."""
    slots: dict[int, dict[int, int]] = {}
    for i, (tree, node) in enumerate(asked):
        slots.setdefault(tree, {})[node] = i
    width = settings.bins
    wanted = {t: steps[t] for t in slots}

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = (np.zeros((len(asked), count * width), np.int64) for _ in range(2))
        for block, x, units in _blocks(parts, count):
            cells = x + np.arange(count) * width  # of all features
            for tree, own in slots.items():
                times = draws(block, len(x), tree, settings)
                hit = np.flatnonzero(times)
                node = _routed(x[hit], wanted[tree])
                for p, i in own.items():
                    mine = hit[node == p]
                    cell, w = cells[mine].ravel(), times[mine]
                    for held, v in ((sums, w * units[mine].astype(float)), (sizes, w)):
                        held[i] += np.bincount(cell, np.repeat(v, count), count * width).astype(np.int64)
        for (tree, node), s, n in zip(asked, sums, sizes):
            cells = {"tree": pa.array([tree], pa.int32()), "node": [node], "g": [s.tobytes()], "n": [n.tobytes()]}
            yield pa.RecordBatch.from_pydict(cells)

    def best(table: pa.Table) -> pa.Table:
        tree, node = table["tree"][0].as_py(), table["node"][0].as_py()
        g, n = (sum(np.frombuffer(b, np.int64) for b in table[c].to_pylist()).reshape(count, width).astype(float) for c in "gn")
        total, rows = g[:1].sum(1), n[:1].sum(1)
        feature, cut, gain, left = -1, 0, 0.0, 0
        looks = looked_at(tree, np.array([node]), count, settings)[0]
        for f in np.flatnonzero(looks) if node.bit_length() <= settings.depth else []:
            (found,), (at,) = best_cuts(g[f : f + 1], n[f : f + 1], total, rows, settings.least)
            if found > gain:
                feature, cut, gain, left = int(f), int(at), found, int(n[f, : at + 1].sum())
        cells = {"feature": feature, "cut": cut, "left": left, "total": float(total[0]), "rows": int(rows[0])}
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": [node], **{k: [v] for k, v in cells.items()}})

    sums = work.mapInArrow(added, "tree int, node long, g binary, n binary")
    found = sums.groupBy("tree", "node").applyInArrow(best, "tree int, node long, feature long, cut long, left long, total double, rows long")
    return {(r["tree"], r["node"]): r for r in found.collect()}
