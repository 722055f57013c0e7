"""Boosted regression trees grown leaf by leaf, for one model or a model of its own for every key.

Features are cut at quantiles into at most ``bins`` bins. A tree grows by splitting the leaf of greatest gain
until it has ``leaves`` leaves; a leaf's value is shrunk by an L2 penalty. Residuals are counted in whole
units of a power of two, so their sums are exact and trees do not depend on how rows are dealt over tasks.

A tree grows in waves. The splits of all leaves known so far say which leaves would be split next; those not yet
searched are searched together, with one histogram of (node, feature, bin) for the models of a whole batch,
until the queue of greatest gains needs no further one.

* Keys with up to ``own_task`` rows: many keys together in one task, rows streamed in by key.
* Keys with more: their rows are dealt over all tasks that can run at once, which stay for all rounds (a barrier
  stage). After each wave the tasks add up their histograms through files in the shared folder.
* Where tasks cannot wait for each other (executors come and go, or too few of them hold the rows), each wave is a
  job of its own: histograms are added up map-side, then by (key, node, feature); only the best split of a node
  comes to the driver.

All give the same trees.
"""

from __future__ import annotations

import heapq
import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucospan.storage import fresh_folder, place, stored


@dataclass(frozen=True)
class Settings:
    """Rounds, step size, leaves and L2 penalty of the forecasting model."""

    rounds: int = 300
    step: float = 0.055
    leaves: int = 31
    l2: float = 0.6
    least: int = 20
    bins: int = 255
    #: Training rows of a key that one task may hold (about 40 bytes and one byte a feature each).
    own_task: int = 1_000_000
    #: Histogram cells (nodes * features * bins) a task holds at a time.
    cells: int = 4_000_000
    #: Training rows, of all keys with more than ``own_task``, that a task may hold beside others of a barrier stage.
    held: int = 8_000_000


#: Residuals are whole numbers of a unit that makes the greatest target about this many of them.
UNITS = 28
#: Cut points are exact for keys of up to about half as many rows, else off by at most a row in so many.
ACCURACY = 100_000


def unit_exponent(greatest: float) -> int:
    return UNITS - int(np.ceil(np.log2(greatest))) if greatest > 0 else UNITS


@dataclass
class Tree:
    """Nodes by number: children follow their parents. ``left`` is 0 at a leaf; right is left + 1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def apply(self, bins: np.ndarray) -> np.ndarray:
        """The value of each row of bin numbers."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, left = (np.array(x) for x in (self.feature, self.bin, self.left))
        live = np.flatnonzero(left[at] > 0)
        while len(live):
            node = at[live]
            at[live] = left[node] + (bins[live, feature[node]] > cut[node])
            live = live[left[at[live]] > 0]
        return np.array(self.value)[at]


class _Growth:
    """One tree while it grows: the best split of each node that was searched, if it has one."""

    def __init__(self, leaves: int):
        self.leaves = leaves
        self.split: dict[int, tuple | None] = {}  # node -> (gain, feature, bin, left sum, left count)
        self.total: list[tuple[int, int]] = []  # node -> (sum, count)
        self.left: dict[int, int] = {}

    def root(self, total: int, count: int) -> None:
        self.total = [(total, count)]

    def wave(self) -> tuple[list[int], list[int]]:
        """Nodes in the order in which the queue splits them, and nodes split now whose children are to be searched.

        A child that was not searched yet counts as not worth a split, so what is searched may be more than
        needed but never less; without any to search the order is final.
        """
        order, fresh, queue = [], [], []

        def offer(node: int) -> None:
            if (s := self.split.get(node)) is not None:
                heapq.heappush(queue, (-s[0], node))

        offer(0)
        while queue and len(order) < self.leaves - 1:
            node = heapq.heappop(queue)[1]
            order.append(node)
            if node in self.left:
                offer(self.left[node])
                offer(self.left[node] + 1)
            else:
                fresh.append(node)
        for node in fresh:
            _, _, _, s, n = self.split[node]
            total, count = self.total[node]
            self.left[node] = len(self.total)
            self.total += [(s, n), (total - s, count - n)]
        if len(order) == self.leaves - 1 and fresh == order[-1:]:
            fresh = []  # the children of the last split stay leaves
        return order, fresh

    def tree(self, order: list[int], unit: float, step: float, l2: float) -> Tree:
        """The tree of the splits in ``order``."""
        return self.settled(order, unit, step, l2)[0]

    def settled(self, order: list[int], unit: float, step: float, l2: float) -> tuple[Tree, np.ndarray]:
        """The tree, and the value of each node as numbered here; what lies below a leaf has the leaf's."""
        out, number, queue, taken = Tree(), {0: 0}, [0], set(order)
        while queue:
            node = queue.pop(0)
            at = number[node]
            if node in taken:
                _, out.feature[at], out.bin[at], _, _ = self.split[node]
                out.left[at] = len(out.left)
                for child in (self.left[node], self.left[node] + 1):
                    number[child] = len(out.left)
                    out.feature.append(-1)
                    out.bin.append(-1)
                    out.left.append(0)
                    out.value.append(0.0)
                    queue.append(child)
            else:
                total, count = self.total[node]
                out.value[at] = step * (total / (count + l2)) * unit
        values = np.zeros(len(self.total))
        for node, at in number.items():
            values[node] = out.value[at]
        for node, low in sorted(self.left.items()):
            for child in (low, low + 1):
                if child not in number:
                    values[child] = values[node]
        return out, values


def best_splits(g: np.ndarray, n: np.ndarray, l2: float, least: int) -> list[tuple | None]:
    """The best split of each node from its histograms (node, feature, bin) of residuals and of rows.

    Among equal gains the first feature, then the first bin. A split must gain and leave ``least`` rows a side.
    """
    total, count = g[:, :1].sum(2, keepdims=True), n[:, :1].sum(2, keepdims=True)
    left, rows = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(n, axis=2)[:, :, :-1]
    right, others = total - left, count - rows
    with np.errstate(invalid="ignore"):  # without a penalty an empty side is no number
        gain = left * left / (rows + l2) + right * right / (others + l2) - total * total / (count + l2)
    gain = np.where((rows >= least) & (others >= least), gain, 0.0).reshape(len(g), -1)
    if not gain.shape[1]:
        return [None] * len(g)
    best = gain.argmax(axis=1)
    each = np.arange(len(g))
    cuts = left.shape[2]
    sums, sizes, gains = (x.reshape(len(g), -1)[each, best] for x in (left, rows, gain))
    return [
        (float(v), int(b) // cuts, int(b) % cuts, int(s), int(k)) if v > 0 else None
        for v, b, s, k in zip(gains, best, sums, sizes)
    ]


def _histograms(bins: np.ndarray, node: np.ndarray, g: np.ndarray, nodes: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of whole numbers by (node, feature, bin), and counts."""
    shape = (nodes, bins.shape[1], width)
    sums, counts = np.zeros(shape), np.zeros(shape)
    base = node * width
    for f in range(bins.shape[1]):
        key = base + bins[:, f]
        sums[:, f] = np.bincount(key, g, nodes * width).reshape(nodes, width)
        counts[:, f] = np.bincount(key, minlength=nodes * width).reshape(nodes, width)
    return sums, counts


def fit_batch(bins: np.ndarray, y: np.ndarray, model: np.ndarray, exponents: np.ndarray, settings: Settings) -> list[tuple[float, list[Tree]]]:
    """The first value and the trees of each model. Rows come by model; bins are numbers below 256."""
    models = len(exponents)
    scale = np.ldexp(1.0, exponents)
    size = np.bincount(model, minlength=models)
    units = np.rint(y * scale[model])
    base = np.bincount(model, units, models) / np.maximum(size, 1) / scale
    width = int(bins.max(initial=0)) + 1
    now, trees = base[model], [[] for _ in range(models)]
    most = max(1, settings.cells // max(1, bins.shape[1] * width))
    for _ in range(settings.rounds):
        g = np.rint((y - now) * scale[model])
        growth = [_Growth(settings.leaves) for _ in range(models)]
        for m, (s, k) in enumerate(zip(np.bincount(model, g, models).tolist(), size.tolist())):
            growth[m].root(int(s), k)
        node = np.zeros(len(y), np.int64)  # within the model
        known: dict[tuple[int, int], tuple] = {}  # histograms of nodes whose children can still be searched
        ask = [(m, 0) for m in range(models)]
        rows = np.arange(len(y))
        _search(bins, g, model, node, rows, ask, known, growth, width, settings, most)
        order: list[list[int]] = [[] for _ in range(models)]
        live, moved = list(range(models)), set()
        while live:
            ask, parents, still = [], [], []
            for m in live:
                order[m], fresh = growth[m].wave()
                if fresh:
                    still.append(m)
                parents += [(m, p) for p in fresh]
            if not parents:
                break
            rows = _descend(bins, model, node, growth, parents, models)
            moved.update(parents)
            for m, p in parents:  # search the smaller child, the other one is the rest
                low = growth[m].left[p]
                ask.append((m, low if growth[m].total[low][1] <= growth[m].total[low + 1][1] else low + 1))
            _search(bins, g, model, node, rows, ask, known, growth, width, settings, most, parents)
            live = still
        last = [(m, p) for m in range(models) for p in order[m] if (m, p) not in moved]
        if last:  # children that were not searched
            _descend(bins, model, node, growth, last, models)
        values = np.zeros((models, max(len(g.total) for g in growth)))
        for m in range(models):
            tree, own = growth[m].settled(order[m], 1 / scale[m], settings.step, settings.l2)
            trees[m].append(tree)
            values[m, : len(own)] = own
        now += values.ravel()[_place(model, node, values.shape[1], models)]
    return list(zip(base.tolist(), trees))


def _place(model, node, width: int, models: int) -> np.ndarray:
    """Where a row's node stands in a flat table of ``width`` nodes a model."""
    return node if models == 1 else model * width + node


def _descend(bins, model, node, growth, parents, models: int) -> np.ndarray:
    """Move the rows of the nodes split now to their children; which rows moved."""
    most = max(p for _, p in parents) + 1
    # The last column is for all other nodes.
    left, feature, cut = (np.full((models, most + 1), -1, np.int32) for _ in range(3))
    for m, p in parents:
        _, feature[m, p], cut[m, p], _, _ = growth[m].split[p]
        left[m, p] = growth[m].left[p]
    place = _place(model, np.minimum(node, most), most + 1, models)
    low = left.ravel()[place]
    rows = np.flatnonzero(low >= 0)
    place = place[rows]
    beyond = bins.ravel()[rows * bins.shape[1] + feature.ravel()[place]] > cut.ravel()[place]
    node[rows] = low[rows] + beyond
    return rows


def _search(bins, g, model, node, rows, ask, known, growth, width, settings, most, parents=None) -> None:
    """Find the best splits of the nodes asked for and of their siblings, whose histograms are the parents' rest."""
    for low in range(0, len(ask), most):
        part = ask[low : low + most]
        number = {a: i for i, a in enumerate(part)}
        deepest = max(v for _, v in part) + 1
        table = np.full((len(growth), deepest + 1), -1, np.int32)
        for (m, v), i in number.items():
            table[m, v] = i
        slot = table.ravel()[_place(model[rows], np.minimum(node[rows], deepest), deepest + 1, len(growth))]
        asked = np.flatnonzero(slot >= 0)
        chosen = rows[asked]
        sums, counts = _histograms(bins[chosen], slot[asked].astype(np.int64), g[chosen], len(part), width)
        keys = list(part)
        if parents is not None:
            above = [known.pop(p) for p in parents[low : low + most]]
            sums = np.concatenate([sums, np.stack([s for s, _ in above]) - sums])
            counts = np.concatenate([counts, np.stack([n for _, n in above]) - counts])
            for (m, p), (_, v) in zip(parents[low : low + most], part):
                first = growth[m].left[p]
                keys.append((m, 2 * first + 1 - v))
        for (m, v), s, n, split in zip(keys, sums, counts, best_splits(sums, counts, settings.l2, settings.least)):
            growth[m].split[v] = split
            if split is not None:
                known[m, v] = (s, n)


def fit_part(
    bins: np.ndarray, y: np.ndarray, base: float, exponent: int, width: int, settings: Settings, added: Callable[..., list[np.ndarray]]
) -> list[Tree]:
    """The trees of one model, some of whose rows are here: bins (feature, row) and targets.

    ``added`` gives the sums of arrays over all tasks. Splits follow from sums alone, so all tasks grow the same trees.
    The rows of a node are a stretch of one list of rows.
    """
    scale, count, trees = np.ldexp(1.0, exponent), len(bins), []
    now, every = np.full(len(y), base), np.arange(len(y))
    sizes = np.array([np.bincount(b, minlength=width) for b in bins])  # of all rows, the same in every round
    for _ in range(settings.rounds):
        g = np.rint((y - now) * scale)
        growth, rows, span, known = _Growth(settings.leaves), every.copy(), {0: (0, len(y))}, {}

        def searched(nodes: list[int], sums: np.ndarray, counts: np.ndarray) -> None:
            for v, s, n, split in zip(nodes, sums, counts, best_splits(sums, counts, settings.l2, settings.least)):
                growth.split[v] = split
                if split is not None:
                    known[v] = s, n

        def descend(p: int) -> None:
            (low, high), (_, f, cut, _, _) = span.pop(p), growth.split[p]
            own = rows[low:high]
            beyond = bins[f].take(own) > cut
            left, right = (own.take(np.flatnonzero(side)) for side in (~beyond, beyond))
            middle = low + len(left)
            rows[low:middle], rows[middle:high] = left, right
            span[growth.left[p]], span[growth.left[p] + 1] = (low, middle), (middle, high)

        sums, counts = added(np.array([[np.bincount(b, g, width) for b in bins]], float), sizes[None])
        growth.root(int(sums[0, 0].sum()), int(counts[0, 0].sum()))
        searched([0], sums, counts)
        while True:
            order, fresh = growth.wave()
            if not fresh:
                break
            ask = []
            for p in fresh:  # search the smaller child, the other one is the rest
                descend(p)
                low = growth.left[p]
                ask.append(low if growth.total[low][1] <= growth.total[low + 1][1] else low + 1)
            sums, counts = np.zeros((len(ask), count, width)), np.zeros((len(ask), count, width), np.int64)
            for i, v in enumerate(ask):
                own = rows[slice(*span[v])]
                units = g.take(own)
                for f in range(count):
                    key = bins[f].take(own).astype(np.intp)
                    sums[i, f] = np.bincount(key, units, width)
                    counts[i, f] = np.bincount(key, minlength=width)
            sums, counts = added(sums, counts)
            above = [known.pop(p) for p in fresh]
            rest = [2 * growth.left[p] + 1 - v for p, v in zip(fresh, ask)]
            searched(ask, sums, counts)
            searched(rest, np.stack([s for s, _ in above]) - sums, np.stack([n for _, n in above]) - counts)
        for p in order:
            if p in span:  # children that were not searched
                descend(p)
        tree, values = growth.settled(order, 1 / scale, settings.step, settings.l2)
        trees.append(tree)
        for v, (low, high) in span.items():
            now[rows[low:high]] += values[v]
    return trees


def predict(bins: np.ndarray, base: float | np.ndarray, trees: list[Tree]) -> np.ndarray:
    out = np.full(len(bins), base)
    for tree in trees:
        out += tree.apply(bins)
    return out


# Spark


def facts(split: DataFrame, key: Column, features: Sequence[str], target: str, is_test: str, bins: int) -> DataFrame:
    """One row a key: training rows, the greatest training target, and each feature's cut points (observed quantiles)."""
    shares = [i / bins for i in range(1, bins)]
    trains = ~F.col(is_test) & F.col(target).isNotNull()

    def cuts(feature: str) -> Column:
        found = F.percentile_approx(F.when(trains, F.col(f"`{feature}`").cast("double")), shares, ACCURACY)
        return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<double>"))))

    return split.groupBy(key.alias("_key")).agg(
        F.count_if(trains).alias("_n"), F.max(F.when(trains, F.abs(target))).cast("double").alias("_greatest"),
        F.array(*map(cuts, features)).alias("_cuts"),
    )


def binned(values: np.ndarray, cuts: list) -> np.ndarray:
    """Bin numbers: how many cut points a value passes; a missing value is in the first bin."""
    out = np.empty(values.shape, np.uint8)
    for f, edges in enumerate(cuts):
        column = values[:, f]
        out[:, f] = np.where(np.isnan(column), 0, np.searchsorted(np.asarray(edges, float), column, "left"))
    return out


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    columns = [batch.column(batch.schema.get_field_index(n)).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]
    return np.column_stack(columns) if columns else np.zeros((batch.num_rows, 0))


def predictions(
    split: DataFrame, key: Column, features: Sequence[str], target: str, is_test: str, prediction: str, settings: Settings = Settings()
) -> DataFrame:
    """The test rows with what their key's model, fitted on the key's other rows, predicts.

    ``split`` must be stored, as it is read several times. Rows of a key without training rows get NULL; a row with
    a null target does not train. Features are numbers; a missing one lies in the lowest bin, so fill them first.
    """
    known, rows, large = _prepared(split, key, features, target, is_test, settings)
    small = rows.where("_parts = 1")
    out = _small(small, known.where(F.col("_n") <= settings.own_task), features, target, is_test, prediction, settings)
    if not large:
        return out
    rest = rows.where("_parts > 1")
    return out.unionByName(_large(rest, known.where(F.col("_n") > settings.own_task), features, target, is_test, prediction, settings))


def models(split: DataFrame, key: Column, features: Sequence[str], target: str, is_test: str, settings: Settings = Settings()) -> DataFrame:
    """(_key, model) of each key with training rows; the model as JSON for ``from_json``."""
    known, rows, large = _prepared(split, key, features, target, is_test, settings)
    small = known.where((F.col("_n") <= settings.own_task) & (F.col("_n") > 0))
    out = _small(rows.where("_parts = 1"), small, features, target, is_test, None, settings)
    if not large:
        return out
    rest = known.where(F.col("_n") > settings.own_task)
    base, trees = fit_spread(rows.where("_parts > 1"), rest, features, target, is_test, settings)

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [to_json(base[k], trees[k], [list(c) for c in cuts]) for k, cuts in zip(frame["_key"], frame["_cuts"])]
            yield pd.DataFrame({"_key": frame["_key"], "model": made})

    return out.unionByName(rest.select("_key", "_cuts").mapInPandas(told, out.schema))


def _prepared(split, key, features, target, is_test, settings) -> tuple[DataFrame, DataFrame, bool]:
    """The facts of all keys, the rows with their key and in how many parts its rows are dealt, and whether any is in several."""
    known = stored(facts(split, key, features, target, is_test, settings.bins))
    parts = (F.floor(F.col("_n") / settings.own_task) + 1).cast("int")
    large = known.where(F.col("_n") > settings.own_task).select("_key", parts.alias("_parts")).collect()
    rows = split.withColumn("_key", key)
    if not large:
        return known, rows.withColumn("_parts", F.lit(1)), False
    # One row for each own_task training rows at most.
    dealt = split.sparkSession.createDataFrame(large, T.StructType([rows.schema["_key"], T.StructField("_parts", T.IntegerType())]))
    dealt = F.broadcast(dealt.withColumnRenamed("_key", "_k"))
    rows = rows.join(dealt, F.col("_key").eqNullSafe(F.col("_k")), "left").drop("_k")
    return known, rows.withColumn("_parts", F.coalesce("_parts", F.lit(1))), True


def _with_facts(rows: DataFrame, known: DataFrame, settings: Settings) -> DataFrame:
    """Rows and, before those of each key and part, the key's facts."""
    columns = [F.col(f"`{c}`") for c in rows.columns if c != "_parts"]
    inner = rows.withColumn("_part", F.pmod(F.xxhash64(*columns), F.col("_parts")).cast("int")).drop("_parts")
    several = F.floor(F.col("_n") / settings.own_task).cast("int")
    ahead = known.withColumn("_part", F.explode(F.sequence(F.lit(0), several)))
    both = ahead.withColumn("_kind", F.lit(0)).unionByName(inner.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_kind")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[pa.RecordBatch]]]:
    """(facts, rows) of each key and part in turn, from batches sorted so that the facts come first."""
    current, rows = None, []
    for batch in batches:
        kind = batch.column(batch.schema.get_field_index("_kind")).to_numpy()
        at = 0
        for first in [*np.flatnonzero(kind == 0).tolist(), batch.num_rows]:
            if first > at and current is not None:
                rows.append(batch.slice(at, first - at))
            if first < batch.num_rows:
                if current is not None:
                    yield current, rows
                fact = batch.slice(first, 1).select(["_key", "_n", "_greatest", "_cuts"])
                current, rows = fact.to_pylist()[0], []
            at = first + 1
    if current is not None:
        yield current, rows


def _outcome(rows: DataFrame, prediction: str) -> tuple[list[str], T.StructType]:
    kept = [n for n in rows.columns if n not in ("_key", "_parts")]
    return kept, T.StructType([*(rows.schema[n] for n in kept), T.StructField(prediction, T.DoubleType())])


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _small(rows, known, features, target, is_test, prediction: str | None, settings) -> DataFrame:
    """Predictions of the test rows, or the models if ``prediction`` is None, many keys at a time in a task."""
    both = _with_facts(rows, known, settings)
    if prediction is None:
        kept, schema = [], T.StructType([rows.schema["_key"], T.StructField("model", T.StringType())])
    else:
        kept, schema = _outcome(rows, prediction)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for fact, own in _runs(parts):
            if own:
                held.append((fact, pa.Table.from_batches(own).combine_chunks().to_batches()[0]))
                size += max(fact["_n"], len(features) * (1 + max(map(len, fact["_cuts"]))))
            if size >= settings.own_task // 4:
                yield from fitted(held)
                held, size = [], 0
        if held:
            yield from fitted(held)

    def fitted(held: list) -> Iterator[pa.RecordBatch]:
        bins, y, model, tests = [], [], [], []
        for m, (fact, batch) in enumerate(held):
            x = binned(_matrix(batch, features), fact["_cuts"])
            wanted = _matrix(batch, [target])[:, 0]
            test = np.asarray(_column(batch, is_test).to_numpy(zero_copy_only=False), bool)
            train = ~test & ~np.isnan(wanted)
            bins.append(x[train])
            y.append(wanted[train])
            model.append(np.full(int(train.sum()), m))
            tests.append((batch.filter(pa.array(test)), x[test]))
        exponents = np.array([unit_exponent(f["_greatest"] or 0.0) for f, _ in held])
        made = fit_batch(np.concatenate(bins), np.concatenate(y), np.concatenate(model), exponents, settings)
        for (fact, whole), (batch, x), (base, trees) in zip(held, tests, made):
            if prediction is None:
                text = pa.array([to_json(base, trees, fact["_cuts"])])
                yield pa.RecordBatch.from_arrays([_column(whole, "_key").slice(0, 1), text], names=["_key", "model"])
            elif batch.num_rows:
                value = predict(x, base, trees) if fact["_n"] else np.full(len(x), np.nan)
                columns = [_column(batch, n) for n in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(value, from_pandas=True)], names=[*kept, prediction])

    return both.mapInArrow(batches, schema)


def _large(rows, known, features, target, is_test, prediction, settings) -> DataFrame:
    """Predictions of the test rows of keys of many rows."""
    base, trees = fit_spread(rows, known, features, target, is_test, settings)
    kept, schema = _outcome(rows, prediction)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fact, own in _runs(parts):
            for batch in own:
                x = binned(_matrix(batch, features), fact["_cuts"])
                made = predict(x, base[fact["_key"]], trees[fact["_key"]])
                yield pa.RecordBatch.from_arrays([*(_column(batch, n) for n in kept), pa.array(made)], names=[*kept, prediction])

    return _with_facts(rows.where(is_test), known, settings).mapInArrow(batches, schema)


def fit_spread(rows, known, features, target, is_test, settings: Settings, keep: int = 8) -> tuple[dict, dict[object, list[Tree]]]:
    """First values and trees of keys with many rows: by tasks side by side, else each wave of all keys is one Spark job.

    The driver holds the trees and, with jobs, a few numbers for each node. Every ``keep`` rounds the rows are stored with
    their predictions so far, so that a job applies only the trees since then.
    """
    train = rows.where(~F.col(is_test) & F.col(target).isNotNull()).select("_key", *dict.fromkeys([target, *features]))
    key_type = rows.schema["_key"].dataType.simpleString()
    told = known.select("_key", "_greatest", "_cuts").collect()  # of keys with many rows, each with fewer numbers than its trees
    exponent = {r["_key"]: unit_exponent(r["_greatest"] or 0.0) for r in told}
    cuts = {r["_key"]: r["_cuts"] for r in told}

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            codes = _column(batch, "_key").dictionary_encode(null_encoding="encode")
            for code, key in enumerate(codes.dictionary.to_pylist()):
                own = batch if len(codes.dictionary) == 1 else batch.filter(pa.array(codes.indices.to_numpy() == code))
                x = binned(_matrix(own, features), cuts[key])
                y = _matrix(own, [target])[:, 0]
                for low in range(0, len(y), 4096):
                    part = slice(low, low + 4096)
                    yield pa.RecordBatch.from_pydict({
                        "_key": pa.array([key], batch.schema.field("_key").type),
                        "bins": pa.array([x[part].tobytes()], pa.binary()),
                        "y": pa.array([y[part].tobytes()], pa.binary()),
                        "now": pa.array([np.zeros(len(y[part])).tobytes()], pa.binary()),
                        "units": [int(np.rint(y[part] * np.ldexp(1.0, exponent[key])).sum())],
                        "n": [len(y[part])],
                    })

    schema = f"_key {key_type}, bins binary, y binary, now binary, units long, n long"
    work = stored(train.mapInArrow(packed, schema))
    totals = {r["_key"]: (int(r["s"]), int(r["n"])) for r in work.groupBy("_key").agg(F.sum("units").alias("s"), F.sum("n").alias("n")).collect()}
    base = {k: s / n / np.ldexp(1.0, exponent[k]) for k, (s, n) in totals.items()}
    tasks = _tasks_at_once(rows.sparkSession)
    if tasks and sum(n for _, n in totals.values()) <= tasks * settings.held:
        return base, _fit_side_by_side(work, tasks, base, exponent, len(features), settings)
    trees: dict[object, list[Tree]] = {k: [] for k in base}
    width, count, since = settings.bins, len(features), 0

    def blocks(parts: Iterator[pa.RecordBatch], past: dict, fresh: bool) -> Iterator[tuple]:
        for batch in parts:
            for row in range(batch.num_rows):
                k = batch.column(0)[row].as_py()
                bins = np.frombuffer(batch.column(1)[row].as_py(), np.uint8).reshape(-1, count)
                y, now = (np.frombuffer(batch.column(i)[row].as_py()) for i in (2, 3))
                yield k, bins, y, predict(bins, base[k] if fresh else now, past[k]), batch.schema.field(0).type

    def stored_now(work: DataFrame, past: dict, fresh: bool) -> DataFrame:
        def moved(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, bins, y, now, kind in blocks(parts, past, fresh):
                yield pa.RecordBatch.from_pydict({
                    "_key": pa.array([k], kind), "bins": [bins.tobytes()], "y": [y.tobytes()], "now": [now.tobytes()],
                })

        return stored(work.select("_key", "bins", "y", "now").mapInArrow(moved, f"_key {key_type}, bins binary, y binary, now binary"))

    for turn in range(settings.rounds):
        past = {k: t[since:] for k, t in trees.items()}
        if turn - since >= keep:
            work, since = stored_now(work, past, since == 0), turn
            past = {k: [] for k in trees}
        growth = {k: _Growth(settings.leaves) for k in base}
        asked = {k: [0] for k in base}
        order: dict[object, list[int]] = {k: [] for k in base}
        first = True
        while asked:
            found = _searched(work, lambda parts: blocks(parts, past, since == 0), exponent, growth, asked, settings, width, count, key_type)
            for (k, v), (split, total, n) in found.items():
                if first:
                    growth[k].root(total, n)
                growth[k].split[v] = split
            first, after = False, {}
            for k in asked:
                order[k], fresh = growth[k].wave()
                if fresh:
                    after[k] = [c for p in fresh for c in (growth[k].left[p], growth[k].left[p] + 1)]
            asked = after
        for k in base:
            trees[k].append(growth[k].tree(order[k], 1 / np.ldexp(1.0, exponent[k]), settings.step, settings.l2))
    return base, trees


def _tasks_at_once(spark: SparkSession) -> int:
    """How many tasks a barrier stage may have; none if executors come and go or tasks cannot open the shared folder."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    try:
        place(fresh_folder(spark))
    except (pa.ArrowException, OSError):
        return 0
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


class _Tasks:
    """The tasks of a barrier stage as seen by one of them: each writes its arrays to a file and reads those of the others.

    A file is whole when it has the length of one's own. Who has read the files of a turn knows that all have read those
    of the turn before, so each task has two files at most.
    """

    def __init__(self, folder: str):
        context = BarrierTaskContext.get()
        self.number = context.partitionId()
        # The numbers of this attempt's tasks: a stage that is tried again reads no old file.
        attempts = context.allGather(str(context.taskAttemptId()))
        self.system, path = place(folder)
        self.folder, self.count, self.turn = f"{path}/{min(map(int, attempts))}", len(attempts), 0
        self.system.create_dir(self.folder)

    def path(self, task: int, turn: int) -> str:
        return f"{self.folder}/{turn}-{task}"

    def read(self, task: int, length: int) -> bytes:
        path, pause = self.path(task, self.turn), 0.0005
        while self.system.get_file_info(path).size != length:
            time.sleep(pause)
            pause = min(0.02, 1.2 * pause)
        with self.system.open_input_file(path) as file:
            return file.read()

    def added(self, sums: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """The sums over all tasks of whole numbers."""
        counts = counts.astype(np.int32)  # of the rows here
        told = sums.tobytes() + counts.tobytes()
        with self.system.open_output_stream(self.path(self.number, self.turn)) as file:
            file.write(told)
        out = [sums.copy(), counts.astype(np.float64)]
        for task in range(self.count):
            if task != self.number:
                other = self.read(task, len(told))
                out[0] += np.frombuffer(other, np.float64, sums.size).reshape(sums.shape)
                out[1] += np.frombuffer(other, np.int32, counts.size, sums.nbytes).reshape(counts.shape)
        if self.turn:
            self.system.delete_file(self.path(self.number, self.turn - 1))
        self.turn += 1
        return out


def _fit_side_by_side(work, tasks: int, base: dict, exponent: dict, count: int, settings: Settings) -> dict[object, list[Tree]]:
    """Trees of keys with many rows, one key after the other, by tasks that hold their blocks of rows for all rounds."""
    folder, keys = fresh_folder(work.sparkSession), list(base)

    def grown(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {k: ([np.zeros((count, 0), np.uint8)], [np.zeros(0)]) for k in keys}
        for batch in parts:
            for key, bins, y in zip(*(batch.column(i) for i in range(3))):
                bins_of, y_of = held[key.as_py()]
                bins_of.append(np.frombuffer(bins.as_py(), np.uint8).reshape(-1, count).T)
                y_of.append(np.frombuffer(y.as_py()))
        others = _Tasks(folder)
        for i, k in enumerate(keys):
            bins, y = (np.concatenate(x, axis=-1) for x in held.pop(k))
            trees = fit_part(np.ascontiguousarray(bins), y, base[k], exponent[k], settings.bins, settings, others.added)
            if others.number == 0:
                yield pa.RecordBatch.from_pydict({"key": [i], "trees": [to_json(base[k], trees, [])]})

    blocks = work.select("_key", "bins", "y").repartition(tasks)
    found = blocks.mapInArrow(grown, "key long, trees string", barrier=True).collect()
    return {keys[r["key"]]: from_json(r["trees"])[1] for r in found}


def _searched(work, blocks, exponent, growth, asked, settings, width, count, key_type) -> dict:
    """The best split, sum and rows of each node asked for."""
    steps = {k: {p: (*growth[k].split[p][1:3], left) for p, left in growth[k].left.items()} for k in asked}
    slots = {k: {v: i for i, v in enumerate(nodes)} for k, nodes in asked.items()}

    def added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for k, bins, y, now, kind in blocks(parts):
            if k not in slots:
                continue
            node = np.zeros(len(y), np.int64)
            for p, (f, cut, left) in steps[k].items():  # parents come before their children
                at = np.flatnonzero(node == p)
                node[at] = left + (bins[at, f] > cut)
            slot = np.full(max([*slots[k], int(node.max())]) + 1, -1)
            for v, i in slots[k].items():
                slot[v] = i
            slot = slot[node]
            inside = slot >= 0
            g = np.rint((y - now) * np.ldexp(1.0, exponent[k]))
            sums, counts = _histograms(bins[inside], slot[inside], g[inside], len(slots[k]), width)
            if k in held:
                held[k][0][:] += sums.astype(np.int64)
                held[k][1][:] += counts.astype(np.int64)
            else:
                held[k] = sums.astype(np.int64), counts.astype(np.int64)
            if len(held) * len(slots[k]) * count * width > settings.cells:
                yield from told(held, kind)
                held = {}
        yield from told(held, kind)

    def told(held: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for k, (sums, counts) in held.items():
            nodes = [v for v in slots[k] for _ in range(count)]
            yield pa.RecordBatch.from_pydict({
                "_key": pa.array([k] * len(nodes), kind),
                "node": pa.array(nodes, pa.int64()),
                "feature": pa.array(list(range(count)) * len(slots[k]), pa.int64()),
                "g": pa.array([x.tobytes() for x in sums.reshape(-1, width)], pa.binary()),
                "n": pa.array([x.tobytes() for x in counts.reshape(-1, width)], pa.binary()),
            })

    def best(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, g, n = None, None, None
        for frame in rows:
            out = []
            for k, node, feature, sums, counts in frame.itertuples(index=False):
                if (k, node, feature) != current:
                    if current is not None:
                        out.append(judged(current, g, n))
                    current, g, n = (k, node, feature), np.zeros(width, np.int64), np.zeros(width, np.int64)
                g += np.frombuffer(sums, np.int64)
                n += np.frombuffer(counts, np.int64)
            yield pd.DataFrame(out, columns=columns)
        if current is not None:
            yield pd.DataFrame([judged(current, g, n)], columns=columns)

    columns = ["_key", "node", "feature", "gain", "bin", "s", "k", "total", "rows"]

    def judged(at: tuple, g: np.ndarray, n: np.ndarray) -> tuple:
        split = best_splits(g[None, None].astype(float), n[None, None].astype(float), settings.l2, settings.least)[0]
        gain, _, cut, s, k = split or (0.0, 0, 0, 0, 0)
        return (*at, gain, cut, s, k, int(g.sum()), int(n.sum()))

    sums = work.select("_key", "bins", "y", "now").mapInArrow(added, f"_key {key_type}, node long, feature long, g binary, n binary")
    by = ["_key", "node", "feature"]
    each = sums.repartition(*by).sortWithinPartitions(*by).mapInPandas(
        best, f"_key {key_type}, node long, feature long, gain double, bin long, s long, k long, total long, rows long"
    )
    first = F.max(F.struct("gain", (-F.col("feature")).alias("f"), "bin", "s", "k", "total", "rows")).alias("x")
    found = {}
    for r in each.groupBy("_key", "node").agg(first).collect():
        x = r["x"]
        split = (x["gain"], -x["f"], x["bin"], x["s"], x["k"]) if x["gain"] > 0 else None
        found[r["_key"], r["node"]] = split, x["total"], x["rows"]
    return found


def to_json(base: float, trees: list[Tree], cuts: list) -> str:
    return json.dumps({"base": base, "cuts": cuts, "trees": [[t.feature, t.bin, t.left, t.value] for t in trees]})


def from_json(text: str) -> tuple[float, list[Tree], list]:
    data = json.loads(text)
    return data["base"], [Tree(*t) for t in data["trees"]], data["cuts"]
