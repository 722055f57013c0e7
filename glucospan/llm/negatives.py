"""Hard negatives by pruning on lengths and coordinates.

The vectors of a label are put in order of length and cut into buckets of about equal length, and the
buckets into tiles, one task's work. An inner product of at least t with an anchor needs a cosine of at least
t / (length of the anchor * greatest length of the bucket). Above 1 the bucket is out. Otherwise the cosine
bounds each coordinate of the vector's direction: the few coordinates on which the anchor is greatest (its focus)
give ranges in the bucket's sorted coordinate lists, and only what lies in all of them is multiplied out exactly.

The bound t rises while a tile is worked on: it is the k-th best score so far. Before the other tiles are read, an
anchor's bounds come from the tile of longest vectors of each label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glucospan.llm import vectors
from glucospan.llm.topk import _products
from glucospan.storage import stored

SALTS = 16
#: Scaled components are held within this; scores within a long.
HELD = 2.0**53
#: The ends of a long.
LOWEST, GREATEST = -(2**63), 2**63 - 1


def _sized(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, label, v, asked) with the vectors' lengths."""
    for part in incoming:
        length = np.linalg.norm(vectors.matrix(part.column(2)), axis=1) if part.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(length)], names=[*part.schema.names, "length"])


def _cut(bucket: int, least: int, ratio: float, tile: int):
    """Number buckets and tiles of rows (c, label, v, length) that come by label and falling length. Small labels
    share buckets."""

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_tile = at_bucket = TaskContext.get().partitionId() << 32
        before, longest, rows, held = None, 0.0, 0, 0
        for part in incoming:
            tiles, buckets = [], []
            for label, length in zip(part.column(1).to_pylist(), part.column(3).to_pylist()):
                if rows >= bucket or rows >= least and (label != before or length < ratio * longest):
                    at_bucket, longest, rows = at_bucket + 1, 0.0, 0
                    if held >= tile:
                        at_tile, held = at_tile + 1, 0
                before, longest, rows, held = label, max(longest, length), rows + 1, held + 1
                tiles.append(at_tile)
                buckets.append(at_bucket)
            made = [pa.array(x, pa.int64()) for x in (tiles, buckets)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "tile", "bucket"])

    return batches


class _Bucket:
    """Vectors of about one length with sorted lists of their directions' coordinates, made as they are used."""

    def __init__(self, v: np.ndarray, length: np.ndarray, c: np.ndarray, label: np.ndarray):
        self.v, self.c, self.label, self.longest = v, c, label, float(length.max())
        self.unit = v / np.where(length > 0, length, 1.0)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The coordinate's rising values and whose they are."""
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = self.unit[order, f], order
        return self.lists[f]

    def candidates(self, unit: np.ndarray, cosine: float, focus: int) -> np.ndarray | None:
        """Those that can have the cosine with a direction; None if the lists cannot rule out half of them."""
        if cosine <= -1:
            return None
        angle = np.arccos(min(1.0, cosine)) + 1e-7
        ranges = []
        for f in np.argpartition(-np.abs(unit), min(focus, len(unit)) - 1)[:focus]:
            own = np.arccos(np.clip(unit[f], -1, 1))
            values, order = self.list(int(f))
            low = np.searchsorted(values, np.cos(min(np.pi, own + angle)) - 1e-9)
            high = np.searchsorted(values, np.cos(max(0.0, own - angle)) + 1e-9, "right")
            ranges.append((high - low, low, high, order))
        ranges.sort(key=lambda r: r[0])
        if not ranges or ranges[0][0] * 2 > len(self.v):
            return None
        inside = np.zeros(len(self.v), np.uint8)
        for _, low, high, order in ranges:
            inside[order[low:high]] += 1
        _, low, high, order = ranges[0]
        some = order[low:high]
        return some[inside[some] == len(ranges)]


def _best(s: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the allowed scores within each row's bounds that are among its ``most`` greatest, ties included."""
    fits = allowed & (s >= low[:, None]) & (s <= high[:, None])
    if s.shape[1] > most and (crowded := np.flatnonzero(fits.sum(1) > most)).size:
        some = np.where(fits[crowded], s[crowded], LOWEST)
        least = np.partition(some, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
        fits[crowded] &= some >= least[:, None]
    return np.nonzero(fits)


def _scorer(most: int, windows: int, focus: int, same: bool):
    """Score a tile's vectors of the anchors' labels (``same``) or of others. Each of an anchor's ``windows`` has its
    own bounds (least0, most0), ...; a closed one has its greatest below its least. Gives the ``most`` best of each."""

    def score(held, asked):
        if "built" not in held:  # once for a tile, whatever the number of its anchors
            order = np.argsort(held["bucket"], kind="stable")
            cuts = np.flatnonzero(np.diff(held["bucket"][order])) + 1
            buckets = [_Bucket(*(held[x][p] for x in ("v", "length", "c", "label"))) for p in np.split(order, cuts)]
            held["built"] = sorted(buckets, key=lambda b: -b.longest)
        q, norm = asked["v"], np.maximum(asked["length"], 1e-300)
        low = np.stack([asked[f"least{i}"] for i in range(windows)])
        high = np.stack([asked[f"most{i}"] for i in range(windows)])
        opened = low <= high
        found = np.zeros((0, 4), np.int64)  # anchor, window, c, score
        for b in held["built"]:
            need = np.where(opened, low, GREATEST).min(axis=0).astype(float)
            # Of a bound from 0 down nothing follows for shorter vectors.
            cosine = np.where(need > 0, need * (1 - 1e-6) / (norm * max(b.longest, 1e-300)), -np.inf)
            cosine[~opened.any(axis=0)] = np.inf
            whole, parts = [], []
            for i in np.flatnonzero(cosine <= 1):
                some = b.candidates(q[i] / norm[i], float(cosine[i]), focus)
                if some is None:
                    whole.append(i)
                elif len(some):
                    parts.append((np.array([i]), some))
            if whole:
                parts.append((np.array(whole), np.arange(len(b.v))))
            new = []
            for rows, some in parts:
                s = _products(q[rows], b.v[some])
                allowed = (asked["label"][rows, None] == b.label[some]) == same
                for w in range(windows):
                    x, y = _best(s, allowed, low[w, rows], high[w, rows], most)
                    new.append(np.stack([rows[x], np.full(len(x), w), b.c[some[y]], s[x, y]], axis=1))
            if sum(map(len, new)):
                found = np.concatenate([found, *new])
                found = found[_kept(found, most)]
                groups, first, count = np.unique(found[:, 0] * windows + found[:, 1], return_index=True, return_counts=True)
                full = count >= most  # less than the last of these is out, as much can win by its id
                at, bound = groups[full], found[first[full] + most - 1, 3]
                low[at % windows, at // windows] = np.maximum(low[at % windows, at // windows], bound)
        yield asked["c"][found[:, 0]], found[:, 1], found[:, 2], found[:, 3]

    return score


def _kept(found: np.ndarray, most: int) -> np.ndarray:
    """Which of the rows (anchor, window, c, score) are the ``most`` best of theirs, in order."""
    order = np.lexsort((found[:, 2], ~found[:, 3], found[:, 1], found[:, 0]))
    group = found[order, 0] * (1 << 20) + found[order, 1]
    return order[np.arange(len(group)) - np.searchsorted(group, group) < most]


class _Index:
    """Tiles of classes of equal (vector, label), and the classes that ask."""

    def __init__(self, found: DataFrame, cut: tuple[int, int, float, int], focus: int, asking: int):
        sized = found.select("c", "label", "v", "asked").mapInArrow(_sized, "c long, label long, v binary, asked boolean, length double")
        order = ["label", F.desc("length"), "c"]
        layout = sized.select("c", "label", "v", "length").repartitionByRange(*order).sortWithinPartitions(*order)
        self.rows = stored(layout.mapInArrow(_cut(*cut), "c long, label long, v binary, length double, tile long, bucket long"))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        labels = self.rows.groupBy("tile", "label").agg(F.max("length").alias("longest"))
        leading = Window.partitionBy("label").orderBy(F.desc("longest"), "tile")
        labels = stored(labels.withColumn("leads", F.row_number().over(leading) == 1))
        self.labels = labels.withColumn("salt", salts)
        tiles = labels.groupBy("tile").agg(
            F.max("longest").alias("longest"), F.max("leads").alias("leads"), F.min("label").alias("low"), F.max("label").alias("high")
        )
        self.tiles = stored(tiles).withColumn("salt", salts)
        self.asked = stored(sized.filter("asked").drop("asked").withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int")))
        self.focus = focus
        #: Groups of anchors; a tile is read once for each, so that no task gets more than about ``asking`` anchors.
        self.groups = max(1, -(-self.asked.count() // asking))

    def search(self, pairs: DataFrame, windows: int, most: int, same: bool) -> DataFrame:
        """(q, w, c, score) for pairs (q, tile, least0, most0, ...)."""
        bounds = [f"{x}{i}" for i in range(windows) for x in ("least", "most")]
        zero, group = F.lit(0).cast("long"), F.pmod(F.xxhash64("c", F.lit(1)), F.lit(self.groups))
        columns = ["c", "label", "v", "length", "bucket", *bounds]
        every = F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1)))
        own = self.rows.withColumns({n: zero for n in bounds}).withColumn("_g", every)
        asked = self.asked.drop("salt").withColumn("bucket", zero).withColumn("_g", group)
        asked = asked.join(pairs.withColumnRenamed("q", "c"), "c")
        own, asked = (
            x.select((F.col("tile") * self.groups + F.col("_g")).alias("block"), F.lit(asks).alias("asks"), *columns)
            for x, asks in ((own, False), (asked, True))
        )
        score = _scorer(most, windows, self.focus, same)
        return vectors.against_blocks(own.unionByName(asked), score, "q long, w long, c long, score long")


def _bounds(hits: DataFrame, by: list[str], most: int) -> DataFrame:
    """(by..., bound): the least of the ``most`` best scores where there are so many."""
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "c"))
    best = hits.withColumn("_r", best).filter(F.col("_r") <= most)
    found = best.groupBy(*by).agg(F.count("*").alias("_n"), F.min("score").alias("bound"))
    return found.filter(F.col("_n") == most).drop("_n")


def _members(hits: DataFrame, found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The ``most`` best rows of the classes hit: (by..., id, score, place from 1); ties go to the smaller id."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "c"))
    near = hits.withColumn("place", place).filter(F.col("place") <= most).select(*by, "c", "score")
    near = near.join(found.select("c", "ids"), "c").select(*by, "score", F.explode(F.slice("ids", 1, most)).alias("id"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return near.withColumn("place", place).filter(F.col("place") <= most)


def hard_negatives(
    df: DataFrame, key: str, vector: str, label: str, is_anchor: Column, positives: int = 5, most: int = 5,
    scale: int = 256, share: tuple[int, int] = (4, 5), focus: int = 4, bucket: int = 2048, least: int = 256,
    ratio: float = 0.95, tile: int = 32768, asking: int = 32768,
) -> DataFrame:
    """For each anchor (``is_anchor``, over the column ``id``) and each of its positives its hardest negatives.

    A component x counts as floor(scale * x), a score is the integer inner product with the anchor, higher first,
    ties by the smaller id. Positives are the ``positives`` first rows of the anchor's label with another id.
    Negatives are the ``most`` first rows of other labels whose score lies between ``share`` of the positive's
    and the positive's own; a negative positive score has none. Columns anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score. Exact, whatever the buckets.

    Rows with a null id, label or vector, or with null or non-finite components, take no part. Shorter
    vectors are filled up with zeros. Equal rows count once; an id with several vectors or labels
    counts as several rows. Vectors that many rows of a label share stand in the index once. Scaled components
    are held within 2**53, scores within a long. Other columns are left alone, whatever their names.
    """
    width, wanted = vectors.longest(df, vector), positives + 1
    named = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v"), F.col(f"`{label}`").cast("long").alias("label"))
    named = named.filter(F.col("label").isNotNull())
    rows = vectors.packed(named, "id", "v", lambda v: np.clip(np.floor(scale * v), -HELD, HELD), width, zero=True, also=("label",))
    rows = stored(rows.dropDuplicates(["id", "label", "v"]))
    rank = F.row_number().over(Window.partitionBy("v", "label").orderBy("id"))
    first = rows.withColumn("_r", rank).filter(F.col("_r") <= max(wanted, most))
    classes = first.groupBy("v", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    anchors = rows.filter(is_anchor)
    asked = anchors.select("v", "label").distinct().withColumn("asked", F.lit(True))
    classes = classes.join(asked, ["v", "label"], "left").fillna(False, "asked")
    # Numbers of classes rise with their least ids, so that ties between classes follow the ids.
    ordered = classes.repartitionByRange(F.col("ids")[0], "label", "v").sortWithinPartitions(F.col("ids")[0], "label", "v")
    found = stored(ordered.withColumn("c", F.monotonically_increasing_id()))
    anchors = stored(anchors.join(found.filter("asked").select("v", "label", F.col("c").alias("q")), ["v", "label"]).select("id", "q"))
    index = _Index(found, (bucket, least, ratio, tile), focus, asking)
    asked = index.asked.select(F.col("c").alias("q"), "label", "length", "salt")

    # Rows of the anchors' labels: first the longest of the label, then all tiles that can still hold better ones.
    open_ = [F.lit(LOWEST).alias("least0"), F.lit(GREATEST).alias("most0")]
    own = asked.join(index.labels, ["label", "salt"])
    begun = stored(index.search(own.filter("leads").select("q", "tile", *open_), 1, wanted, True))
    rest = own.filter(~F.col("leads")).join(_bounds(begun, ["q"], wanted), "q", "left")
    rest = rest.filter(F.col("bound").isNull() | (F.col("longest") * F.col("length") * (1 + 1e-6) >= F.col("bound")))
    rest = rest.select("q", "tile", F.coalesce("bound", F.lit(LOWEST)).alias("least0"), open_[1])
    near = stored(_members(begun.unionByName(index.search(rest, 1, wanted, True)), found, ["q"], wanted).select("q", "id", "score"))

    # A window below each different score that an anchor's positive can have.
    num, den = share
    scores = near.filter("score >= 0").groupBy("q").agg(F.sort_array(F.collect_set("score"), False).alias("tops"))
    scores = scores.withColumn("w", F.expr(f"sequence(0, {wanted - 1})")).select("q", "tops", F.explode("w").alias("w"))
    windows = scores.withColumn("top", F.coalesce(F.expr("get(tops, w)"), F.lit(-1).cast("long"))).drop("tops")
    part = F.expr(f"(top div {den}) * {den - num} + ((top % {den}) * {den - num}) div {den}")
    windows = stored(windows.withColumn("low", F.when(F.col("top") >= 0, F.col("top") - part).otherwise(F.lit(0).cast("long"))))

    def bounded(rows: DataFrame) -> DataFrame:
        """One row an asking class with the bounds of its windows and the least of them."""
        each = [
            F.max(F.when(F.col("w") == i, F.col(c))).alias(f"{name}{i}")
            for i in range(wanted) for name, c in (("least", "low"), ("most", "top"))
        ]
        return rows.groupBy("q").agg(F.min(F.when(F.col("top") >= F.col("low"), F.col("low"))).alias("need"), *each)

    other = asked.join(index.tiles, "salt").filter((F.col("low") != F.col("label")) | (F.col("high") != F.col("label")))
    other = other.select("q", "tile", "leads", (F.col("longest") * F.col("length") * (1 + 1e-6)).alias("reach"))

    def searched(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        able = pairs.join(bounded(rows), "q").filter(F.col("reach") >= F.col("need"))
        return index.search(able.drop("leads", "reach", "need"), wanted, most, False)

    begun = stored(searched(other.filter("leads"), windows))
    raised = windows.join(_bounds(begun, ["q", "w"], most), ["q", "w"], "left")
    raised = raised.withColumn("low", F.greatest("low", F.coalesce("bound", "low"))).drop("bound")
    hits = begun.unionByName(searched(other.filter(~F.col("leads")), raised))
    best = _members(hits, found, ["q", "w"], most).join(windows.select("q", "w", "top"), ["q", "w"])
    lists = best.groupBy("q", "top").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("near"))

    # An anchor's positives are its class's first rows but itself.
    first = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("all"))
    own = F.slice(F.filter("all", lambda x: x["id"] != F.col("anchor_id")), 1, positives)
    pairs = anchors.withColumnRenamed("id", "anchor_id").join(first, "q").select("anchor_id", "q", F.explode(own).alias("x"))
    pairs = pairs.select("anchor_id", "q", F.col("x.id").alias("positive_id"), (-F.col("x.s")).alias("top"))
    return pairs.join(lists, ["q", "top"]).select(
        "anchor_id", "positive_id", F.explode("near").alias("x"), F.col("top").alias("positive_score")
    ).select("anchor_id", "positive_id", F.col("x.place").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))
