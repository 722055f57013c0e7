"""Similarity join of texts by the Jaccard index of their word n-grams.

Equal texts are one class. Classes whose MinHash signatures agree in a whole band are candidates; a
candidate pair's MinHash values are compared a few at a time, and the pair is dropped as soon as the
posterior probability that it reaches the threshold falls below a tolerance; the n-grams themselves
decide the rest. Candidates are compared in tiles of bounded size inside their connected groups, and a
tile returns numbers of links and a spanning forest, never its pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucospan.llm import chars
from glucospan.llm.graph import components
from glucospan.storage import stored


@dataclass(frozen=True)
class Settings:
    """A pair at the threshold 0.8 misses all 40 bands of 5 values with a chance of about 1e-7.

    ``step`` MinHash values are compared at a time; a tile has about ``tile`` classes and ``words`` words.
    """

    n: int = 5
    threshold: float = 0.8
    bands: int = 40
    width: int = 5
    tolerance: float = 1e-8
    step: int = 20
    tile: int = 1024
    words: int = 1 << 20


@functools.cache
def _multipliers(count: int) -> np.ndarray:
    return chars.mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(chars.BASE)) | np.uint64(1)


def shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words, and where each text's begin. Fewer words than n make one n-gram."""
    w = chars.words(texts)
    hashed, at = chars.windows_hash(w.hash, w.text, tuple(range(n)))
    text = w.text[at]
    counts = np.diff(w.first)
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            some = w.first[short][:, None] + np.arange(size)
            own = np.repeat(np.arange(len(short)), size)
            h, _ = chars.windows_hash(w.hash[some.ravel()], own, tuple(range(size)))
            text, hashed = np.concatenate([text, short]), np.concatenate([hashed, h])
    order = np.argsort(text, kind="stable")
    return hashed[order], np.searchsorted(text[order], np.arange(len(texts) + 1))


def signatures(hashed: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """The least value of each text's n-grams under each hash function; texts without n-grams get zeros."""
    out = np.zeros((len(first) - 1, count), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        with np.errstate(over="ignore"):
            for i, m in enumerate(_multipliers(count)):
                out[full, i] = np.minimum.reduceat(hashed * m, first[full])
    return out


def band_keys(signature: np.ndarray, s: Settings) -> np.ndarray:
    grid = signature.reshape(len(signature), s.bands, s.width)
    with np.errstate(over="ignore"):
        key = np.arange(1, s.bands + 1, dtype=np.uint64)[None, :] * np.uint64(chars.BASE)
        for i in range(s.width):
            key = chars.mixed(key ^ grid[:, :, i])
    return key


@functools.cache
def least_matches(s: Settings) -> list[tuple[int, int]]:
    """(values compared, least matches to go on): with a flat prior, P(J >= t | m of n) = P(Bin(n+1, t) <= m)."""
    out = []
    total = s.bands * s.width
    for n in range(s.step, total + 1, s.step):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * s.threshold**m * (1 - s.threshold) ** (n + 1 - m)
            if tail >= s.tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def _marked(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, digest, words, keys): the digest of the text, null without words, and the keys of its bands."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, some in chars.chunks(part.column(2)):
                hashed, first = shingles(some, s.n)
                keys = band_keys(signatures(hashed, first, s.bands * s.width), s).astype(np.int64)
                words = np.diff(first)
                digest = part.column(1).slice(at, len(some))
                digest = pa.array([d if n else None for d, n in zip(digest.to_pylist(), words.tolist())], pa.string())
                lists = pa.ListArray.from_arrays(
                    np.arange(0, keys.size + 1, s.bands, dtype=np.int32) if keys.size else np.zeros(1, np.int32), keys.ravel()
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(at, len(some)), digest, pa.array(words), lists],
                    names=["doc_id", "digest", "words", "keys"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.md5("text").alias("digest"), "text")
    return rows.mapInArrow(batches, "doc_id long, digest string, words long, keys array<long>")


class Tile:
    """Classes to compare: all pairs of one block, or each of one block with each of another."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, left: np.ndarray, texts: list[str], cross: bool, s: Settings):
        self.ids, self.copies, self.left, self.cross, self.s = ids, copies, left, cross, s
        self.texts = texts

    def candidates(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that share a band, each once."""
        size = len(self.ids)
        shared = np.zeros((size, size), bool)
        for band in range(keys.shape[1]):
            order = np.argsort(keys[:, band], kind="stable")
            sorted_keys = keys[order, band]
            edges = np.flatnonzero(np.append(True, np.diff(sorted_keys) != 0))
            ends = np.append(edges[1:], size)
            for a, b in zip(edges[ends - edges > 1], ends[ends - edges > 1]):
                shared[np.ix_(order[a:b], order[a:b])] = True
        if self.cross:
            shared &= self.left[:, None] & ~self.left[None, :]
        else:
            shared = np.triu(shared, 1)
        return np.nonzero(shared)

    def survivors(self, signature: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep_a, keep_b = [], []
        for low in range(0, len(a), 1 << 16):
            x, y = a[low : low + (1 << 16)], b[low : low + (1 << 16)]
            matches, before = np.zeros(len(x), np.int64), 0
            for n, least in least_matches(self.s):
                matches += (signature[x, before:n] == signature[y, before:n]).sum(axis=1)
                stay = matches >= least
                x, y, matches, before = x[stay], y[stay], matches[stay], n
            keep_a.append(x)
            keep_b.append(y)
        return (np.concatenate(keep_a), np.concatenate(keep_b)) if keep_a else (a, b)

    def verified(self, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair reaches the threshold, by bitsets over the n-grams that several classes have."""
        sizes = np.array([len(x) for x in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), sizes)
        _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[word]
        row, column = row[column >= 0], column[column >= 0]
        both = np.zeros(len(a), np.int64)
        width = 1 << 15
        for low in range(0, int(column.max(initial=-1)) + 1, width):
            here = (column >= low) & (column < low + width)
            grid = np.zeros((len(sets), width), bool)
            grid[row[here], column[here] - low] = True
            bits = np.packbits(grid, axis=1).view(np.uint64)
            for at in range(0, len(a), 1 << 11):
                part = slice(at, at + (1 << 11))
                both[part] += np.bitwise_count(bits[a[part]] & bits[b[part]]).sum(axis=1, dtype=np.int64)
        return both >= self.s.threshold * (sizes[a] + sizes[b] - both) - 1e-9

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (a, b, links): numbers of linked documents of a (b is -1), and links of a spanning forest."""
        hashed, first = [], [0]
        sign = []
        for _, some in chars.chunks(self.texts):
            h, f = shingles(some, self.s.n)
            sign.append(signatures(h, f, self.s.bands * self.s.width))
            hashed += [np.unique(h[x:y]) for x, y in zip(f[:-1], f[1:])]
        signature = np.concatenate(sign)
        a, b = self.candidates(band_keys(signature, self.s))
        a, b = self.survivors(signature, a, b)
        if len(a):
            alike = self.verified(hashed, a, b)
            a, b = a[alike], b[alike]
        size = len(self.ids)
        number = np.bincount(a, self.copies[b], size) + np.bincount(b, self.copies[a], size)
        linked = np.flatnonzero(number)
        from_, to = forest(size, a, b)
        return (
            np.concatenate([self.ids[linked], self.ids[from_]]),
            np.concatenate([np.full(len(linked), -1), self.ids[to]]),
            np.concatenate([number[linked].astype(np.int64), np.zeros(len(to), np.int64)]),
        )


def forest(size: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that has links and a node that stands for its connected group."""
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(size))
    return moved, label[moved]


def _compare(s: Settings):
    """Rows (tile, alone, cross, left, words, id, copies, text) in the order of their tiles -> rows of links.

    Components of one tile (not ``alone``) are taken together up to the size of one.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        current, words = None, 0

        def done() -> pa.RecordBatch:
            ids, copies, left = (np.array([r[i] for r in rows]) for i in (5, 6, 3))
            tile = Tile(ids.astype(np.int64), copies.astype(np.int64), left.astype(bool), [r[7] for r in rows], rows[0][2], s)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in tile.links()], names=["a", "b", "links"])

        for part in parts:
            for row in zip(*map(chars.values, part.columns)):
                if row[0] != current:
                    if rows and (rows[0][1] or row[1] or len(rows) >= s.tile or words >= s.words):
                        yield done()
                        rows, words = [], 0
                    current = row[0]
                rows.append(row)
                words += row[4]
        if rows:
            yield done()

    return batches


def similar(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of ``docs`` (doc_id, text; other columns are ignored).

    ``n_links`` counts the other rows whose n-gram sets reach the threshold, copies included; ``class_id`` is
    the smallest doc_id of the group that such links connect, the row's own if it has none. Texts without
    words, null or empty ones too, are like nothing, not even each other. Repeated rows count as copies. A
    row with a null doc_id belongs to the group of its text; it cannot name one.
    """
    s = settings
    marks = stored(_marked(docs, s))
    copies = marks.filter(F.col("digest").isNotNull()).groupBy("digest")
    copies = stored(copies.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter(F.col("rep").isNotNull()))
    reps = marks.join(copies.select(F.col("rep").alias("doc_id"), "digest", "copies"), ["doc_id", "digest"])
    reps = stored(reps.dropDuplicates(["doc_id", "digest"]).withColumnRenamed("doc_id", "rep"))

    # Two texts of one id would make a class that the id cannot tell from another: they share its links.
    bands = reps.select("rep", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("_n")).filter(F.col("_n") > 1)
    near = components(bands.join(shared.select("key", "least"), "key").select(F.col("rep").alias("a"), F.col("least").alias("b")))

    members = stored(reps.select("rep", "digest", "words", "copies").join(near.withColumnRenamed("node", "rep"), "rep"))
    blocks = F.greatest(F.ceil(F.count("*") / s.tile), F.ceil(F.sum("words") / s.words)).cast("int")
    sizes = members.groupBy("component").agg(blocks.alias("blocks"))
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = placed.withColumn("other", other).select(
        F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("tile"),
        (F.col("blocks") > 1).alias("alone"),
        (F.col("block") != F.col("other")).alias("cross"),
        (F.col("block") < F.col("other")).alias("left"),
        "words", F.col("rep").alias("id"), "copies", "digest",
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.md5("text").alias("digest"))
    # Both sides grow with the corpus: merged at every size.
    wanted = members.select(F.col("rep").alias("id"), "digest").hint("merge")
    texts = texts.join(wanted, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    rows = tiles.join(texts, ["id", "digest"]).select("tile", "alone", "cross", "left", "words", "id", "copies", "text")
    rows = rows.repartition("tile").sortWithinPartitions("tile", "id")
    found = stored(rows.mapInArrow(_compare(s), "a long, b long, links long"))

    links = found.filter(F.col("b") < 0).groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(found.filter(F.col("b") >= 0).select("a", "b")).select(F.col("node").alias("rep"), "component")
    known = copies.join(links, "rep", "left").join(groups, "rep", "left").select(
        "digest",
        F.coalesce("component", "rep").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    return marks.select("doc_id", "digest").join(known, "digest", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
