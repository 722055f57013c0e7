"""Packing token pieces into as few sequences as possible: minimum bin slack.

Pieces of one length are interchangeable, so the plan is made on the number of pieces of each length.
For one sequence after the other the longest length left is set, and subset sums over the lengths left
(a bitset, one bit for each total) give the fullest combination beside it. The same combination is used
again as often as the numbers allow. The plan has a few rows for each length, whatever the number of
pieces; Spark counts the lengths, ranks the pieces of a length, and joins the ranks to the plan.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucospan.llm import chars
from glucospan.llm.merging import merge_file_encoder
from glucospan.llm.pretokens import WORD
from glucospan.storage import stored


@functools.cache
def _encoder(path: str):
    return merge_file_encoder(path)


@functools.cache
def _added(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """A pattern for the file's added tokens, the longest first, and their ids."""
    with open(path, encoding="utf-8") as file:
        ids = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    return re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")") if ids else None, ids


def word_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text: cut at the file's added tokens, which are ids of their own, and the parts between."""
    pattern, added = _added(path)
    cut = [pattern.split(t) if pattern else [t] for t in texts]
    ids = iter(_plain_ids([part for parts in cut for part in parts[::2]], path))
    out = []
    for parts in cut:
        own = [next(ids) if i % 2 == 0 else np.array([added[part]], np.int32) for i, part in enumerate(parts)]
        out.append(own[0] if len(own) == 1 else np.concatenate(own))
    return out


def _plain_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text without added tokens: composed form, lower case, words, merges."""
    texts = [t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in texts]
    # The one letter whose lower case is two codepoints.
    c = chars.chars([t.replace("İ", "i̇") if "İ" in t else t for t in texts])
    c.codes = chars.lower()[c.codes]
    starts, outside = WORD.starts(c), chars.kinds()[c.codes]
    outside = (outside == chars.SPACE) | (outside == chars.END)
    begin = np.flatnonzero(starts)
    edges = np.flatnonzero(starts | outside)
    stop = edges[np.searchsorted(edges, begin) + 1] if len(begin) else begin
    ids, counts = _encoder(path).encode(c, begin, stop)
    upto = np.append(0, np.cumsum(counts))
    cuts = upto[np.searchsorted(begin, np.append(c.starts, len(c.codes)))]
    return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def pieces(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1
) -> DataFrame:
    """Cut each text's ids, ``end_id`` after them, into pieces of ``capacity``; only the last may be shorter.

    Columns: the key, ``piece`` and ``start`` (both from 0), ``length``, and ``ids`` as binary
    little-endian unsigned 32-bit numbers. A null text counts as empty: one piece of ``end_id`` alone.
    """
    schema = T.StructType(
        [df.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType())]
        + [T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, some in chars.chunks(part.column(1)):
                row, piece, length, ids = [], [], [], []
                for i, own in enumerate(word_ids(some, path)):
                    own = np.append(own, end_id).astype("<u4")
                    for number, first in enumerate(range(0, len(own), capacity)):
                        row.append(at + i)
                        piece.append(number)
                        length.append(min(capacity, len(own) - first))
                        ids.append(own[first : first + capacity].tobytes())
                number = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row, pa.int64())),
                        pa.array(number),
                        pa.array(number.astype(np.int64) * capacity),
                        pa.array(length, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=[f.name for f in schema],
                )

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(batches, schema)


def _fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """Lengths (given longest first) and how many of each come nearest to ``room`` without passing it."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps = []
    for length in lengths:
        if reach >> room & 1:
            break
        if length > room:
            continue
        steps.append((length, reach))
        left, power = min(counts[length], room // length), 1
        while left:
            take = min(power, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            power *= 2
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        taken = 0
        while not before >> (total - taken * length) & 1:
            taken += 1
        if taken:
            chosen.append((length, taken))
            total -= taken * length
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first sequence, pieces a sequence, offset)."""
    counts = {length: n for length, n in counts.items() if n}
    used = dict.fromkeys(counts, 0)
    lengths = sorted(counts, reverse=True)
    out, sequence = [], 0
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        beside = dict(_fullest(counts, lengths, capacity - longest))
        counts[longest] += 1
        beside[longest] = beside.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in beside.items())
        offset = 0
        for length, n in sorted(beside.items(), reverse=True):
            out.append((length, used[length], n * times, sequence, n, offset))
            used[length] += n * times
            counts[length] -= n * times
            offset += n * length
        sequence += times
        lengths = [length for length in lengths if counts[length]]
    return out


def pack(rows: DataFrame, keys: list[str], capacity: int = 4096, shards: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    ``rows`` must be a stored table, as it is read twice. The driver sees the numbers of the lengths and
    the plan, both bounded by ``capacity``. Ranks within a length are counted in ``shards`` parts, so a
    length that a third of the rows have is not one group. Repeated rows are packed once each. Columns of
    the new names are replaced. A length outside the range raises.
    """
    rows = rows.drop("sequence_id", "offset")
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(shards)))
    number = rows.groupBy("length", "_shard").agg(F.count("*").alias("_n"))
    totals = number.groupBy("length").agg(F.sum("_n").alias("n")).collect()
    counts = {r.length: r.n for r in totals}
    if any(length is None or not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    below = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    ahead = number.select("length", "_shard", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("length", "_shard").orderBy(*(F.col(f"`{k}`") for k in keys))
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(ahead, ["length", "_shard"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_ahead")).drop("_shard", "_ahead")
    steps = rows.sparkSession.createDataFrame(
        plan(counts, capacity), "_length long, _from long, _pieces long, _sequence long, _per long, _offset long"
    )
    place = F.col("_rank") - F.col("_from")
    held = (
        (F.col("length") == F.col("_length"))
        & (F.col("_rank") >= F.col("_from"))
        & (F.col("_rank") < F.col("_from") + F.col("_pieces"))
    )
    return (
        ranked.join(F.broadcast(steps), held)  # a few rows a length at most
        .withColumn("sequence_id", F.col("_sequence") + F.floor(place / F.col("_per")))
        .withColumn("offset", F.col("_offset") + place % F.col("_per") * F.col("length"))
        .drop("_rank", "_length", "_from", "_pieces", "_sequence", "_per", "_offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence with its ``ids``, from packed pieces that carry theirs."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # no more bytes than a sequence has
    joined = F.aggregate(parts, F.lit(b""), lambda so_far, p: F.concat(so_far, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
