"""Byte-level BPE encoding and decoding of whole texts."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glucospan.llm import chars
from glucospan.llm.merging import SliceEncoder, rank_encoder, rank_file
from glucospan.llm.pretokens import BYTE_LEVEL


@functools.cache
def _encoder(path: str):
    return rank_encoder(rank_file(path))


@functools.cache
def _bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, where each begins, and its length."""
    ranks = rank_file(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def ids_of(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text."""
    return sliced_ids(texts, _encoder(path))


def sliced_ids(texts: list[str], encoder: SliceEncoder) -> list[np.ndarray]:
    """The ids of each text: its slices by the byte-level rule, one after the other."""
    c = chars.chars(texts)
    begin = np.flatnonzero(BYTE_LEVEL.starts(c))
    stop = np.append(begin[1:], len(c.codes))
    visible = c.codes[begin] != chars.SEPARATOR
    begin, stop = begin[visible], stop[visible]
    ids, counts = encoder.encode(c, begin, stop)
    upto = np.append(0, np.cumsum(counts))
    cuts = upto[np.searchsorted(begin, np.append(c.starts, len(c.codes)))]
    return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def bytes_of(ids: np.ndarray, path: str) -> bytes:
    """The bytes that the ids stand for."""
    flat, begin, length = _bytes(path)
    lengths = length[ids]
    ends = np.cumsum(lengths)
    if not len(ids):
        return b""
    return flat[np.repeat(begin[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


def _with(df: DataFrame, run, needs: str, **columns: T.DataType) -> DataFrame:
    """Rows with new columns (any of the same name go); ``run`` maps the values to lists for them, some rows at a time."""
    kept = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns or c == needs))
    schema = T.StructType([f for f in kept.schema if f.name not in columns] + [T.StructField(n, t) for n, t in columns.items()])

    arrow = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, lists in run(part.column(part.schema.get_field_index(needs))):
                size = len(lists[0])
                keep = [part.column(i).slice(at, size) for i, f in enumerate(part.schema) if f.name not in columns]
                made = [
                    pa.array(values, arrow[t.typeName()]) for values, t in zip(lists, columns.values())
                ]
                yield pa.RecordBatch.from_arrays(keep + made, names=[f.name for f in schema])

    return kept.mapInArrow(batches, schema)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids`` and ``offsets``: binary arrays of little-endian unsigned 32-bit numbers.

    ``offsets`` holds where each id's bytes end in the UTF-8 text, for slicing while decoding. A null text
    counts as empty and has no ids; every row comes back once, and columns of the new names are replaced.
    """

    def run(texts):
        length = _bytes(path)[2]
        for at, some in chars.chunks(texts):
            ids = ids_of(some, path)
            ends = [np.cumsum(length[x]).astype("<u4").tobytes() for x in ids]
            yield at, ([len(x) for x in ids], [x.astype("<u4").tobytes() for x in ids], ends)

    return _with(df, run, text, n_tokens=T.LongType(), ids=T.BinaryType(), offsets=T.BinaryType())


def decode(df: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the bytes of ``ids``; null ids decode to no bytes."""

    def run(values):
        for at in range(0, len(values), 128):
            some = values.slice(at, 128).to_pylist()
            yield at, ([bytes_of(np.frombuffer(x or b"", "<u4"), path) for x in some],)

    return _with(df, run, "ids", decoded=T.BinaryType())


@functools.cache
def _decimals(size: int) -> np.ndarray:
    return np.array([str(i) for i in range(size)], object)


def digests(df: DataFrame, path: str) -> DataFrame:
    """Add ``ids_sha256``, of the decimal ids joined by single spaces, and ``decoded_sha256``, of the bytes that they
    decode to; null ids are none. Columns of the new names are replaced."""

    def run(values):
        for at in range(0, len(values), 128):
            found = [np.frombuffer(x or b"", "<u4") for x in values.slice(at, 128).to_pylist()]
            names = _decimals(1 << max(16, int(max((x.max(initial=0) for x in found), default=0)).bit_length()))
            of_ids = [hashlib.sha256(" ".join(names[x].tolist()).encode()).hexdigest() for x in found]
            yield at, (of_ids, [hashlib.sha256(bytes_of(x, path)).hexdigest() for x in found])

    return _with(df, run, "ids", ids_sha256=T.StringType(), decoded_sha256=T.StringType())
