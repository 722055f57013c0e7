"""Token ids in length-delimited record files with a separate offset index.

A record is framed as: 8 bytes length, 4 bytes masked CRC-32C of those, the payload, 4 bytes masked
CRC-32C of the payload (all little-endian), the framing that public record readers know. The payload is a
16-byte header (key, number of ids, bytes an id, flags) and the ids in 2 or 4 bytes each.

Each task writes the records of one range of keys into files of its own and returns their index rows, which
Spark commits as Parquet beside them. A lost or repeated task's files have other names and stand in no index
row, so readers never see them.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glucospan.llm import chars, crc32c
from glucospan.llm.packing import word_ids

HEAD = struct.Struct("<qIHH")
INDEX = "part int, file string, offset long, size long, key long, first long, n_tokens long"
#: Most bytes of records that a reader holds at a time, but for a single longer record.
HELD = 16 << 20


def place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder that all executors reach."""
    return pyarrow.fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def framed(payloads: list[bytes]) -> list[bytes]:
    """The payloads with lengths and checksums."""
    sizes = np.array([len(p) for p in payloads], "<u8")
    heads = sizes.tobytes()
    eights = np.arange(len(payloads)) * 8
    ends = np.cumsum(sizes.astype(np.int64))
    of_size = crc32c.masked(crc32c.spans(np.frombuffer(heads, np.uint8), eights, eights + 8))
    data = np.frombuffer(b"".join(payloads), np.uint8)
    of_data = crc32c.masked(crc32c.spans(data, ends - sizes.astype(np.int64), ends))
    a, b = of_size.astype("<u4").tobytes(), of_data.astype("<u4").tobytes()
    return [
        b"".join((heads[8 * i : 8 * i + 8], a[4 * i : 4 * i + 4], p, b[4 * i : 4 * i + 4]))
        for i, p in enumerate(payloads)
    ]


def unframed(frames: list[bytes], names: list[str]) -> list[bytes]:
    """The payloads of whole frames; one that is cut or does not fit its checksums raises with its name."""
    joined = np.frombuffer(b"".join(frames), np.uint8)
    sizes = np.array([len(f) for f in frames], np.int64)
    start = np.cumsum(sizes) - sizes
    stated = np.array([int.from_bytes(f[:8], "little") if len(f) >= 16 else -1 for f in frames], np.int64)
    bad = stated != sizes - 16
    if not bad.any():
        sums = np.array([(int.from_bytes(f[8:12], "little"), int.from_bytes(f[-4:], "little")) for f in frames], np.uint32)
        sums = sums.reshape(-1, 2)
        bad = crc32c.masked(crc32c.spans(joined, start, start + 8)) != sums[:, 0]
        bad |= crc32c.masked(crc32c.spans(joined, start + 12, start + sizes - 4)) != sums[:, 1]
    if bad.any():
        raise ValueError(f"damaged record {names[int(np.flatnonzero(bad)[0])]}")
    return [f[12:-4] for f in frames]


def payload(key: int | None, ids: np.ndarray) -> bytes:
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    return HEAD.pack(key or 0, len(ids), width, key is None) + ids.astype(f"<u{width}").tobytes()


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    key, count, width, null = HEAD.unpack_from(data)
    ids = np.frombuffer(data, f"<u{width}", count, HEAD.size)
    return None if null else key, ids


class _Files:
    """A task's record files: a new one when ``most`` bytes are in the last."""

    def __init__(self, folder: str, part: int, most: int):
        self.system, self.path = place(folder)
        self.system.create_dir(self.path, recursive=True)
        self.run, self.part, self.most = uuid.uuid4(), part, most
        self.out, self.name, self.at, self.number = None, None, 0, 0

    def append(self, frames: list[bytes]) -> tuple[list[str], list[int]]:
        files, offsets, run = [], [], []
        for frame in frames:
            if self.out is None or self.at + len(frame) > self.most and self.at:
                self._write(run)
                run = []
                self.close()
                self.name = f"{self.part:06d}-{self.number:04d}-{self.run}.rec"
                self.out = self.system.open_output_stream(f"{self.path}/{self.name}")
                self.number, self.at = self.number + 1, 0
            files.append(self.name)
            offsets.append(self.at)
            run.append(frame)
            self.at += len(frame)
        self._write(run)
        return files, offsets

    def _write(self, run: list[bytes]) -> None:
        if run:
            self.out.write(b"".join(run))

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write(
    df: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 1,
    part_bytes: int = 32 << 20, file_bytes: int = 256 << 20,
) -> DataFrame:
    """Write each text's ids with ``end_id`` after them to record files in ascending order of the keys.

    ``path``: a word tokenizer's file, encoded as the tokenizers library does, which takes added tokens inside a text
    as themselves. Returns the index, a table in ``folder/index``: part, file, offset, size, key, first (ids of the part's documents before
    it), n_tokens. ``folder`` must be new and one that all executors reach. Null keys come first; rows of one key
    are ordered by their text's digest, and equal rows are all written, over several tasks where they are
    many. A null text is empty: ``end_id`` alone. Other columns are left alone, whatever their names; an empty
    table gives an empty index. ``part_bytes``: text a task.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16).cast("long"))).first()[0] or 0
    rows = rows.withColumns({"digest": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    ordered = ["key", "digest", "salt"]
    parts = rows.repartitionByRange(max(1, -(-total // part_bytes)), *ordered).sortWithinPartitions(*ordered)

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        files = _Files(f"{folder}/records", part, file_bytes)
        for batch in incoming:
            keys = batch.column(0).to_pylist()
            for at, some in chars.chunks(batch.column(1)):
                ids = [np.append(x, np.int32(end_id)) for x in word_ids(some, path)]
                own = keys[at : at + len(some)]
                frames = framed([payload(k, x) for k, x in zip(own, ids)])
                names, offsets = files.append(frames)
                counts = np.array([len(x) for x in ids], np.int64)
                before = first + np.cumsum(counts) - counts
                first += int(counts.sum())
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(len(ids), part, np.int32)),
                        "file": pa.array(names),
                        "offset": pa.array(offsets, pa.int64()),
                        "size": pa.array([len(f) for f in frames], pa.int64()),
                        "key": pa.array(own, pa.int64()),
                        "first": pa.array(before),
                        "n_tokens": pa.array(counts),
                    }
                )
        files.close()

    made = parts.select("key", "text").mapInArrow(batches, INDEX)
    made.write.parquet(f"{folder}/index")
    return index(spark, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def with_start(rows: DataFrame) -> DataFrame:
    """The index with ``start``: the ids of all documents before it in the whole set. One row a part is ordered."""
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    return rows.join(parts, "part").withColumn("start", F.col("_ahead") + F.col("first")).drop("_ahead")


def read(spark: SparkSession, folder: str, shuffle: int | None = None, part_bytes: int = 64 << 20) -> DataFrame:
    """(key, start, n_tokens, ids) of all records by their offsets; ids as little-endian unsigned 32-bit numbers.

    In the order written, or shuffled by the seed ``shuffle``: then each task fetches the records of its stretch
    of a random order wherever they lie. Every frame's checksums are verified and its key and number of ids
    compared with the index; a damaged or wrong record raises.
    """
    rows = with_start(index(spark, folder))
    total = rows.agg(F.sum("size")).first()[0] or 0
    order = ["part", "file", "offset"] if shuffle is None else [F.xxhash64("file", "offset", F.lit(shuffle)), F.col("file"), F.col("offset")]
    rows = rows.repartitionByRange(max(1, -(-total // part_bytes)), *order).sortWithinPartitions(*order)

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = place(f"{folder}/records")
        for batch in incoming:
            size = np.cumsum(batch.column(2).to_numpy())
            at = 0
            while at < batch.num_rows:
                done = size[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(size, done + HELD, "right")))
                yield _fetched(system, path, batch.slice(at, upto - at))
                at = upto

    columns = rows.select("file", "offset", "size", "key", "start", "n_tokens")
    return columns.mapInArrow(batches, "key long, start long, n_tokens long, ids binary")


def _fetched(system: pyarrow.fs.FileSystem, path: str, rows: pa.RecordBatch) -> pa.RecordBatch:
    """The records of some index rows, in their order; neighbours in a file are read at once."""
    files, offsets, sizes = rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist()
    frames: list[bytes] = [b""] * rows.num_rows
    order = sorted(range(rows.num_rows), key=lambda i: (files[i], offsets[i]))
    at, source, opened = 0, None, None
    while at < len(order):
        i, stop = order[at], at + 1
        end = offsets[i] + sizes[i]
        while stop < len(order) and files[order[stop]] == files[i] and offsets[order[stop]] == end:
            end += sizes[order[stop]]
            stop += 1
        if opened != files[i]:
            if source is not None:
                source.close()
            source, opened = system.open_input_file(f"{path}/{files[i]}"), files[i]
        data = source.read_at(end - offsets[i], offsets[i])
        for j in order[at:stop]:
            frames[j] = data[offsets[j] - offsets[i] : offsets[j] - offsets[i] + sizes[j]]
        at = stop
    if source is not None:
        source.close()
    names = [f"{f} at {o}" for f, o in zip(files, offsets)]
    records = [parsed(p) for p in unframed(frames, names)]
    for name, (key, ids), k, n in zip(names, records, rows.column(3).to_pylist(), rows.column(5).to_pylist()):
        if key != k or len(ids) != n:
            raise ValueError(f"record {name} is not the one of the index")
    return pa.RecordBatch.from_pydict(
        {
            "key": pa.array([k for k, _ in records], pa.int64()),
            "start": rows.column(4),
            "n_tokens": rows.column(5),
            "ids": pa.array([ids.astype("<u4").tobytes() for _, ids in records], pa.binary()),
        }
    )
