"""Record files: framing, order, sequential and shuffled reads, damage, lost attempts, odd rows."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glucospan.llm import crc32c, records
from glucospan.llm.queries import WORD_BPE


def slow(data):
    """The checksum by its definition, bit by bit."""
    rest = 0xFFFFFFFF
    for byte in data:
        rest ^= byte
        for _ in range(8):
            rest = rest >> 1 ^ (0x82F63B78 if rest & 1 else 0)
    return rest ^ 0xFFFFFFFF


def test_checksums():
    assert crc32c.spans(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0] == 0xE3069283
    draw = np.random.default_rng(1)
    data = draw.integers(0, 256, 3000).astype(np.uint8)
    begin = draw.integers(0, 1500, 60)
    end = begin + draw.integers(0, 1400, 60)
    assert crc32c.spans(data, begin, end).tolist() == [slow(data[a:b].tobytes()) for a, b in zip(begin, end)]


def test_framing_is_the_known_one():
    (frame,) = records.framed([b"abc"])
    length, of_length = struct.unpack("<QI", frame[:12])
    turned = [((c >> 15 | c << 17) + 0xA282EAD8) % 2**32 for c in (slow(frame[:8]), slow(b"abc"))]
    assert (length, of_length, frame[12:15], struct.unpack("<I", frame[15:])[0]) == (3, turned[0], b"abc", turned[1])
    assert records.unframed([frame], ["x"]) == [b"abc"] and records.framed([]) == []
    for broken in (frame[:-1], frame[:5], b"", frame[:13] + b"x" + frame[14:], b"\4" + frame[1:]):
        with pytest.raises(ValueError, match="damaged record x"):
            records.unframed([broken], ["x"])


TEXTS = ["", None, "Hello  world!", "word " * 9000, "x <|endoftext|> y", "é漢字 don't"]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows = [(7 * i % 41, TEXTS[i % len(TEXTS)], i) for i in range(41)] + [(None, "no key", 0), (3, "Hello", 0), (3, "Hello", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int").withColumn("salt", F.lit("x"))
    folder = str(tmp_path_factory.mktemp("records") / "set")
    index = records.write(df, folder, WORD_BPE, part_bytes=40_000, file_bytes=30_000)
    return rows, folder, index.collect()


def test_records_come_back_in_order(spark, written):
    rows, folder, index = written
    known = Tokenizer.from_file(WORD_BPE)
    assert len(index) == len(rows) and len({r.part for r in index}) > 1
    assert len({r.file for r in index}) > len({r.part for r in index})  # a part rolls over to new files
    got = sorted(records.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == sorted((k for k, _, _ in rows), key=lambda k: (k is not None, k))
    at = 0
    texts = {}
    for key, text, _ in rows:
        texts.setdefault(key, []).append([*known.encode(text or "", add_special_tokens=False).ids, 1])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids)
        texts[r.key].remove(ids)
        at += len(ids)


def test_shuffled_reads_hold_the_same(spark, written):
    _, folder, _ = written
    plain = [tuple(r) for r in records.read(spark, folder, part_bytes=1 << 14).collect()]
    mixed = [tuple(r) for r in records.read(spark, folder, shuffle=5, part_bytes=1 << 14).collect()]
    assert mixed != plain and sorted(mixed, key=str) == sorted(plain, key=str)
    assert mixed == [tuple(r) for r in records.read(spark, folder, shuffle=5, part_bytes=1 << 14).collect()]


def test_files_of_lost_attempts_are_not_read_and_damage_is(spark, written):
    _, folder, index = written
    with open(f"{folder}/records/000000-0000-lost.rec", "wb") as file:
        file.write(b"half a record")
    assert records.read(spark, folder).count() == len(index)
    name = f"{folder}/records/{index[0].file}"
    os.chmod(name, 0o644)
    with open(name, "r+b") as file:
        file.seek(index[0].offset + 14)
        old = file.read(1)
        file.seek(index[0].offset + 14)
        file.write(bytes([old[0] ^ 1]))
    with pytest.raises(Exception, match="damaged record"):
        records.read(spark, folder).collect()


def test_wide_ids_and_nothing(spark, tmp_path):
    assert records.parsed(records.payload(None, np.array([70_000, 1])))[1].tolist() == [70_000, 1]
    assert records.parsed(records.payload(5, np.zeros(0, np.int32)))[0] == 5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert records.write(empty, str(tmp_path / "none"), WORD_BPE).count() == 0
    assert records.read(spark, str(tmp_path / "none")).count() == 0
