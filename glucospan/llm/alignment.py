"""Two tokenizers' tokens of the same text side by side.

Byte offsets where tokens of both end cut a text into groups. They are found by a galloping intersection: the
shorter list of ends drives an exponential, then a binary search into the longer one, each search going on
where the last one ended. An end's place in the longer list is its rank; the ranks of a token's two ends
bound the tokens that it overlaps, its links.

A pair of ids counts over the whole corpus. Texts are worked on in chunks; each chunk numbers its different
pairs, so that a text's links are numbers into its chunk's list and only one row for each pair and chunk goes
through the corpus-wide count and back.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucospan.llm import chars
from glucospan.llm.bpe import sliced_ids
from glucospan.llm.merging import byte_names, merge_file_encoder
from glucospan.storage import stored

#: Successive ends of one text that are searched one after the other; the runs are searched side by side.
RUN = 32
#: Codepoints whose links share one list of pairs; a longer text has a list of its own.
CHUNK = 4 << 20


@dataclass
class Vocabulary:
    """The bytes of all tokens, one after the other, and where each begins and its length."""

    flat: np.ndarray
    begin: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length)

    def bytes(self, ids: np.ndarray) -> bytes:
        return self.flat[spread(self.begin[ids], self.length[ids])].tobytes()


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


@functools.cache
def _byte_level(path: str):
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    byte = {name: b for b, name in byte_names().items()}
    tokens = [b""] * (1 + max([*data["model"]["vocab"].values(), *(t["id"] for t in data["added_tokens"])]))
    for token, i in data["model"]["vocab"].items():
        tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    for token in data["added_tokens"]:
        tokens[token["id"]] = token["content"].encode()
    return merge_file_encoder(path), Vocabulary.of(tokens)


@functools.cache
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        tokens.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return model, Vocabulary.of(tokens)


def gallop(target: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each value the first place from ``low`` on where ``target`` reaches it; it does so before ``high``."""
    at, below, step = low.copy(), low - 1, 1
    live = np.flatnonzero(target[at] < value)
    while len(live):  # double the step until the value is passed
        below[live] = at[live]
        at[live] = np.minimum(at[live] + step, high[live] - 1)
        live = live[target[at[live]] < value[live]]
        step *= 2
    live = np.flatnonzero(at - below > 1)
    while len(live):  # then halve what is left
        middle = (at[live] + below[live]) >> 1
        less = target[middle] < value[live]
        below[live] = np.where(less, middle, below[live])
        at[live] = np.where(less, at[live], middle)
        live = live[at[live] - below[live] > 1]
    return at


def ranks(driver: np.ndarray, d_cuts: np.ndarray, target: np.ndarray, t_cuts: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the driver, their ranks in the target) for the texts ``some``; the cuts bound the texts' ends."""
    size = (d_cuts[1:] - d_cuts[:-1])[some]
    runs = -(-size // RUN)
    text = np.repeat(some, runs)
    first = spread(np.zeros(len(some), np.int64), runs) * RUN + d_cuts[text]
    left = np.minimum(RUN, d_cuts[text + 1] - first)
    at, high = t_cuts[text].copy(), t_cuts[text + 1]
    rank = np.zeros(len(driver), np.int64)
    for step in range(int(left.max(initial=0))):
        lanes = np.flatnonzero(left > step)
        at[lanes] = gallop(target, driver[first[lanes] + step], at[lanes], high[lanes])
        rank[first[lanes] + step] = at[lanes]
    places = spread(d_cuts[some], size)
    return places, rank[places]


@dataclass
class Aligned:
    """Tokens of several texts: ids and each text's cuts in them, the last tokens of the groups on both sides,
    and the links as (place in a, place in b) with each text's number of them."""

    a: np.ndarray
    b: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    a_link: np.ndarray
    b_link: np.ndarray

    def per_text(self, places: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """How many of the rising places lie in each text."""
        return np.diff(np.searchsorted(places, cuts))


def align(ids_a: list[np.ndarray], ids_b: list[np.ndarray], a_length: np.ndarray, b_length: np.ndarray) -> Aligned:
    """Align texts whose tokens' lengths (by id) add up to the same number of bytes on both sides."""
    sizes_a, sizes_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = (np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64) for ids in (ids_a, ids_b))
    a_cuts, b_cuts = np.append(0, np.cumsum(sizes_a)), np.append(0, np.cumsum(sizes_b))
    a_end, b_end = np.cumsum(a_length[a]), np.cumsum(b_length[b])  # texts follow each other on both sides
    last, link = [], []
    for some, d_end, d_cuts, t_end, t_cuts, turned in (
        (np.flatnonzero((sizes_a <= sizes_b) & (sizes_a > 0)), a_end, a_cuts, b_end, b_cuts, False),
        (np.flatnonzero(sizes_a > sizes_b), b_end, b_cuts, a_end, a_cuts, True),
    ):
        place, rank = ranks(d_end, d_cuts, t_end, t_cuts, some)
        if not len(place):
            continue
        common = t_end[rank] == d_end[place]
        first = np.append(0, rank[:-1] + common[:-1])  # after the text before, for the first token of a text
        opening = np.isin(place, d_cuts[some])
        first[opening] = t_cuts[some]
        count = rank - first + 1
        pairs = [(place[common], rank[common]), (np.repeat(place, count), spread(first, count))]
        pairs = [pair[::-1] if turned else pair for pair in pairs]
        last.append(np.stack(pairs[0]))
        link.append(np.stack(pairs[1]))
    none = np.zeros((2, 0), np.int64)
    last, link = (np.concatenate([none, *x], axis=1) for x in (last, link))
    # Both sides' lists rise already; texts of either side take turns.
    last, link = (x[:, np.argsort(x[0], kind="stable")] for x in (last, link))
    return Aligned(a, b, a_cuts, b_cuts, last[0], last[1], link[0], link[1])


@functools.cache
def _names(a_size: int, b_size: int) -> np.ndarray:
    """Decimal ids with the sign after them: inside and at the end of a group's left side, then of its right."""
    sides = ((a_size, ","), (a_size, "|"), (b_size, ","), (b_size, ";"))
    return np.array([f"{i}{sign}" for size, sign in sides for i in range(size)], object)


def _before(places: np.ndarray, size: int) -> np.ndarray:
    """How many of the places lie before each place."""
    marks = np.zeros(size + 1, np.int64)
    marks[places + 1] = 1
    return np.cumsum(marks)[:size]


def spelled(x: Aligned, a_size: int, b_size: int) -> list[str]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    a_group, b_group = _before(x.a_last, len(x.a)), _before(x.b_last, len(x.b))
    codes = np.empty(len(x.a) + len(x.b), np.int64)
    code_a, code_b = x.a.copy(), x.b + 2 * a_size
    code_a[x.a_last] += a_size
    code_b[x.b_last] += b_size
    codes[np.arange(len(x.a)) + np.append(0, x.b_last + 1)[a_group]] = code_a
    codes[np.arange(len(x.b)) + (x.a_last + 1)[b_group]] = code_b
    names = _names(a_size, b_size)
    cuts = x.a_cuts + x.b_cuts
    return ["".join(names[codes[i:j]].tolist())[:-1] for i, j in zip(cuts[:-1], cuts[1:])]


class Tokens:
    """Both tokenizers' ids of texts with a space before them."""

    def __init__(self, byte_level: str, pieces: str):
        self.encoder, self.a = _byte_level(byte_level)
        self.model, self.b = _pieces(pieces)

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """None at all for a text that is empty or whose tokens' bytes are not those of the text."""
        spaced = [" " + t if t else "" for t in texts]
        left = sliced_ids(spaced, self.encoder)
        right = [np.array(x, np.int32) for x in self.model.encode(texts, num_threads=1)]
        wanted = [t.encode() for t in spaced]
        whole = b"".join(wanted)
        if any(vocabulary.bytes(np.concatenate([_NONE, *ids])) != whole for vocabulary, ids in ((self.a, left), (self.b, right))):
            for i, want in enumerate(wanted):
                if self.a.bytes(left[i]) != want or self.b.bytes(right[i]) != want:
                    left[i] = right[i] = _NONE
        return left, right


_NONE = np.zeros(0, np.int32)
STORED = (
    "kind int, chunk long, key long, n long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, links binary"
)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


class _Chunk:
    """Aligned texts whose pairs are numbered together."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.rows: list[tuple] = []
        self.keys: list[np.ndarray] = []

    def batches(self) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(k) for k in self.keys], np.int64)
        coded = pa.array(np.concatenate(self.keys)).dictionary_encode()
        which, keys = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        keys, which = keys[order], rank[which]
        count = np.bincount(which, minlength=len(keys))
        yield _rows(len(keys), {"kind": np.zeros(len(keys), np.int32), "chunk": np.full(len(keys), self.number), "key": keys, "n": count})
        which, links = which.astype("<u4"), []
        for end, size in zip(np.cumsum(sizes), sizes):
            links.append(np.diff(np.sort(which[end - size : end]), prepend=np.uint32(0)).tobytes())
        made = dict(zip(COLUMNS, map(list, zip(*self.rows))))
        n = len(links)
        yield _rows(n, {"kind": np.ones(n, np.int32), "chunk": np.full(n, self.number), **made, "links": links})


_ARROW = pa.schema(
    [(name, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind])
     for name, kind in (field.split() for field in STORED.split(", "))]
)


def _rows(n: int, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW
    )


def _aligned(df: DataFrame, key: str, text: str, byte_level: str, pieces: str) -> DataFrame:
    """Rows of pairs (kind 0: chunk, key, n) and of texts (kind 1, ``links`` as steps between rising pair numbers)."""

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, number = Tokens(byte_level, pieces), TaskContext.get().partitionId() << 32
        a_size, b_size = len(tokens.a.length), len(tokens.b.length)
        chunk = _Chunk(number)
        for batch in incoming:
            keys = batch.column(0).to_pylist()
            for at, texts in chars.chunks(batch.column(1)):
                x = align(*tokens.ids(texts), tokens.a.length, tokens.b.length)
                words = spelled(x, a_size, b_size)
                n_groups, n_links = x.per_text(x.a_last, x.a_cuts), x.per_text(x.a_link, x.a_cuts)
                pairs = x.a[x.a_link] << 32 | x.b[x.b_link]
                chunk.keys += np.split(pairs, np.cumsum(n_links)[:-1])
                digests = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in words]
                chunk.rows += zip(
                    keys[at : at + len(texts)], np.diff(x.a_cuts).tolist(), np.diff(x.b_cuts).tolist(),
                    n_groups.tolist(), n_links.tolist(), digests,
                )
                chunk.size += sum(map(len, texts))
                if chunk.size >= CHUNK:
                    yield from chunk.batches()
                    number += 1
                    chunk = _Chunk(number)
        if chunk.rows:
            yield from chunk.batches()

    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(batches, STORED)


def _counted(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the sums over their links, from each chunk's pairs in order followed by its texts."""
    current, held, counts, best = None, [], None, None
    for batch in incoming:
        kind, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((np.diff(kind) != 0) | (np.diff(chunk) != 0)) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if low == high:
                continue
            part = batch.slice(low, high - low)
            if chunk[low] != current:
                current, held, counts = chunk[low], [], None
            if kind[low] == 0:
                held.append((part.column(2).to_numpy(), part.column(3).to_numpy(zero_copy_only=False)))
                continue
            if counts is None:
                counts = np.concatenate([np.zeros(0, np.int64), *(n for n, _ in held)])
                best = np.concatenate([np.zeros(0, bool), *(b for _, b in held)])
            sums, tops = [], []
            for steps in chars.values(part.column(4)):
                pairs = np.cumsum(np.frombuffer(steps, "<u4"), dtype=np.int64)
                sums.append(int(counts[pairs].sum()))
                tops.append(int(best[pairs].sum()))
            made = [pa.array(tops, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns[5:], *made], names=[*COLUMNS, "n_best", "count_sum"])


def linked(df: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df`` with how the two tokenizers' tokens of its text overlap.

    Side a are the ids of a byte-level file of the tokenizers library for a space and the text, side b those of a
    sentencepiece model for the text. Columns doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (the groups as
    ``a1,a2|b1;a3|b2,b3``, hashed), n_best (links whose pair of ids is linked most often in the corpus among
    those of its b id, ties included) and count_sum (over the links, how often the corpus links their pair).

    Texts that are null, empty, or whose tokens' bytes are not those of the space and the text have no tokens:
    zeros and an empty digest. Repeated rows and null keys count like any other. Other columns are left
    alone, whatever their names. An empty table gives no rows.
    """
    work = stored(_aligned(df, key, text, byte_level, pieces))
    pairs = work.filter("kind = 0").select("chunk", "key", "n")
    totals = pairs.groupBy("key").agg(F.sum("n").alias("total")).withColumn("b", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    totals = totals.join(most, "b").select("key", "total", (F.col("total") == F.col("most")).alias("best"))
    known = pairs.select("chunk", "key").join(totals, "key")
    nothing = {"long": F.lit(None).cast("long"), "string": F.lit(None).cast("string")}
    known = known.select(
        F.lit(0).alias("kind"), "chunk", "total", "best", F.lit(None).cast("binary").alias("links"),
        *((nothing["string" if c == "groups_sha256" else "long"]).alias(c) for c in COLUMNS), "key",
    )
    texts = work.filter("kind = 1").select(
        "kind", "chunk", nothing["long"].alias("total"), F.lit(None).cast("boolean").alias("best"), "links", *COLUMNS, nothing["long"].alias("key"),
    )
    beside = known.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "kind", "key")
    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in [*COLUMNS, "n_best", "count_sum"])
    return beside.drop("key").mapInArrow(_counted, schema)


def groups(df: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, groups): each text's groups in order, with the byte offset of their end in the space and the text
    and the ids of both sides. Texts without tokens (see ``linked``) have an empty list."""

    def batches(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(byte_level, pieces)
        kind = pa.list_(pa.struct([("end", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))]))
        for batch in incoming:
            for at, texts in chars.chunks(batch.column(1)):
                x = align(*tokens.ids(texts), tokens.a.length, tokens.b.length)
                number, out = x.per_text(x.a_last, x.a_cuts), []
                a_parts, b_parts = np.split(x.a, x.a_last + 1), np.split(x.b, x.b_last + 1)
                ends = np.cumsum(tokens.a.length[x.a])[x.a_last]
                done = 0
                for n in number.tolist():
                    before = ends[done - 1] if done else 0
                    out.append([
                        {"end": ends[i] - before, "a": a_parts[i].tolist(), "b": b_parts[i].tolist()}
                        for i in range(done, done + n)
                    ])
                    done += n
                keys = batch.column(0).slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([keys, pa.array(out, kind)], names=["doc_id", "groups"])

    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, groups array<struct<end: long, a: array<long>, b: array<long>>>")
