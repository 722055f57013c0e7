"""Byte-pair merging of many slices at once, with a bounded cache of slices seen before."""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np
import pyarrow as pa

from glucospan.llm import chars

NONE = np.iinfo(np.int32).max
#: Slices up to this many symbols are merged side by side in arrays; longer ones with a heap. Same ids.
SHORT = 64


class Merges:
    """Adjacent ids -> (rank, merged id). The pair of least rank merges first, the leftmost among equals."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.pairs = pairs
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        self.bits = max(10, int(len(keys) * 8).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.to = np.full(1 << self.bits, NONE, np.int32), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):  # the first to come takes a free slot, the others try the next one
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            lost = self.keys[slot] != keys[left]
            won = left[~lost]
            self.rank[slot[~lost]], self.to[slot[~lost]] = values[won, 0], values[won, 1]
            left, slot = left[lost], (slot[lost] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(chars.BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; -1 stands for no symbol."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        found = self.keys[slot]
        rank, to = self.rank[slot], self.to[slot]
        other = np.flatnonzero((found != key) & (found != -1))
        if len(missed := np.flatnonzero(found != key)):
            rank[missed], to[missed] = NONE, -1
        while len(other):
            at = slot[other] = (slot[other] + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == key[other]
            rank[other[hit]], to[other[hit]] = self.rank[at[hit]], self.to[at[hit]]
            other = other[~hit & (found != -1)]
        absent = (a < 0) | (b < 0)
        rank[absent], to[absent] = NONE, -1
        return rank, to

    def short(self, grid: np.ndarray) -> np.ndarray:
        """Merge each row of ids, padded with -1 on the right; a round merges one pair of each row."""
        n, width = grid.shape
        grid = np.concatenate([grid, np.full((n, 1), -1, np.int32)], axis=1)
        rank, to = self.look_up(grid[:, :-1].ravel(), grid[:, 1:].ravel())
        rank, to = rank.reshape(n, width), to.reshape(n, width)
        out, rows = grid.copy(), np.arange(n)
        columns = np.arange(width)
        while len(rows):
            at = np.argmin(rank, axis=1)
            each = np.arange(len(rows))
            live = rank[each, at] != NONE
            if not live.all():
                done = ~live
                out[rows[done]] = grid[done]
                rows, grid, rank, to, at = rows[live], grid[live], rank[live], to[live], at[live]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            grid[each, at] = to[each, at]
            past = columns[None, :] > at[:, None]
            grid[:, :-1] = np.where(past, grid[:, 1:], grid[:, :-1])
            shift = columns[None, :-1] > at[:, None]
            rank[:, :-1] = np.where(shift, rank[:, 1:], rank[:, :-1])
            to[:, :-1] = np.where(shift, to[:, 1:], to[:, :-1])
            rank[:, -1] = NONE
            rank[each, at], to[each, at] = self.look_up(grid[each, at], grid[each, at + 1])
            left = np.flatnonzero(at > 0)
            l, r = each[left], at[left]
            rank[l, r - 1], to[l, r - 1] = self.look_up(grid[l, r - 1], grid[l, r])
        return out[:, :-1]

    def long(self, ids: list[int]) -> list[int]:
        """The same for one long slice, in n log n."""
        n = len(ids)
        ids, after, before = list(ids), [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(self.pairs[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.pairs[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (ids[k], ids[after[k]])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p][0], k, *p))
        return [x for x in ids if x >= 0]


class SliceEncoder:
    """Slice -> ids, through a cache that starts anew when it holds ``limit`` slices.

    Slices are looked up by 64-bit hashes, and each hit is compared sign by sign with the slice that the cache
    holds: one that only shares its hash is merged by itself.
    """

    def __init__(self, merges: Merges, inner: np.ndarray, last: np.ndarray, whole: dict[str, int], limit: int = 400_000):
        """``inner`` and ``last``: the id of each byte inside and at the end of a slice. ``whole``: slices
        that are one id, whatever the merges give."""
        self.merges, self.inner, self.last, self.limit = merges, inner, last, limit
        self.whole, self.single = whole, {text.encode(): i for text, i in whole.items()}
        self._empty()

    def _empty(self) -> None:
        self.hash, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.signs = _Lists(np.int32), _Lists(np.uint32)
        if self.whole:
            c = chars.chars(list(self.whole))
            keys = c.spans_hash(c.starts, c.starts + c.lengths, fold=False)
            order = np.argsort(keys)
            ids = np.array(list(self.whole.values()), np.int32)[order]
            entries = self.ids.add(ids, np.ones(len(ids), np.int64))
            self._keep(keys[order], entries, c, c.starts[order], c.lengths[order])

    def _keep(self, keys: np.ndarray, entries: np.ndarray, c: chars.Chars, begin: np.ndarray, size: np.ndarray) -> None:
        """New slices: sorted hashes, the entries of their ids, and their signs."""
        signs = self.signs.add(c.codes[_places(begin, size)], size)
        assert np.array_equal(signs, entries)
        at = np.searchsorted(self.hash, keys)
        self.hash, self.entry = np.insert(self.hash, at, keys), np.insert(self.entry, at, entries)

    def _merged(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entries of the ids of slices, given by their bytes."""
        flat, counts, rows = [], [], []
        for low, width in zip((0, 4, 8, 12, 16, 24, 32), (4, 8, 12, 16, 24, 32, SHORT)):
            some = np.flatnonzero((size > low) & (size <= width))
            if not len(some):
                continue
            columns = np.arange(width)[None, :]
            places = np.minimum(begin[some][:, None] + columns, len(text) - 1)
            grid = np.where(columns < size[some][:, None], self.inner[text[places]], -1).astype(np.int32)
            ends = size[some] - 1
            grid[np.arange(len(some)), ends] = self.last[text[begin[some] + ends]]
            merged = self.merges.short(grid)
            valid = merged >= 0
            flat.append(merged[valid])
            counts.append(valid.sum(axis=1).astype(np.int64))
            rows.append(some)
        for i in np.flatnonzero(size > SHORT):
            ids = self._alone(text[begin[i] : begin[i] + size[i]])
            flat.append(np.array(ids, np.int32))
            counts.append(np.array([len(ids)], np.int64))
            rows.append(np.array([i]))
        ids, counts, rows = np.concatenate(flat), np.concatenate(counts), np.concatenate(rows)
        order = np.argsort(rows)
        starts = np.cumsum(counts) - counts
        return self.ids.add(ids[_places(starts[order], counts[order])], counts[order])

    def _alone(self, piece: np.ndarray) -> list[int]:
        """The ids of one slice, given by its bytes."""
        if (own := self.single.get(piece.tobytes())) is not None:
            return [own]
        return self.merges.long([*self.inner[piece[:-1]].tolist(), int(self.last[piece[-1]])])

    def encode(self, c: chars.Chars, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slices in order, and how many each slice has."""
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = end - begin
        keys, where, which = _distinct(c.spans_hash(begin, end, fold=False))
        if len(self.hash) + len(keys) > self.limit:
            self._empty()
        new = np.ones(len(keys), bool)
        if len(self.hash):
            new = self.hash[np.minimum(np.searchsorted(self.hash, keys), len(self.hash) - 1)] != keys
        # What shares a hash with other signs: within these texts, then with the cache.
        other = _differ(c.codes, begin, size, c.codes, begin[where[which]], size[where[which]])
        if not new.all():
            old, held = where[~new], self.entry[np.searchsorted(self.hash, keys[~new])]
            wrong = np.zeros(len(keys), bool)
            wrong[~new] = _differ(c.codes, begin[old], size[old], self.signs.flat, self.signs.begin[held], self.signs.count[held])
            other |= wrong[which]
        text, offset = c.utf8() if new.any() or other.any() else (None, None)
        if new.any():
            b, e = begin[where[new]], end[where[new]]
            entries = self._merged(text, offset[b], offset[e] - offset[b])
            self._keep(keys[new], entries, c, b, e - b)
        entry = self.entry[np.searchsorted(self.hash, keys)][which]
        for i in np.flatnonzero(other):  # kept under no hash
            ids = self._alone(text[offset[begin[i]] : offset[end[i]]])
            entry[i] = self.ids.add(np.array(ids, np.int32), np.array([len(ids)]))[0]
            self.signs.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        counts = self.ids.count[entry]
        return self.ids.flat[_places(self.ids.begin[entry], counts)], counts


class _Lists:
    """Numbered lists in one growing array."""

    def __init__(self, kind: type):
        self.flat, self.used = np.zeros(1 << 16, kind), 0
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Lists one after the other; their numbers."""
        while len(self.flat) < self.used + len(values):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(values)] = values
        first = len(self.begin)
        self.begin = np.append(self.begin, self.used + np.cumsum(counts) - counts)
        self.count = np.append(self.count, counts)
        self.used += len(values)
        return np.arange(first, len(self.begin))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, a place of each, and which one each key is."""
    coded = pa.array(keys).dictionary_encode()
    which, found = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    where = np.empty(len(found), np.int64)
    where[which] = np.arange(len(keys))
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return found[order], where[order], rank[which]


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _differ(a: np.ndarray, a_begin, a_size, b: np.ndarray, b_begin, b_size) -> np.ndarray:
    """Whether the spans of ``a`` are others than those of ``b``."""
    out = a_size != b_size
    some = np.flatnonzero(~out & ((a_begin != b_begin) | (a is not b)))
    size = a_size[some]
    step = _places(np.zeros(len(some), np.int64), size).astype(np.int32)
    left, right = (np.repeat(x[some].astype(np.int32), size) for x in (a_begin, b_begin))
    unlike = np.flatnonzero(a[left + step] != b[right + step])
    if len(unlike):
        out[some[np.searchsorted(np.cumsum(size), unlike, "right")]] = True
    return out


def byte_names() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabulary files: visible Latin-1 signs stand for
    themselves, the others take the codepoints from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def rank_file(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a file with one base64 token and rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def rank_encoder(ranks: dict[bytes, int]) -> SliceEncoder:
    """Two ids merge where their joined bytes are a token; its rank decides. A slice that is a token stays whole."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                pairs[a, b] = (rank, rank)
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    whole = {}
    for token, rank in ranks.items():
        try:
            whole[token.decode()] = rank
        except UnicodeDecodeError:  # part of a character: never a whole slice
            continue
    return SliceEncoder(Merges(pairs), single, single, whole)


def merge_file_encoder(path: str) -> SliceEncoder:
    """From a tokenizer file with a list of merges and a word-end mark."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, end = model["vocab"], model.get("end_of_word_suffix") or ""
    pairs = {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        pairs.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
    names = byte_names()
    inner = np.array([vocabulary.get(names[b], -1) for b in range(256)], np.int32)
    last = np.array([vocabulary.get(names[b] + end, -1) for b in range(256)], np.int32)
    return SliceEncoder(Merges(pairs), inner, last, {})
