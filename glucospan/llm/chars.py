"""Texts as codepoint arrays: character classes, words and their hashes, whole batches at a time.

A batch of texts is joined into one array with a separator after each text. Words are maximal runs of
letters, marks and digits, compared in lower case; a codepoint maps to one codepoint, so positions in
the array are positions in the text.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SEPARATOR = sys.maxunicode + 1
#: Fixed value: the codepoints with Unicode's White_Space property, as inclusive ranges.
WHITE = (
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
OTHER, LETTER, NUMBER, SPACE, MARK, END = range(6)
#: Codepoints worked on at a time; a single longer text is worked on alone, whole.
CHUNK = 1 << 18


@functools.cache
def kinds() -> np.ndarray:
    """The kind of each codepoint, with the separator's at the end."""
    of = {"L": LETTER, "N": NUMBER, "M": MARK}
    table = np.fromiter(
        (of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(SEPARATOR)), np.uint8, SEPARATOR
    )
    for low, high in WHITE:
        table[low : high + 1] = SPACE
    return np.append(table, np.uint8(END))


@functools.cache
def lower() -> np.ndarray:
    """Each codepoint's lower case where that is a single codepoint, else itself."""
    table = np.arange(SEPARATOR + 1, dtype=np.uint32)
    for c in range(SEPARATOR):
        if len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: multiply and fold."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@functools.cache
def spread(fold: bool) -> np.ndarray:
    """A random-looking 64-bit value for each codepoint, or for its lower case."""
    codes = lower() if fold else np.arange(SEPARATOR + 1)
    return mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))


class Powers:
    """Powers of an odd number modulo 2**64, extended as longer arrays come."""

    def __init__(self, base: int):
        self.base, self.table = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            with np.errstate(over="ignore"):
                self.table = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, self.base)))
        return self.table[:n]


UP, DOWN = Powers(BASE), Powers(INVERSE)


@dataclass
class Chars:
    """Several texts: codepoints, where each begins, and the number of each."""

    codes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def utf8(self) -> tuple[np.ndarray, np.ndarray]:
        """The texts' UTF-8 bytes, a line feed after each text, and the byte at which each codepoint begins."""
        codes = np.where(self.codes == SEPARATOR, np.uint32(10), self.codes)
        size = 1 + (codes >= 0x80) + (codes >= 0x800).astype(np.int64) + (codes >= 0x10000)
        text = codes.tobytes().decode("utf-32-le").encode()
        return np.frombuffer(text, np.uint8), np.append(0, np.cumsum(size))

    def spans_hash(self, begin: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
        """A 64-bit hash of each span (of its lower case if ``fold``), whatever its place."""
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.codes) + 1, np.uint64)
            np.cumsum(spread(fold)[self.codes] * UP.upto(len(self.codes)), out=total[1:])
            return mixed((total[end] - total[begin]) * DOWN.upto(len(self.codes) + 1)[begin])


@dataclass
class Words:
    """Words of several texts in order: text number, span in that text, hash of the word and of its first
    letters; ``first`` cuts by text."""

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    stem: np.ndarray
    first: np.ndarray


def chars(texts: list[str]) -> Chars:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32).copy()
    ends = np.cumsum(lengths + 1)
    codes[ends - 1] = SEPARATOR
    return Chars(codes, ends - lengths - 1, lengths)


def words(texts: list[str], stem: int = 0) -> Words:
    c = chars(texts)
    kind = kinds()[c.codes]
    inside = (kind == LETTER) | (kind == NUMBER) | (kind == MARK)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(c.starts, begin, "right") - 1
    shift = c.starts[text] if len(text) else text
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    stems = c.spans_hash(begin, np.minimum(end, begin + stem)) if stem else np.zeros(0, np.uint64)
    return Words(text, begin - shift, end - shift, c.spans_hash(begin, end), stems, first)


def windows_hash(hashes: np.ndarray, text: np.ndarray, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words at i + step for each step, and i, wherever all of them lie in one text."""
    reach = max(steps)
    n = max(0, len(hashes) - reach)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(len(steps)), np.uint64)
        for k, step in enumerate(steps):
            total = total + hashes[step : step + n] * np.uint64(pow(BASE, 2 * k + 3, 1 << 64))
    at = np.flatnonzero(text[:n] == text[reach:])
    return mixed(total[at]), at


def values(column) -> Iterator:
    """The values of a list or an Arrow column, of which only a few are turned into objects at a time."""
    if isinstance(column, list):
        yield from column
        return
    for low in range(0, len(column), 128):
        yield from column.slice(low, 128).to_pylist()


def chunks(texts) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts, of a list or an Arrow column, of about ``CHUNK`` codepoints with the place of the
    first; a null is empty."""
    run, size, at = [], 0, 0
    for i, text in enumerate(values(texts)):
        text = text or ""
        if run and size + len(text) > CHUNK:
            yield at, run
            run, size, at = [], 0, i
        run.append(text)
        size += len(text) + 1
    if run:
        yield at, run
