"""Where the pieces of two public split patterns begin, by character kinds and an automaton scan.

Both patterns first try the endings 's 't 'm 'd 're 've 'll where a piece may begin, then runs. In the
byte-level pattern a run of letters, of numbers or of other signs may take one space before it, and
white space before a visible character leaves its last character over; in the word pattern white space
only separates and each number character stands alone.
"""

from __future__ import annotations

import numpy as np

from glucospan.llm.automaton import Automaton
from glucospan.llm.chars import END, LETTER, NUMBER, SPACE, Chars, kinds

# Symbols.
L, N, O, TICK1, TICK2, BLANK, LAST, GAP, STOP = range(9)
# States: what the last character belongs to.
FRESH, IN_L, IN_N, IN_O, SPACED, IN_GAP, ONE_LEFT, TWO_LEFT = range(8)


def _byte_level(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins."""
    joins = state == SPACED
    if symbol == L:
        if state == ONE_LEFT:
            return FRESH, False
        if state == TWO_LEFT:
            return ONE_LEFT, False
        return IN_L, not (joins or state == IN_L)
    if symbol == N:
        return IN_N, not (joins or state == IN_N)
    if symbol == O or symbol in (TICK1, TICK2) and (joins or state == IN_O):
        return IN_O, not (joins or state == IN_O)
    if symbol in (TICK1, TICK2):
        return (ONE_LEFT if symbol == TICK1 else TWO_LEFT), True
    if symbol == BLANK:
        return SPACED, True
    if symbol == LAST:
        return FRESH, True
    if symbol == GAP:
        return IN_GAP, state != IN_GAP
    return FRESH, True


def _word(state: int, symbol: int) -> tuple[int, bool]:
    if symbol in (BLANK, LAST, GAP, STOP):
        return FRESH, False
    if symbol == N:
        return FRESH, True
    return _byte_level(state, symbol)


class Splitter:
    def __init__(self, rule):
        table = [[rule(state, symbol) for state in range(8)] for symbol in range(9)]
        self.automaton = Automaton([[to for to, _ in row] for row in table])
        self.begins = np.array([[new for _, new in row] for row in table])

    def starts(self, c: Chars) -> np.ndarray:
        """Whether a piece begins at each place; one begins at each separator of the byte-level rule."""
        s = symbols(c)
        return self.begins[s, self.automaton.before(s)]


BYTE_LEVEL, WORD = Splitter(_byte_level), Splitter(_word)

_OF_KIND = np.array([O, L, N, GAP, O, STOP], np.uint8)


def symbols(c: Chars) -> np.ndarray:
    codes = c.codes
    kind = kinds()[codes]
    out = _OF_KIND[kind]
    after = np.append(kind[1:], np.uint8(END))
    last = (kind == SPACE) & (after != SPACE) & (after != END)
    out[last] = np.where(codes[last] == 0x20, BLANK, LAST)
    tick = np.flatnonzero(codes == ord("'"))
    padded = np.append(codes, [0, 0])
    one, two = padded[tick + 1], padded[tick + 2]
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    out[tick[short]] = TICK1
    out[tick[long]] = TICK2
    assert LETTER == 1 and NUMBER == 2
    return out
