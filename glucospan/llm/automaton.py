"""A finite automaton run over a long array without a loop per character.

Each character stands for a function from states to states. Composing functions is associative, so the
state before every character follows from a prefix scan. The functions that can come up are few (they
form the automaton's transition monoid); each has a number, and composing is one table look-up.
"""

from __future__ import annotations

import numpy as np


class Automaton:
    def __init__(self, steps: list[list[int]]):
        """``steps[symbol][state]`` is the next state. State 0 is the first."""
        self.number = {tuple(range(len(steps[0]))): 0}
        known = list(self.number)
        for f in map(tuple, steps):
            if f not in self.number:
                self.number[f] = len(known)
                known.append(f)
        at = 0
        while at < len(known):  # every product of a known function and a symbol's
            for g in map(tuple, steps):
                h = tuple(g[s] for s in known[at])
                if h not in self.number:
                    self.number[h] = len(known)
                    known.append(h)
            at += 1
        self.symbol = np.array([self.number[tuple(f)] for f in steps], np.uint16)
        self.then = np.array(
            [[self.number[tuple(g[s] for s in f)] for g in known] for f in known], np.uint16
        )
        self.start = np.array([f[0] for f in known], np.uint8)

    def before(self, symbols: np.ndarray) -> np.ndarray:
        """The state before each symbol."""
        return self.start[self._prefix(self.symbol[symbols])]

    def _prefix(self, functions: np.ndarray) -> np.ndarray:
        """The product of all functions before each place."""
        n = len(functions)
        if n <= 64:
            out, so_far = np.zeros(n, np.uint16), 0
            for i, f in enumerate(functions):
                out[i] = so_far
                so_far = self.then[so_far, f]
            return out
        width = int(np.ceil(n ** 0.5))
        rows = -(-n // width)
        grid = np.zeros(rows * width, np.uint16)
        grid[:n] = functions
        grid = np.ascontiguousarray(grid.reshape(rows, width).T)
        inside = np.zeros_like(grid)
        so_far = np.zeros(rows, np.uint16)
        flat, size = self.then.ravel(), len(self.then)
        for i in range(width):
            inside[i] = so_far
            so_far = flat[so_far.astype(np.int64) * size + grid[i]]
        ahead = self._prefix(so_far)
        return flat[ahead.astype(np.int64)[None, :] * size + inside].T.reshape(-1)[:n]
