"""Finite transducers over symbols, run in stretches that compose by a parallel prefix scan."""

from __future__ import annotations

import numpy as np


class Transducer:
    """A deterministic transducer: ``step[state][symbol]`` and, of the same shape, whether it emits.

    A stretch of symbols is a function from states to states. Stretches are summed up apart
    from each other; a scan over these functions gives the state in which each begins.
    """

    def __init__(self, step: list[list[int]], emit: list[list[bool]], start: int = 0):
        self.step, self.emit, self.start = step, emit, start
        self._maps = np.array(step, np.int16).T.copy()  # symbol -> state -> state
        self._emits = np.array(emit, bool)

    def run(self, symbols, state: int) -> tuple[list[int], int]:
        """The indices of the symbols that emit, and the state at the end, one symbol after the other."""
        step, emit, out = self.step, self.emit, []
        for i, x in enumerate(symbols):
            if emit[state][x]:
                out.append(i)
            state = step[state][x]
        return out, state

    def levels(self, symbols: np.ndarray) -> list[np.ndarray]:
        """The functions of stretches of 1, 2, 4, ... symbols: the sums of a stretch, by pairwise composition."""
        out = [self._maps[symbols]]
        while len(out[-1]) > 1:
            maps = out[-1]
            if len(maps) % 2:
                maps = np.concatenate([maps, np.arange(maps.shape[1], dtype=maps.dtype)[None]])
            out.append(np.take_along_axis(maps[1::2], maps[::2], axis=1))
        return out

    def function(self, symbols: np.ndarray) -> np.ndarray:
        """The state function of a stretch."""
        return self.levels(symbols)[-1][0] if len(symbols) else np.arange(len(self.step), dtype=np.int16)

    @staticmethod
    def states(levels: list[np.ndarray], state: int) -> np.ndarray:
        """The state before each symbol, from the sums downwards: a right half begins where its left half ends."""
        before = np.array([state], np.int64)
        for maps in levels[-2::-1]:
            left = maps[::2][: len(before)]
            both = np.empty(2 * len(before), np.int64)
            both[::2] = before
            both[1::2] = left[np.arange(len(before)), before]
            before = both[: len(maps)]
        return before

    @staticmethod
    def scan(functions: np.ndarray) -> np.ndarray:
        """Inclusive prefix compositions of (n, states) functions in log2(n) rounds."""
        out, shift = functions.copy(), 1
        while shift < len(out):
            out[shift:] = np.take_along_axis(out[shift:], out[:-shift].copy(), axis=1)
            shift *= 2
        return out

    def run_stretches(self, stretches: list[list[int]]) -> list[np.ndarray]:
        """The indices that emit, by stretch: each is summed up once, the sums are scanned, and its states follow from its sums."""
        if not stretches:
            return []
        full = [np.asarray(x, np.int64) for x in stretches]
        sums = [self.levels(x) if len(x) else [] for x in full]
        identity = np.arange(len(self.step), dtype=np.int16)
        before = self.scan(np.stack([x[-1][0] if x else identity for x in sums]))
        starts = [self.start, *(int(f[self.start]) for f in before[:-1])]
        return [np.flatnonzero(self._emits[self.states(x, s), c]) if x else np.zeros(0, np.int64) for x, s, c in zip(sums, starts, full, strict=True)]
