"""Parallel scans of byte strings by a finite automaton that counts events.

A text is cut into lanes of a few bytes. All lanes of a block run in lockstep from every state at
once, so each lane gives a function: where it leads from each state, and how many events of each kind
it sees on the way. Functions of neighbours compose associatively; doubling steps over the lanes of
each text give the function of every beginning of it, hence the state in which each lane is entered
and the events before it. The n-th event is then looked up by lane and found by running one lane again.
"""

from __future__ import annotations

import numpy as np

_WIDTH = 64
_PAD = 256  # a symbol past a lane's end: stays in its state, no event


class Automaton:
    """Transitions ``to[state, byte]`` and events ``emits[kind, state, byte]``; a scan begins in state 0."""

    def __init__(self, to: np.ndarray, emits: np.ndarray):
        self.states, self.kinds = len(to), len(emits)
        stay = np.arange(self.states, dtype=np.uint8)[:, None]
        self.to = np.hstack([to.astype(np.uint8), stay]).ravel()
        self.emits = [np.hstack([e.astype(np.uint8), np.zeros((self.states, 1), np.uint8)]).ravel() for e in emits]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        at = state.astype(np.int32) * (_PAD + 1) + symbol
        return self.to[at], [e[at] for e in self.emits]


class Scan:
    """The lanes of consecutive texts, with the function of each text's beginning up to and with each lane."""

    def __init__(self, machine: Automaton, data: np.ndarray, offsets: np.ndarray, width: int = _WIDTH):
        self.machine, self.data, self.width = machine, data, width
        sizes = np.diff(offsets)
        n = -(-sizes // width)
        self.bounds = np.concatenate([[0], np.cumsum(n)])  # text i has lanes bounds[i]:bounds[i + 1]
        text = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(self.bounds[-1]) - self.bounds[text]
        self.starts = offsets[text] + nth * width
        self.lengths = np.minimum(width, offsets[text + 1] - self.starts)
        self.offsets = offsets
        lanes = len(self.starts)
        state = np.repeat(np.arange(machine.states, dtype=np.uint8)[:, None], lanes, axis=1)
        counts = np.zeros((machine.kinds, machine.states, lanes), dtype=np.int64)
        for t in range(width if lanes else 0):
            state, seen = machine.step(state, self._symbols(self.starts, self.lengths, t))
            for kind, events in enumerate(seen):
                counts[kind] += events
        self._compose(state, counts, nth)

    def _symbols(self, starts: np.ndarray, lengths: np.ndarray, t: int) -> np.ndarray:
        inside = t < lengths
        return np.where(inside, self.data[np.where(inside, starts + t, 0)].astype(np.int32), np.int32(_PAD))

    def _compose(self, to: np.ndarray, counts: np.ndarray, nth: np.ndarray) -> None:
        """Doubling: after step d each lane has the function of the last 2 d lanes up to itself."""
        d, most = 1, int(nth.max(initial=-1))
        while d <= most:
            later = np.flatnonzero(nth >= d)
            first = to[:, later - d]  # where the earlier part leads from each state
            through = np.take_along_axis(to[:, later], first.astype(np.int64), axis=0)
            added = [counts[k][:, later - d] + np.take_along_axis(counts[k][:, later], first.astype(np.int64), axis=0) for k in range(len(counts))]
            to[:, later] = through
            for k, a in enumerate(added):
                counts[k][:, later] = a
            d *= 2
        self.to, self.counts = to, counts

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each whole text: (state reached, text) and (kind, events, text), from every state in turn."""
        machine, n = self.machine, len(self.offsets) - 1
        full = np.flatnonzero(np.diff(self.bounds) > 0)
        to = np.repeat(np.arange(machine.states, dtype=np.uint8)[:, None], n, axis=1)
        counts = np.zeros((machine.kinds, machine.states, n), dtype=np.int64)
        last = self.bounds[full + 1] - 1
        to[:, full], counts[:, :, full] = self.to[:, last], self.counts[:, :, last]
        return to, counts

    def nth_event(self, kind: int, text: np.ndarray, state: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The byte, from each text's beginning, that sets off event number ``rank`` (from 1) entering in ``state``."""
        lane = np.empty(len(text), dtype=np.int64)
        for k, (i, s, r) in enumerate(zip(text.tolist(), state.tolist(), rank.tolist(), strict=True)):
            a, b = self.bounds[i], self.bounds[i + 1]
            lane[k] = a + np.searchsorted(self.counts[kind, s, a:b], r)
        first = lane == self.bounds[text]
        before = np.where(first, 0, self.counts[kind, state, np.maximum(lane - 1, 0)])
        now = np.where(first, state, self.to[state, np.maximum(lane - 1, 0)]).astype(np.uint8)
        left, found = rank - before, np.full(len(text), -1, dtype=np.int64)
        starts, lengths = self.starts[lane], self.lengths[lane]
        for t in range(self.width if len(text) else 0):
            now, seen = self.machine.step(now, self._symbols(starts, lengths, t))
            left = left - seen[kind]
            hit = (left == 0) & (found < 0)
            found[hit] = (starts - self.offsets[text])[hit] + t
        return found
