"""Minimal acyclic transducer of a sorted word list: a word's path sums to its ordinal."""
from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Transducer:
    """States are numbered so that edges go to lower ones; the last state is the root.

    ``keys`` holds state * 256 + byte of every edge in order, ``target`` and
    ``output`` what it leads to and adds; ``final`` marks states that end a word.
    """

    def __init__(self, keys: np.ndarray, target: np.ndarray, output: np.ndarray, final: np.ndarray):
        self.keys, self.target, self.output, self.final = keys, target, output, final

    @classmethod
    def build(cls, words: Iterable[bytes]) -> Transducer:
        """From distinct words in byte order. A state is frozen once no later
        word can pass it; one with the same ending and edges as a frozen state
        is that state. An edge adds the number of words that end at or leave
        its state before it."""
        known: dict[tuple, int] = {}
        counts: list[int] = []

        def freeze(final: bool, edges: list[tuple[int, int]]) -> int:
            sign = (final, *edges)
            state = known.get(sign)
            if state is None:
                state = known[sign] = len(counts)
                counts.append(int(final) + sum(counts[t] for _, t in edges))
            return state

        # the path of the last word: (is it a word's end, edges frozen so far), and the bytes between
        path, open_, last = [], [[False, []]], b""
        for word in words:
            if path and word <= last:
                raise ValueError("words must be distinct and in byte order")
            same = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                same += 1
            while len(path) > same:
                state = freeze(*open_.pop())
                open_[-1][1].append((path.pop(), state))
            for b in word[same:]:
                path.append(b)
                open_.append([False, []])
            open_[-1][0] = True
            last = word
        while path:
            state = freeze(*open_.pop())
            open_[-1][1].append((path.pop(), state))
        root = freeze(*open_[0])
        assert root == len(counts) - 1
        keys, target, output = [], [], []
        final = np.zeros(len(counts), bool)
        for (ends, *edges), state in known.items():
            final[state] = ends
            before = int(ends)
            for b, t in edges:
                keys.append(state * 256 + b)
                target.append(t)
                output.append(before)
                before += counts[t]
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        return cls(*[np.array(x, np.int64)[order] for x in (keys, target, output)], final)

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """The ordinal of every word, -1 for those not in the list. All words
        take their next byte at the same time."""
        found = np.full(len(words), -1, np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(length) - length
        at = np.arange(len(words))
        state = np.full(len(words), len(self.final) - 1)
        total = np.zeros(len(words), np.int64)
        step = 0
        while len(at):
            ended = length[at] == step
            if ended.any():
                good = ended & self.final[state]
                found[at[good]] = total[good]
                at, state, total = at[~ended], state[~ended], total[~ended]
            if not len(at) or not len(self.keys):
                break
            key = state * 256 + text[start[at] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[edge] == key
            edge, at = edge[on], at[on]
            state, total = self.target[edge], total[on] + self.output[edge]
            step += 1
        return found

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.keys), len(self.final)], np.int64)
        return b"".join(x.tobytes() for x in (sizes, self.keys, self.target, self.output, self.final))

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        edges, states = np.frombuffer(data, np.int64, 2)
        parts = [np.frombuffer(data, np.int64, edges, 16 + 8 * edges * i) for i in range(3)]
        return cls(*parts, np.frombuffer(data, bool, states, 16 + 24 * edges))
