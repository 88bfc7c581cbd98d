"""Minimal acyclic transducer from byte strings to numbers: shared prefixes and shared suffixes.

Words are added in sorted order; a finished branch is replaced by an equal state that is already registered,
so the automaton stays minimal.  Each transition carries the number of words that precede it in its state, and
their sum along a path is the word's number.  The automaton is laid out as flat arrays in one byte string,
which readers map into memory, and whole arrays of words are looked up at once, one byte position per step.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

HEADER = 4


def build(words: list[bytes]) -> bytes:
    """The automaton of sorted distinct ``words``."""
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    path: list[tuple[bool, dict]] = [(False, {})]  # open states along the last word
    last = b""

    def freeze(depth: int, word: bytes) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            key = (final, tuple(edges.items()))
            if key not in registry:
                registry[key] = len(states)
                states.append(key)
            path[-1][1][word[len(path) - 1]] = registry[key]

    for word in words:
        if word <= last and (word or last):
            raise ValueError("words must be sorted and distinct")
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        freeze(same, last)
        path += [(False, {}) for _ in range(len(word) - same)]
        path[len(word)] = (True, path[len(word)][1])
        last = word
    freeze(0, last)
    states.append((path[0][0], tuple(path[0][1].items())))

    total = np.zeros(len(states), np.int64)
    keys, targets, skips = [], [], []
    for s, (final, edges) in enumerate(states):  # targets come before their sources
        before = int(final)
        for byte, to in edges:
            keys.append(s << 8 | byte)
            targets.append(to)
            skips.append(before)
            before += int(total[to])
        total[s] = before
    final = np.array([f for f, _ in states], np.int64)
    head = np.array([len(states), len(keys), len(words), 0], np.int64)
    return b"".join(x.tobytes() for x in (head, np.array(keys, np.int64), np.array(targets, np.int64),
                                          np.array(skips, np.int64), final))


class Transducer:
    """A built automaton, mapped from a file that is unlinked once it is mapped."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self._map = mmap.mmap(f.fileno(), len(blob), access=mmap.ACCESS_READ)
        flat = np.frombuffer(self._map, np.int64)
        self.n_states, n, self.n_words, _ = (int(x) for x in flat[:HEADER])
        self.n_transitions = n
        self.keys, self.targets, self.skips = (flat[HEADER + i * n:HEADER + (i + 1) * n] for i in range(3))
        self.final = flat[HEADER + 3 * n:]

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of each word data[offsets[i]:offsets[i + 1]], or -1 where it is not in the automaton."""
        starts, lengths = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
        out = np.full(len(starts), -1, np.int64)
        live = np.arange(len(starts))
        state = np.full(len(starts), self.n_states - 1, np.int64)
        number = np.zeros(len(starts), np.int64)
        step = 0
        while len(live):
            done = lengths[live] == step
            hit = done & (self.final[state] == 1)
            out[live[hit]] = number[hit]
            live, state, number = live[~done], state[~done], number[~done]
            if not len(live) or not self.n_transitions:
                break
            key = state << 8 | data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), self.n_transitions - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            number = number[ok] + self.skips[at]
            state = self.targets[at]
            step += 1
        return out
